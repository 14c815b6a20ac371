import numpy as np
import pyarrow.parquet as pq

from counterscope.llm.neighbours import Settings, block_answers, nearest, unit_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and None not in v and i is not None]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    out = {}
    for q, x in ok:
        if q % every == 0:
            best = {}
            for i, y in ok:
                if i != q and len(x) == len(y):
                    best[i] = max(best.get(i, -2), float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))))
            out[q] = sorted(best.items(), key=lambda e: (-round(e[1], 12), e[0]))[:k]
    return out


def check(spark, rows, least, settings=Settings(), k=5, every=10):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 AS id", "2 AS block")
    want, got = brute(rows, k, every), {}
    for r in nearest(df, lambda i: i % every == 0, k, settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert all(len(got.get(q, [])) == len(w) for q, w in want.items()) and got.keys() <= want.keys()
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= least * sum(map(len, want.values()))
    return want, got


def test_recall_against_brute_force_over_several_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    rows = [(i, (centres[i % 30] + rng.normal(size=24) * rng.choice([0.1, 0.5, 2.0])).tolist()) for i in range(1500)]
    want, got = check(spark, rows, 0.97, Settings(block=400))
    scores = {q: dict(w) for q, w in want.items()}
    assert all(abs(scores[q][i] - s) < 1e-12 for q, g in got.items() for i, s in g if i in scores[q])


def test_bad_vectors_take_no_part_and_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(30)]
    rows += [(i, [1.0] * 8) for i in range(100, 160)]  # equal vectors
    nan, inf = float("nan"), float("inf")
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [nan] + [1.0] * 7), (204, [inf] + [1.0] * 7), (205, [None] + [1.0] * 7)]
    rows += [(210, [1.0] * 3), (220, [1.0] * 3), (None, [1.0] * 8), (101, [2.0] * 8), (50, [1.0] * 8)]
    want, got = check(spark, rows, 1.0)
    assert [i for i, _ in got[100]] == [50, 101, 102, 103, 104] and [i for i, _ in got[210]] == [220]
    assert 200 not in got


def test_few_or_no_vectors(spark):
    check(spark, [(0, [1.0, 2.0])], 1.0)
    check(spark, [(0, [1.0, 2.0]), (1, [-1.0, 2.0])], 1.0)
    assert nearest(spark.createDataFrame([], SCHEMA), lambda i: i % 50 == 0).count() == 0


def test_few_vectors_of_the_given_table_are_verified_and_nearly_all_nearest_are_found(spark):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, vectors = table.column("vec_id").to_numpy(), np.array(table.column("embedding").to_pylist(), dtype=float)
    asked = np.flatnonzero(ids % 50 == 0)
    q, v, s, pairs = block_answers(ids, vectors, ids[asked], vectors[asked], np.full(len(asked), np.nan), 5, Settings())
    cosine = unit_rows(vectors[asked]) @ unit_rows(vectors).T
    cosine[np.arange(len(asked)), asked] = -2
    least = np.sort(cosine, axis=1)[:, -5]
    hits = sum(int((s[q == ids[a]] >= least[i] - 1e-12).sum()) for i, a in enumerate(asked))
    assert hits >= 0.93 * 5 * len(asked)
    assert pairs < 0.1 * len(asked) * len(ids)


def test_recall_of_the_query_on_the_given_table_over_several_blocks(spark):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    rows = list(zip(table.column("vec_id").to_pylist(), table.column("embedding").to_pylist()))
    check(spark, rows, 0.9, Settings(block=500, part=20), every=50)


def test_a_third_of_all_rows_with_one_id_is_spread_over_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(0 if i % 3 == 0 else i, rng.normal(size=16).tolist()) for i in range(600)] + [(0, [1.0] * 16)] * 300
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = nearest(df, lambda i: i == 0, 5, Settings(block=100)).collect()
    floats = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    own = np.array([v for i, v in floats if i == 0])
    others = [(i, float((unit_rows(own) @ (v / np.sqrt(v @ v))).max())) for i, v in floats if i]
    want = sorted(others, key=lambda e: -e[1])[:5]
    assert len(got) == 5 and len({r.vec_id for r in got} & {i for i, _ in want}) >= 4
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
