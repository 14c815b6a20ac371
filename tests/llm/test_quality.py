import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from counterscope.llm import quality as q
from tests.llm.helpers import CLASHING, documents, prose


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    chain = q.LineChain(np.zeros(q.FEATURES), rng.normal(size=(2, 2)))
    bounds = np.array([0, 3, 3, 7, 8])
    emission = rng.normal(size=8)
    good, expected, logs = chain.marginals(emission, bounds, pairs=True)
    want, moves, whole = np.zeros(8), np.zeros((2, 2)), 0.0
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        paths = list(itertools.product((0, 1), repeat=hi - lo)) if hi > lo else []
        weights = [np.exp(sum(s * e for s, e in zip(p, emission[lo:hi])) + sum(chain.moves[a, b] for a, b in zip(p, p[1:]))) for p in paths]
        for p, w in zip(paths, weights):
            want[lo:hi] += np.array(p) * w / sum(weights)
            for a, b in zip(p, p[1:]):
                moves[a, b] += w / sum(weights)
        whole += np.log(sum(weights)) if paths else 0.0
    assert np.allclose(good, want) and np.allclose(expected, moves) and np.isclose(logs, whole)


def test_features_stay_within_their_text():
    texts = ["one two\n\nthree", "", None, "x\nx\nX!!!", "a" * 100_000, "\n\n"]
    features, lengths, bounds = q.line_features(pa.array(texts, pa.string()))
    assert bounds.tolist() == [0, 2, 2, 2, 5, 6, 6] and len(lengths) == 6
    wide = q.with_neighbours(features, bounds)
    for i in (0, 2, 5):
        assert not wide[i, 1 + q.OWN : 1 + 2 * q.OWN].any()
    for i in (1, 4, 5):
        assert not wide[i, 1 + 2 * q.OWN :].any()
    for i, text in enumerate(texts):
        alone = q.line_features(pa.array([text], pa.string()))[0]
        assert np.array_equal(alone, features[bounds[i] : bounds[i + 1]])


def labelled(spark, n=400):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        line = lambda: " ".join(prose(rnd, 12)).capitalize() + "."
        junk = lambda: " ".join(w.upper() + "!!" for w in prose(rnd, 10))
        rows.append((i, "\n".join([line()] + [line() if good else junk() for _ in range(rnd.randint(2, 9))])))
        labels.append((i, int(good)))
    labels += [(0, labels[0][1]), (5000, 1), (None, 1), (7, None), (8, 9)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_documents_are_told_apart(spark):
    rows, labels = labelled(spark)
    rows += [(9000, None), (9001, ""), (None, "No id here."), rows[3], rows[3]]
    docs = documents(spark, rows, CLASHING + ";'mine' AS quality_score")
    scored = q.quality(docs, labels, name="__q")
    assert scored.columns == [*docs.columns, "__q"]
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    got = scored.collect()
    held = [(r["__q"] >= 0.3, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r["__q"] <= 1 for r in got) and len(got) == len(rows)
    kept = q.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_scores_do_not_depend_on_held_out_labels(spark):
    rows, labels = labelled(spark, 120)
    docs = documents(spark, rows)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) AS quality")
    one, other = (sorted((r.doc_id, r.quality_score) for r in q.quality(docs, x).collect()) for x in (labels, turned))
    assert one == other


def test_without_labels_or_documents(spark):
    rows, labels = labelled(spark, 20)
    neutral = {r.quality_score for r in q.quality(documents(spark, rows), labels.limit(0)).collect()}
    assert neutral == {0.5}
    assert q.quality(documents(spark, rows).limit(0), labels).count() == 0
