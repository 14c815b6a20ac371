"""Columns with any names go through every stage and operator, and ids may be the largest there is."""

import pytest

import corpus_pipeline
from counterscope.llm.exact_dup import exact_duplicates
from counterscope.llm.near_dup import near_duplicates
from tests.llm.helpers import documents

SMALL = "/root/testdata/sf0.001"
NAMES = (
    "times of low high copy __copy __hash hash __size size words pass __key row_key drop_key drop_id id none key node least __quality quality_0 "
    "QUALITY_1 quality_score score label text_key target place c0 c1 c9 a.b piece component value n"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.read.parquet(f"{SMALL}/documents.parquet")
    again = plain.where("doc_id % 10 = 3")
    return plain.unionByName(again)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_leaves_columns_of_any_name_as_they_are(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    extra = [f"concat('{n}', doc_id) AS `{n}`" for n in NAMES]
    plain, more = stage(spark, docs, SMALL), stage(spark, docs.selectExpr("*", *extra), SMALL)
    if name == "pack_sequences":
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, more.collect()))
        return
    assert more.columns == [*docs.columns, *NAMES]
    rows = more.collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in plain.select("doc_id").collect()) != []
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in rows:
        assert r[1] == texts[r[0]] and list(r)[len(docs.columns) :] == [f"{n}{r[0]}" for n in NAMES]


def test_the_largest_id_is_not_a_missing_one(spark):
    top = 2**63 - 1
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(top, "same  text"), (None, "same text"), (top, words), (None, words), (None, "alone"), (top, "x y")]
    exact = {(r.doc_id, r.text_sha256): r for r in exact_duplicates(documents(spark, rows)).collect()}
    assert len(exact) == len(rows)
    assert all((r.keep_id, r.kept) == ((top, r.doc_id == top) if r.group_size == 2 else (r.doc_id, True)) for r in exact.values())
    near = sorted(((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_duplicates(documents(spark, rows)).collect()), key=repr)
    want = [(top, top, True, 1), (None, top, False, 1), (top, top, True, 8), (None, top, False, 8), (None, None, True, 1), (top, top, True, 1)]
    assert near == sorted(want, key=repr)
