import duckdb
import pytest

import corpus_pipeline
from counterscope.llm.exact_dup import exact_duplicates
from counterscope.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, QUERIES[name], ORACLES[name]) is None


def test_numbered_queries_are_all_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


def test_exact_dedup_stays_in_the_engine(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_stages_keep_columns_and_their_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.selectExpr("*", "1 AS id", "'x' AS `size`", "0 AS node")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "pack_sequences":
            assert out.columns == docs.columns
        counts.append((name, docs.count(), out.count()))
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = dict((name, (before, after)) for name, before, after in counts)
    assert all(kept[name][1] < kept[name][0] for name in ("quality_filter", "exact_dedup")) and kept["near_dedup"][1] <= kept["near_dedup"][0]
    ids = docs.select("doc_id").distinct().count()
    assert 0 < ids <= kept["mix_sources"][1]


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_pipeline_equals_plain_python_where_it_can(spark):
    """Without its two models the kept documents follow from the SQL of the dedup stages."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["near_dedup"](spark, stages["exact_dedup"](spark, docs, SMALL), SMALL)
    con = connect(SMALL)
    first = con.execute(f"SELECT doc_id FROM ({ORACLES['op4_exact_dedup']}) WHERE kept").fetchall()
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{SMALL}/documents.parquet' WHERE doc_id IN (SELECT unnest({[r[0] for r in first]}))")
    want = con.execute(f"SELECT doc_id FROM ({ORACLES['op3_minhash_near_dup']}) WHERE kept").fetchall()
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r[0] for r in want)
