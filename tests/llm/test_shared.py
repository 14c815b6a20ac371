"""Joins of documents with many keys must not move the documents."""

import random

import pytest
from pyspark.sql import functions as F

from counterscope.llm import shared
from counterscope.llm.exact_dup import drop_exact_duplicates
from counterscope.llm.near_dup import drop_near_duplicates, near_duplicates
from tests.llm.helpers import CLASHING, documents, prose


def test_a_key_filter_finds_every_key_and_few_others(spark):
    rows = spark.range(40_000)
    keys = shared.staged(spark.range(0, 40_000, 7).select(F.col("id").alias("key")), "keys")
    told = shared.likely(rows, F.xxhash64("id"), keys, F.xxhash64("key"))
    assert told.columns == ["id", "listed"] and told.count() == 40_000
    assert told.filter("id % 7 = 0 and not listed").isEmpty()
    assert told.filter("id % 7 != 0 and listed").count() < 40_000 / 32
    none = shared.staged(spark.range(0).select(F.col("id").alias("key")), "keys")
    assert shared.likely(rows, F.xxhash64("id"), none, F.xxhash64("key")).filter("listed").isEmpty()


def test_a_full_filter_lists_rows_too_many_but_misses_none(spark, monkeypatch):
    monkeypatch.setattr(shared, "FILTER_BITS", 1 << 15)
    rows = spark.range(200_000)
    keys = shared.staged(spark.range(0, 200_000, 2).select(F.col("id").alias("key")), "keys")
    told = shared.likely(rows, F.xxhash64("id"), keys, F.xxhash64("key"))
    assert told.filter("id % 2 = 0 and not listed").isEmpty()


def rows_with_copies():
    rnd = random.Random(11)
    texts = [" ".join(prose(rnd, 40)) for _ in range(150)]
    rows = list(enumerate(texts))
    rows += [(1000 + i, t) for i, t in enumerate(texts[::5])] + [(2000 + i, t + " one more") for i, t in enumerate(texts[1::5])]
    rows += [(3, texts[3])] * 4 + [(None, texts[7]), (None, texts[7]), (None, "alone"), (5000, None), (5001, ""), (None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("drop", [drop_exact_duplicates, drop_near_duplicates])
def test_rows_that_stay_are_the_same_without_broadcasts(spark, monkeypatch, drop):
    docs = documents(spark, rows_with_copies(), CLASHING)
    want = sorted(map(repr, drop(docs).collect()))
    monkeypatch.setattr(shared, "BROADCAST_LIMIT", 0)
    left = drop(docs)
    assert left.columns == docs.columns
    assert sorted(map(repr, left.collect())) == want


def test_only_texts_that_may_be_listed_are_shuffled(spark, monkeypatch):
    docs = documents(spark, rows_with_copies())
    monkeypatch.setattr(shared, "BROADCAST_LIMIT", 0)
    dropped = shared.staged(spark.createDataFrame([(i, None) for i in range(0)], "drop_id long, drop_key long"), "dropped")
    assert shared.without(docs, dropped).count() == docs.count()
    some = docs.filter("doc_id >= 1000 and doc_id < 2000").select(F.col("doc_id").alias("drop_id"), shared.text_key().alias("drop_key"))
    some = shared.staged(some, "dropped")
    apart, joined = shared._hits(docs, some)
    assert joined("left_semi").count() == 30 and joined("left_anti").count() < docs.count() / 20
    assert apart.count() + joined("left_semi").count() + joined("left_anti").count() == docs.count()
    plan = apart._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_a_side_of_few_but_large_rows_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 10_000)
    small = shared.staged(spark.range(10).select("id", F.lit("x").alias("text")), "side")
    large = shared.staged(spark.range(10).select("id", F.struct(F.repeat(F.lit("x"), 2000).alias("text"), F.array("id").alias("a")).alias("s")), "side")
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(shared.counted_broadcast(small)) and not hint(shared.counted_broadcast(large))


def test_near_duplicates_are_the_same_when_nothing_is_broadcast(spark, monkeypatch):
    docs = documents(spark, rows_with_copies())
    want = sorted(map(repr, near_duplicates(docs).collect()))
    monkeypatch.setattr(shared, "BROADCAST_LIMIT", 0)
    monkeypatch.setattr(shared, "FILTER_BITS", 1 << 15)
    assert sorted(map(repr, near_duplicates(docs).collect())) == want
