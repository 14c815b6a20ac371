"""Counters that cannot be differenced: least and greatest time, first and last execution.

They are records since the server's start, so an interval's own value is known only if the record moved in it. If the
greatest time rose, the new one was reached in the interval; else it is merely a limit for what happened in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterscope.functions.keys import is_empty, with_text
from counterscope.operators.deltas import SPAN
from counterscope.schema import KEY

# The digest table's columns that are records, and how rows of one key are merged.
RECORDS = {"min_timer_wait": F.min, "max_timer_wait": F.max, "first_seen": F.min, "last_seen": F.max}


def merge_records(keyed: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per server, snapshot and key with its records; rows without activity do not count unless there are no others."""
    counts: list[Column] = [F.max("collected_time").alias("collected_time"), F.count_if(~is_empty()).alias("busy")]
    for name, merge in RECORDS.items():
        counts.append(F.coalesce(merge(F.when(~is_empty(), F.col(name))), merge(name)).alias(name))
    return keyed.groupBy("server_id", "collection_seq", *key).agg(*counts)


def record_deltas(merged: DataFrame, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """What neighbouring snapshots say about the interval between them.

    ``max_timer_wait`` and ``min_timer_wait`` are the interval's own where the record moved, else NULL; the limits
    ``max_at_most`` and ``min_at_least`` hold in any case. ``last_seen`` is the last execution if there was one in the interval, and
    ``is_new`` says that the query had not been seen before it. Pairs over a restart (a record that went back) are left out. History is cut into
    spans as in ``adjacent_pairs``.
    """
    own = f"cast(floor(collection_seq / {span}) as int)"
    spans = f"if(collection_seq % {span} = 0, array({own}, {own} - 1), array({own}))"
    state = F.struct("collection_seq", "collected_time", *RECORDS)
    history = Window.partitionBy(*key, "server_id", "span").orderBy("collection_seq")
    lagged = merged.where("busy > 0").withColumn("span", F.explode(F.expr(spans))).withColumn("before", F.lag(state).over(history))
    pairs = lagged.where("before.collection_seq = collection_seq - 1")
    went_back = "max_timer_wait < before.max_timer_wait or min_timer_wait > before.min_timer_wait or last_seen < before.last_seen or first_seen > before.first_seen"
    moved = {c: F.when(F.col(c) != F.col("before")[c], F.col(c)).alias(c) for c in ("min_timer_wait", "max_timer_wait", "last_seen")}
    return pairs.where(~F.expr(went_back)).select(
        "server_id",
        F.col("before.collection_seq").alias("sample_seq"),
        *with_text(key),
        moved["min_timer_wait"],
        moved["max_timer_wait"],
        F.col("min_timer_wait").alias("min_at_least"),
        F.col("max_timer_wait").alias("max_at_most"),
        moved["last_seen"],
        (F.col("first_seen") >= F.col("before.collected_time")).alias("is_new"),
    )
