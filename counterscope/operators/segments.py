"""Totals of a period in which servers may have restarted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterscope.functions.keys import with_text
from counterscope.operators.deltas import SPAN
from counterscope.schema import COUNTERS, KEY


def period_segmented(
    deduped: DataFrame, counters: Sequence[str] = COUNTERS, key: Sequence[str] = KEY, span: int = SPAN, from_zero: bool = False
) -> DataFrame:
    """Activity of each key over the whole period, whatever resets lie in it.

    A key's history is cut where its executions or its time fall, and the increases of the segments are added up. What a counter
    has right after a reset was counted since then; ``from_zero`` adds it too. Without resets this is the last value minus the first. A key
    need not be in every snapshot, nor in the first or last one. ``segments`` counts the segments, ``covered_s`` the
    seconds in them. Keys without activity are left out.

    As the increase of a segment is the sum of its steps, spans of snapshots are summed on their own and then chained, a row per
    span: no task sorts more than ``span`` snapshots of one key, or more than one row per span of its history.
    """
    ids = ["server_id", *key]
    state = ["collected_time", *counters]
    spans = deduped.withColumn("span", F.floor(F.col("collection_seq") / span))
    inside = Window.partitionBy(*key, "server_id", "span").orderBy("collection_seq")
    steps = spans.select(*ids, "span", "collection_seq", *state, F.lag(F.struct(*state)).over(inside).alias("before"))
    now = F.struct(*state)
    parts = steps.groupBy(*ids, "span").agg(
        *_sums(counters, from_zero),
        F.min_by(now, "collection_seq").alias("first"),
        F.max_by(now, "collection_seq").alias("last"),
    )
    along = Window.partitionBy(*key, "server_id").orderBy("span")
    chained = parts.select("*", F.lag("last").over(along).alias("previous"))
    # the step from one span into the next, in the form of a step inside a span
    across = chained.select(
        *ids,
        *[F.col("first")[c].alias(c) for c in state],
        F.col("previous").alias("before"),
        F.col("last.collected_time").alias("upto"),
        *[f"sum_of_{c}" for c in counters],
        "resets",
        "seconds",
    )
    whole = across.groupBy(*ids).agg(
        *[(F.sum(f"sum_of_{c}") + F.sum(_increase(c, from_zero))).alias(c) for c in counters],
        (F.sum("resets") + F.sum(F.when(_fell(), 1).otherwise(0)) + 1).alias("segments"),
        (F.sum("seconds") + F.sum(_seconds())).alias("covered"),
        F.min("collected_time").alias("start_time"),
        F.max("upto").alias("end_time"),
    )
    active = whole.where((F.col("count_star") > 0) & (F.col("sum_timer_wait") > 0))
    return active.select("server_id", *with_text(key), "start_time", "end_time", (F.col("covered") / 1e6).alias("covered_s"), "segments", *counters)


def _fell() -> Column:
    return (F.col("count_star") < F.col("before.count_star")) | (F.col("sum_timer_wait") < F.col("before.sum_timer_wait"))


def _increase(counter: str, from_zero: bool) -> Column:
    value = F.col(counter)
    return F.when(F.col("before").isNull(), F.lit(0)).when(_fell(), value if from_zero else F.lit(0)).otherwise(value - F.col("before")[counter])


def _seconds() -> Column:
    gap = F.unix_micros("collected_time") - F.unix_micros("before.collected_time")
    return F.when(F.col("before").isNull() | _fell(), F.lit(0)).otherwise(gap)


def _sums(counters: Sequence[str], from_zero: bool) -> list[Column]:
    sums = [F.sum(_increase(c, from_zero)).alias(f"sum_of_{c}") for c in counters]
    return [*sums, F.sum(F.when(_fell(), 1).otherwise(0)).alias("resets"), F.sum(_seconds()).alias("seconds")]
