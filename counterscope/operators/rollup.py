"""Statistics kept by spans of samples, so that a long period is answered without reading its samples.

A row holds the moments of one metric of one key over one span: n, mean, sum of squared deviations from it, minimum and maximum. Rows
combine by the parallel rule for variances, in any grouping: spans to days, days to a period, several rows of one span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterscope.operators.metrics import metric_columns
from counterscope.schema import COUNTERS

SPAN = 64
IDS = ("server_id", "digest", "schema_name")
MOMENTS = ("n", "mean", "m2", "min", "max")


def rollup(samples: DataFrame, ids: Sequence[str] = IDS, span: int = SPAN, counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Moments of every metric by key and span; span s has the samples s * ``span`` to (s + 1) * ``span`` - 1."""
    metrics = metric_columns(counters)
    stats = [F.count("*").alias("n")]
    for m, v in metrics.items():
        stats += [F.avg(v).alias(f"{m}_mean"), (F.var_pop(v) * F.count("*")).alias(f"{m}_m2"), F.min(v).alias(f"{m}_min"), F.max(v).alias(f"{m}_max")]
    wide = samples.groupBy(*ids, F.floor(F.col("sample_seq") / span).cast("int").alias("span_no")).agg(*stats)
    cells = []
    for i, m in enumerate(metrics, start=1):
        cells += [F.lit(i), F.lit(m), *[F.col(f"{m}_{x}") for x in MOMENTS[1:]]]
    rows = F.stack(F.lit(len(metrics)), *cells).alias("metric_ord", "metric", *MOMENTS[1:])
    return wide.select(*ids, "span_no", "n", rows).select(*ids, "span_no", "metric_ord", "metric", *MOMENTS)


def combined(rollups: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row of moments per value of ``ids``. Deviations are taken from the mean of all, found first, so nothing cancels."""
    group = Window.partitionBy(*ids)
    total = F.sum("n").over(group)
    centred = rollups.withColumn("centre", F.sum(F.col("n") * F.col("mean")).over(group) / total)
    return centred.groupBy(*ids).agg(
        F.sum("n").alias("n"),
        F.first("centre").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("centre"), F.lit(2))).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def stats_of(rollups: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """The statistics of ``metric_stats``, from rollups alone."""
    whole = combined(rollups, [*ids, "metric_ord", "metric"])
    deviation = F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n"))
    return whole.select(*ids, "metric_ord", "metric", "n", F.col("mean").alias("avg"), deviation.alias("stddev"), "min", "max")


def period_stats(
    rollups: DataFrame, samples: DataFrame, first: int, last: int, ids: Sequence[str] = IDS, span: int = SPAN, counters: Sequence[str] = COUNTERS
) -> DataFrame:
    """Statistics of samples ``first`` to ``last``: whole spans from their rollups, the ends of the period from its samples."""
    low, high = -(-first // span), (last + 1) // span  # the spans low to high - 1 lie inside
    seq = F.col("sample_seq")
    inside = rollups.where((F.col("span_no") >= low) & (F.col("span_no") < high)) if low < high else rollups.where(F.lit(False))
    ends = samples.where(seq.between(first, last))
    if low < high:
        ends = ends.where((seq < low * span) | (seq >= high * span))
    return stats_of(inside.unionByName(rollup(ends, ids, span, counters)), ids)
