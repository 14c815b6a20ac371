"""Metric values of samples and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterscope.functions.rates import latency, per_second
from counterscope.schema import COUNTERS, METRIC_NAMES

# Samples per array: an array never grows with the length of the history.
CHUNK = 4096


# Every counter but executions and time is a metric as it is.
_PLAIN = dict(zip(COUNTERS[2:], METRIC_NAMES[3:], strict=True))


def metric_columns(counters: Sequence[str] = COUNTERS) -> dict[str, Column]:
    """Value of each metric for one sample row. Only QPS is per second. Extra counters go by their own name."""
    count = F.col("count_star").cast("double")
    plain = {_PLAIN.get(c, c): F.col(c).cast("double") for c in counters if c not in COUNTERS[:2]}
    return dict(zip(METRIC_NAMES[:3], (count, per_second(), latency()), strict=True)) | plain


def sample_metrics(samples: DataFrame, ids: Sequence[str], counters: Sequence[str] = COUNTERS) -> DataFrame:
    """A column per metric for every sample."""
    return samples.select(*ids, *[v.alias(m) for m, v in metric_columns(counters).items()])


def metric_rows(wide: DataFrame, ids: Sequence[str], counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Metric columns to rows ``(metric_ord, metric, value)``."""
    cells, names = [], metric_columns(counters)
    for i, m in enumerate(names, start=1):
        cells += [F.lit(i), F.lit(m), F.col(m)]
    return wide.select(*ids, F.stack(F.lit(len(names)), *cells).alias("metric_ord", "metric", "value"))


def metrics_long(grid: DataFrame, samples: DataFrame, counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Every metric value of every top query on every server.

    ``grid`` has a row per query and server and is broadcast by the caller, ``samples`` carry
    ``query_rank``. A query without samples on a server keeps one row per metric with NULL sample and
    value. Those rows come from an anti join with the pairs present, not from an outer join, which would
    gather a query's whole history in one task.
    """
    pair = ["query_rank", "server_id"]
    present = sample_metrics(samples, [*pair, "sample_seq"], counters).join(grid, pair)
    absent = grid.join(samples.select(*pair).distinct(), pair, "left_anti")
    rows = present.unionByName(absent, allowMissingColumns=True)
    return metric_rows(rows, ["query_rank", "query_key", "server_id", "sample_seq"], counters)


def stat_columns(counters: Sequence[str] = COUNTERS) -> list[Column]:
    """Count, and per metric sum, population deviation, minimum and maximum, in one hash aggregation."""
    stats = [F.count("*").alias("n")]
    for m, v in metric_columns(counters).items():
        stats += [
            F.sum(v).alias(f"{m}_sum"),
            F.stddev_pop(v).alias(f"{m}_sd"),
            F.min(v).alias(f"{m}_min"),
            F.max(v).alias(f"{m}_max"),
        ]
    return stats


def stat_rows(wide: DataFrame, ids: Sequence[str], counters: Sequence[str] = COUNTERS) -> DataFrame:
    """One row per metric; a key without samples has zeros."""
    cells, metrics = [], metric_columns(counters)
    for i, m in enumerate(metrics, start=1):
        cells += [f"{i}, '{m}', coalesce(try_divide({m}_sum, n), 0D)"]
        cells += [f"coalesce({m}_{stat}, 0D)" for stat in ("sd", "min", "max")]
    rows = F.expr(f"stack({len(metrics)}, {', '.join(cells)})")
    names = ("metric_ord", "metric", "avg", "stddev", "min", "max")
    return wide.select(*ids, F.expr("coalesce(n, 0L) as n"), rows.alias(*names)).select(
        *ids, "metric_ord", "metric", "n", "avg", "stddev", "min", "max"
    )


def metric_stats(
    samples: DataFrame,
    ids: Sequence[str] = ("server_id", "digest", "schema_name"),
    counters: Sequence[str] = COUNTERS,
) -> DataFrame:
    """Mean, population deviation, minimum and maximum of each metric of every key.

    Rows turn into metrics only after the aggregation, so the shuffle moves one partial row per key.
    """
    return stat_rows(samples.groupBy(*ids).agg(*stat_columns(counters)), ids, counters)


def empty_arrays(pairs: DataFrame, ids: Sequence[str], counters: Sequence[str] = COUNTERS) -> DataFrame:
    """An empty series per metric, in the form of ``metrics_arrays``."""
    cells, names = [], metric_columns(counters)
    for i, m in enumerate(names, start=1):
        cells += [F.lit(i), F.lit(m), F.array().cast("array<double>")]
    values = F.stack(F.lit(len(names)), *cells).alias("metric_ord", "metric", "values")
    return pairs.select(*ids, F.lit(0).alias("chunk_no"), values)


def metrics_arrays(
    samples: DataFrame, ids: Sequence[str], chunk: int = CHUNK, counters: Sequence[str] = COUNTERS
) -> DataFrame:
    """The value series of each metric in sample order, in arrays of at most ``chunk`` samples."""
    names = list(metric_columns(counters))
    wide = sample_metrics(samples, [*ids, "sample_seq"], counters)
    entry = F.struct("sample_seq", *names)
    series = (
        wide.withColumn("chunk_no", F.floor(F.col("sample_seq") / chunk).cast("int"))
        .groupBy(*ids, "chunk_no")
        .agg(F.array_sort(F.collect_list(entry)).alias("series"))
    )
    cells = []
    for i, m in enumerate(names, start=1):
        cells += [F.lit(i), F.lit(m), F.col("series")[m]]
    return series.select(
        *ids, "chunk_no", F.stack(F.lit(len(names)), *cells).alias("metric_ord", "metric", "values")
    )
