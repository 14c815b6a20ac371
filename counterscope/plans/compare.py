"""Compare the busiest queries of one server across several."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterscope.operators.clean import clean, dedup
from counterscope.operators.deltas import at_ends_of_one, deltas, first_last
from counterscope.operators.dictionary import texts_of
from counterscope.operators.metrics import (
    CHUNK,
    empty_arrays,
    metric_stats,
    metrics_arrays,
    metrics_long,
    stat_columns,
    stat_rows,
)
from counterscope.operators.ranking import topn
from counterscope.schema import COUNTERS, DEFAULT_TOP_N
from counterscope.session import counted_side, materialized, small_side


@dataclass(frozen=True)
class Comparison:
    """A comparison over a snapshot log. ``server_ids`` come in report order; the first one ranks."""

    snapshots: DataFrame
    server_ids: tuple[int, ...]
    top_n: int = DEFAULT_TOP_N
    query_filter: str = ""
    ignore_performance_schema: bool = False
    counters: tuple[str, ...] = COUNTERS
    case_sensitive: bool = True
    wrap_unsigned: bool = False

    @property
    def base_server(self) -> int:
        return self.server_ids[0]

    def cleaned(self) -> DataFrame:
        log = self.snapshots.where(F.col("server_id").isin(*self.server_ids))
        return clean(log, self.query_filter, self.ignore_performance_schema, self.case_sensitive)

    def base_log(self) -> DataFrame:
        return self.snapshots.where(F.col("server_id") == self.base_server)

    def period(self) -> DataFrame:
        """First-to-last activity of the base server only; the other servers' rows are not read."""
        own = self.base_log()
        filtered = clean(own, self.query_filter, self.ignore_performance_schema, self.case_sensitive)
        return first_last(at_ends_of_one(filtered, own), self.counters, self.wrap_unsigned)

    @cached_property
    def top_keys(self) -> DataFrame:
        """At most ``top_n`` rows, found once: ranking reads the whole log of the base server."""
        return materialized(topn(self.period(), self.top_n))

    @cached_property
    def top_texts(self) -> DataFrame:
        """The top keys with their texts, which the end snapshots that ranked them must contain."""
        own = self.base_log()
        return materialized(texts_of(small_side(self.top_keys, self.top_n), at_ends_of_one(own, own)))

    def samples(self) -> DataFrame:
        """Samples of the top keys on every server.

        The few keys filter the log at the scan, so only their rows are shuffled and sorted, and from
        there on the rank stands for the key.
        """
        ranks = small_side(self.top_keys.select("digest", "schema_name", "query_rank"), self.top_n)
        rows = self.cleaned().join(ranks, ["digest", "schema_name"])
        by_rank = ("query_rank",)
        return deltas(dedup(rows, self.counters, by_rank), self.counters, by_rank, self.wrap_unsigned)

    def grid(self) -> DataFrame:
        """Each top key on each server, present there or not: ``top_n`` times servers rows."""
        servers = F.array(*[F.lit(i) for i in self.server_ids])
        return self.top_keys.select(
            "query_rank", "query_key", F.explode(servers).alias("server_id")
        )

    def values(self) -> DataFrame:
        grid = small_side(self.grid(), self.top_n * len(self.server_ids))
        return metrics_long(grid, materialized(self.samples()), self.counters)

    def arrays(self, chunk: int = CHUNK) -> DataFrame:
        """Value series; a key that is absent on a server has one empty series per metric."""
        pair = ["query_rank", "server_id"]
        samples = materialized(self.samples())
        series = metrics_arrays(samples, pair, chunk, self.counters)
        absent = self.grid().join(samples.select(*pair).distinct(), pair, "left_anti")
        return series.unionByName(empty_arrays(absent.select(*pair), pair, self.counters))

    def metrics(self) -> DataFrame:
        """Long form: one row per query, server and metric."""
        stats = self.samples().groupBy("query_rank", "server_id").agg(*stat_columns(self.counters))
        present = self.grid().join(stats, ["query_rank", "server_id"], "left")
        return stat_rows(present, ["query_rank", "query_key", "server_id"], self.counters)

    def wide(self) -> DataFrame:
        """Servers side by side: ``n_<id>``, ``avg_<id>`` and ``stddev_<id>`` per server."""
        return side_by_side(self.metrics(), self.server_ids)


def side_by_side(metrics: DataFrame, server_ids: Sequence[int]) -> DataFrame:
    ids = ["query_rank", "query_key", "metric_ord", "metric"]
    cells = ("n", "avg", "stddev")
    pivoted = (
        metrics.groupBy(*ids)
        .pivot("server_id", list(server_ids))
        .agg(*[F.max(c).alias(c) for c in cells])
    )
    return pivoted.select(*ids, *[F.col(f"{s}_{c}").alias(f"{c}_{s}") for s in server_ids for c in cells])


def compare_servers(
    snapshots: DataFrame,
    server_ids: Sequence[int],
    top_n: int = DEFAULT_TOP_N,
    query_filter: str = "",
    ignore_performance_schema: bool = False,
    **settings,
) -> DataFrame:
    """Mean and spread of the metrics of the busiest queries, one row per query and metric.

    ``settings`` are the other ones of ``Comparison``: counters, case_sensitive, wrap_unsigned.
    """
    return Comparison(
        snapshots, tuple(server_ids), top_n, query_filter, ignore_performance_schema, **settings
    ).wide()


def profile_server(snapshots: DataFrame, server_id: int, top_n: int = DEFAULT_TOP_N, **settings) -> DataFrame:
    """The same report for one server."""
    return compare_servers(snapshots, [server_id], top_n, **settings)


def compare_pct(wide: DataFrame, server_ids: Sequence[int]) -> DataFrame:
    """Percentage by which each server's mean differs from the first server's; NULL when that is zero."""
    base = F.col(f"avg_{server_ids[0]}")
    others = [
        (F.try_divide(F.col(f"avg_{s}") - base, base) * 100).alias(f"pct_{s}") for s in server_ids[1:]
    ]
    return wide.select("query_rank", "query_key", "metric_ord", "metric", base, *others)


def all_key_stats(
    snapshots: DataFrame, counters: Sequence[str] = COUNTERS, wrap_unsigned: bool = False
) -> DataFrame:
    """Statistics of every key on every server."""
    samples = deltas(dedup(clean(snapshots), counters), counters, wrap_unsigned=wrap_unsigned)
    return metric_stats(samples, counters=counters)


def error_detail(statements: DataFrame, keys: DataFrame) -> DataFrame:
    """Errors and warnings of the top keys by error number, from a statement history.

    ``statements`` has ``server_id, digest, schema_name, errno, errors, warnings``. A key without any keeps one row
    with NULL server and number and zero counts.
    """
    wanted = counted_side(keys.select("digest", "schema_name"))
    found = (
        statements.where((F.col("errors") > 0) | (F.col("warnings") > 0))
        .join(wanted, ["digest", "schema_name"], "left_semi")
        .groupBy("server_id", "digest", "schema_name", "errno")
        .agg(
            F.count("*").alias("n_statements"),
            F.sum("errors").alias("errors"),
            F.sum("warnings").alias("warnings"),
        )
    )
    listed = keys.select("query_rank", "digest", "schema_name", "query_key")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_statements", "errors", "warnings")]
    return listed.join(found, ["digest", "schema_name"], "left").select(
        "query_rank", "query_key", "server_id", "errno", *counts
    )
