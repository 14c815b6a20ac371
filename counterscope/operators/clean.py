"""Filters and the duplicate merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterscope.functions.keys import IS_EMPTY, is_empty, query_key, text_contains, with_text
from counterscope.schema import COUNTERS, KEY, PERFORMANCE_SCHEMA, require_ansi
from counterscope.sources.snapshots import scan_keys, snapshot_index


def filter_text(df: DataFrame, query_filter: str = "", case_sensitive: bool = True) -> DataFrame:
    """Keep statements whose text matches; without a filter rows with NULL text stay too."""
    if not query_filter:
        return df
    return df.where(text_contains("digest_text", query_filter, case_sensitive))


def filter_schema(df: DataFrame, ignore_performance_schema: bool = False) -> DataFrame:
    """Drop the server's own monitoring statements. Rows with a NULL schema stay."""
    if not ignore_performance_schema:
        return df
    return df.where(F.coalesce(F.col("schema_name"), F.lit("")) != PERFORMANCE_SCHEMA)


def clean(
    snapshots: DataFrame,
    query_filter: str = "",
    ignore_performance_schema: bool = False,
    case_sensitive: bool = True,
) -> DataFrame:
    """Filtered snapshot rows with key columns, duplicates not merged yet."""
    require_ansi(snapshots.sparkSession)
    kept = filter_text(snapshots, query_filter, case_sensitive)
    return filter_schema(scan_keys(kept), ignore_performance_schema)


def merged(counter: str, among: str = "true") -> Column:
    """Value of a counter after merging duplicate rows of one key.

    Rows with activity are added up and idle rows ignored. When all rows are idle the last one counts; its
    two activity counters are zero by definition, so only the others need looking up. ``among`` limits the
    merge to some of the group's rows; the result is NULL when none qualify.
    """
    busy = f"sum(if({among} and not {IS_EMPTY}, {counter}, null))"
    if counter in ("count_star", "sum_timer_wait"):
        idle = f"max(if({among}, 0L, null))"
    else:
        alone = f"{among} and {IS_EMPTY}"
        idle = f"max_by(if({alone}, {counter}, null), if({alone}, row_ordinal, null))"
    return F.expr(f"coalesce({busy}, {idle})")


def dedup(keyed: DataFrame, counters: Sequence[str] = COUNTERS, key: Sequence[str] = KEY) -> DataFrame:
    """One row per server, snapshot and key.

    The sums combine on the map side, so copies of one key, however many, shrink before the shuffle.
    """
    require_ansi(keyed.sparkSession)
    rows = keyed.groupBy("server_id", "collection_seq", *key).agg(
        F.max("collected_time").alias("collected_time"),
        *[merged(c).alias(c) for c in counters],
    )
    return rows.select("server_id", "collection_seq", "collected_time", *with_text(key), *counters)


def collect_clean(
    snapshots: DataFrame,
    query_filter: str = "",
    ignore_performance_schema: bool = False,
    counters: Sequence[str] = COUNTERS,
    case_sensitive: bool = True,
) -> DataFrame:
    """Scan, filter and merge in one go."""
    return dedup(clean(snapshots, query_filter, ignore_performance_schema, case_sensitive), counters)


def without_repeats(keyed: DataFrame) -> DataFrame:
    """Drop rows delivered again: a row is known by server, snapshot, key and its ordinal."""
    return keyed.dropDuplicates(["server_id", "collection_seq", *KEY, "row_ordinal"])


def dedup_audit(keyed: DataFrame) -> DataFrame:
    """Keys that had duplicate rows in a snapshot, and what the merge did with them."""
    counts = keyed.groupBy("server_id", "collection_seq", "digest", "schema_name").agg(
        F.count_if(is_empty()).alias("n_empty"),
        F.count_if(~is_empty()).alias("n_busy"),
    )
    branch = (
        F.when(F.col("n_busy") > 1, "added")
        .when(F.col("n_busy") == 1, "kept_busy_row")
        .otherwise("kept_last_empty_row")
    )
    return counts.where(F.col("n_empty") + F.col("n_busy") > 1).select(
        "server_id",
        "collection_seq",
        query_key().alias("query_key"),
        "n_empty",
        "n_busy",
        branch.alias("branch"),
    )


def collection_rows(deduped: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of each snapshot after the merge, zero for a snapshot that the filters emptied."""
    filled = deduped.groupBy("server_id", "collection_seq").agg(F.count("*").alias("n_rows"))
    return index.join(filled, ["server_id", "collection_seq"], "left").select(
        "server_id", "collection_seq", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def collection_sizes(rows: DataFrame) -> DataFrame:
    """Per server: number of snapshots, and rows of the first and the last one."""
    return rows.groupBy("server_id").agg(
        F.count("*").alias("n_collections"),
        F.min_by("n_rows", "collection_seq").alias("first_rows"),
        F.max_by("n_rows", "collection_seq").alias("last_rows"),
    )


def sample_counts(snapshots: DataFrame) -> DataFrame:
    """Samples per server: one fewer than its snapshots, whether or not a sample has rows."""
    return (
        snapshot_index(snapshots)
        .groupBy("server_id")
        .agg((F.count("*") - 1).alias("n_samples"))
    )
