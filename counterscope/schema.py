"""Column contracts shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The ten cumulative counters, in the order the digest table reports them.
COUNTERS = (
    "count_star",
    "sum_timer_wait",
    "sum_errors",
    "sum_warnings",
    "sum_rows_affected",
    "sum_rows_sent",
    "sum_rows_examined",
    "sum_select_scan",
    "sum_no_index_used",
    "sum_no_good_index_used",
)

# The sum-type counters of the digest table outside the default ten. Any of them can be
# appended to COUNTERS and passed to the operators. Minimum, maximum and average timers and the
# first/last seen times are left out because two readings of them have no meaningful difference.
EXTRA_COUNTERS = (
    "sum_lock_time",
    "sum_created_tmp_disk_tables",
    "sum_created_tmp_tables",
    "sum_select_full_join",
    "sum_select_full_range_join",
    "sum_select_range",
    "sum_select_range_check",
    "sum_sort_merge_passes",
    "sum_sort_range",
    "sum_sort_rows",
    "sum_sort_scan",
)

# Metric names in report order.
METRIC_NAMES = (
    "queries",
    "QPS",
    "Latency",
    "errors",
    "warnings",
    "RowsAffected",
    "RowsSent",
    "RowsExamined",
    "SelectScans",
    "NoIndexUsed",
    "NoGoodIndex",
)

KEY = ("digest", "schema_name")

# Default settings of a comparison.
DEFAULT_TOP_N = 5
PERFORMANCE_SCHEMA = "performance_schema"


# Counters are unsigned 64-bit at the source. BIGINT holds all but absurd totals; a log that has larger ones
# is read with UNSIGNED, which every operator accepts too.
BIGINT = T.LongType()
UNSIGNED = T.DecimalType(20, 0)


def digest_schema(counters: Iterable[str] = COUNTERS, counter_type: T.DataType = BIGINT) -> T.StructType:
    """One row of a server's digest table."""
    fields = [
        T.StructField("schema_name", T.StringType(), True),
        T.StructField("digest_text", T.StringType(), True),
    ]
    fields += [T.StructField(c, counter_type, False) for c in counters]
    return T.StructType(fields)


def snapshot_schema(counters: Iterable[str] = COUNTERS, counter_type: T.DataType = BIGINT) -> T.StructType:
    """One row of the snapshot log: a digest row stamped with server, snapshot number and time."""
    stamp = [
        T.StructField("server_id", T.IntegerType(), False),
        T.StructField("collection_seq", T.IntegerType(), False),
        T.StructField("collected_time", T.TimestampType(), False),
        T.StructField("row_ordinal", T.LongType(), False),
    ]
    return T.StructType(stamp + digest_schema(counters, counter_type).fields)


def require_ansi(spark: SparkSession) -> None:
    """Refuse a session in which integer sums wrap instead of failing."""
    if spark.conf.get("spark.sql.ansi.enabled", "true").lower() != "true":
        raise ValueError("counters must not wrap: set spark.sql.ansi.enabled to true")


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """Fail while the plan is built, not at run time, when an input lacks columns."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns: {', '.join(missing)}")
    return df
