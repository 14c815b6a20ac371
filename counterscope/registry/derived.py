"""Snapshot logs derived from the shared test tables.

The tables hold single events, so each day (or month) becomes a snapshot of running totals. Events are
summed per day before anything is ordered; the running totals then see one row per key and day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterscope.schema import COUNTERS, EXTRA_COUNTERS
from counterscope.session import shared_folder
from counterscope.sources.snapshots import read_snapshot_log, write_snapshot_log

EVENT_SERVERS = (0, 1)
LINEITEM_SERVERS = (0, 1, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc_instant(wall_clock: str) -> Column:
    """The instant whose UTC clock shows the given zone-free time, whatever the session's zone."""
    return F.from_utc_timestamp(F.col(wall_clock).cast("timestamp"), F.current_timezone())


def utc_clock(instant: str) -> Column:
    """The zone-free time a UTC clock shows at an instant."""
    return F.to_utc_timestamp(F.col(instant), F.current_timezone()).cast("timestamp_ntz")


def _when(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _number_snapshots(totals: DataFrame) -> DataFrame:
    """Number each server's snapshots in a table of its own, which has one row per snapshot, and join back."""
    order = Window.partitionBy("server_id").orderBy("collected_time")
    numbers = (
        totals.select("server_id", "collected_time")
        .distinct()
        .withColumn("collection_seq", F.row_number().over(order))
    )
    return totals.join(numbers, ["server_id", "collected_time"])


def _running(totals: DataFrame, parts: list[str], counters: list[str]) -> DataFrame:
    so_far = (
        Window.partitionBy(*parts)
        .orderBy("collected_time")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return totals.withColumns({c: F.sum(c).over(so_far).cast("bigint") for c in counters})


def _in_log_order(df: DataFrame, counters: list[str]) -> DataFrame:
    return df.select(
        F.col("server_id").cast("int").alias("server_id"),
        F.col("collection_seq").cast("int").alias("collection_seq"),
        utc_instant("collected_time").alias("collected_time"),
        F.col("row_ordinal").cast("bigint").alias("row_ordinal"),
        "schema_name",
        "digest_text",
        *counters,
    )


def event_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as one executed statement."""
    schema = (
        F.when(F.col("user_id") % 7 == 0, F.lit(None).cast("string"))
        .when(F.col("user_id") % 7 == 1, "performance_schema")
        .otherwise(F.concat(F.lit("app"), (F.col("user_id") % 3).cast("string")))
    )
    text = F.when(
        F.col("event_id") % 97 != 0, F.concat(F.lit("SELECT "), "event_type", F.lit(" WHERE k = ?"))
    )
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 2).cast("int").alias("server_id"),
        schema.alias("schema_name"),
        text.alias("digest_text"),
        (F.col("event_id") % 2).cast("int").alias("row_ordinal"),
        F.date_trunc("day", "ts").alias("collected_time"),
        "ts",
        (F.round(F.col("value") * 100).cast("bigint") * 10000000).alias("timer_ps"),
        "event_type",
        F.col("value").alias("v"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )


def event_snapshots(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """Two servers, a snapshot a day, two rows per key (by event parity); totals can skip days and fall."""
    k, v = F.col("k"), F.col("v")
    sums = {
        "count_star": F.count("*"),
        "sum_timer_wait": F.sum("timer_ps"),
        "sum_errors": _when(v > 40),
        "sum_warnings": _when(v > 20),
        "sum_rows_affected": _when(F.col("event_type") == "purchase"),
        "sum_rows_sent": F.sum(k),
        "sum_rows_examined": F.sum(3 * k),
        "sum_select_scan": _when(k % 2 == 0),
        "sum_no_index_used": _when(k < 20),
        "sum_no_good_index_used": _when(k == 7),
    }
    if extra:
        sums |= {c: _when(k % (i + 2) == 0) for i, c in enumerate(EXTRA_COUNTERS)}
    parts = ["server_id", "schema_name", "digest_text", "row_ordinal"]
    totals = (
        event_statements(spark, sf_dir)
        .groupBy(*parts, "collected_time")
        .agg(*[s.alias(c) for c, s in sums.items()])
    )
    counters = list(sums)
    return _in_log_order(_running(_number_snapshots(totals), parts, counters), counters)


def idle_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event snapshots with some rows' activity counters emptied, one or both rows of a key."""
    day = F.dayofmonth(utc_clock("collected_time"))
    idle = (day % 3 == F.col("row_ordinal")) | (day % 5 == 0)
    log = event_snapshots(spark, sf_dir)
    return log.withColumns({c: F.when(idle, 0).otherwise(F.col(c)) for c in COUNTERS[:2]})


def lineitem_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three servers, a snapshot a month, a key per supplier and line status; counts grow with the data."""
    server = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    sums = {
        "count_star": F.count("*"),
        "sum_timer_wait": F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint") * 1000000),
        "sum_rows_sent": F.sum(F.col("l_quantity").cast("bigint")),
    }
    totals = (
        table(spark, sf_dir, "lineitem")
        .select(
            server.alias("server_id"),
            F.date_trunc("month", "l_shipdate").alias("collected_time"),
            F.col("l_linestatus").alias("schema_name"),
            "l_suppkey",
            "l_extendedprice",
            "l_quantity",
        )
        .groupBy("server_id", "collected_time", "schema_name", "l_suppkey")
        .agg(*[s.alias(c) for c, s in sums.items()])
    )
    parts = ["server_id", "schema_name", "l_suppkey"]
    running = _running(_number_snapshots(totals), parts, list(sums))
    text = F.concat(F.lit("SUPP "), F.col("l_suppkey").cast("string"))
    absent = {c: F.lit(0).cast("bigint") for c in COUNTERS if c not in sums}
    filled = running.withColumns({"digest_text": text, "row_ordinal": F.lit(0), **absent})
    return _in_log_order(filled, list(COUNTERS))


_stored: dict[tuple[str, str, str], str] = {}


def _stored_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A log is derived and written once a session, as its users would keep it; queries then read the stored one."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _stored:
        path = shared_folder(spark, name)
        write_snapshot_log(build(spark, sf_dir), path)
        _stored[key] = path
    return read_snapshot_log(spark, _stored[key])


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_once(spark, sf_dir, "event-log", event_snapshots)


def stored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_once(spark, sf_dir, "lineitem-log", lineitem_snapshots)


def event_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The servers the events came from."""
    seen = event_statements(spark, sf_dir).select("server_id").distinct()
    number = (F.col("server_id") + 1).cast("string")
    return seen.select(
        "server_id",
        F.concat(
            F.lit("user:password@tcp(metric"), number, F.lit(".example.com:3306)/performance_schema")
        ).alias("dsn"),
        F.when(F.col("server_id") == 0, "8.0.31-log").otherwise("8.4.2-log").alias("version"),
    )


def customer_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server per customer, with every form of connection string."""
    key = F.col("c_custkey")
    n = key.cast("string")
    segment = F.lower("c_mktsegment")
    dsn = (
        F.when(key % 6 == 0, F.concat(F.lit("app"), n, F.lit(":secret@tcp(db"), n, F.lit(".example.com:3306)/performance_schema")))
        .when(key % 6 == 1, F.concat(F.lit("app"), n, F.lit(":secret@tcp(db"), n, F.lit(".example.com:3307)/performance_schema")))
        .when(key % 6 == 2, F.concat(F.lit("root:secret@host"), n, F.lit(":3306")))
        .when(key % 6 == 3, F.concat(F.lit("admin@tcp(db"), n, F.lit(".example.com)/performance_schema")))
        .when(key % 6 == 4, F.concat(F.lit("reporting_user_"), n, F.lit(":secret@tcp("), segment, F.lit("-replica.internal.example.com:3306)/x")))
        .otherwise(F.concat(F.lit("u"), n))
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("server_id"),
        dsn.alias("dsn"),
        F.concat(F.lit("5.7."), (key % 40).cast("string")).alias("version"),
        (key * 37 % 86400).alias("uptime_s"),
    )


def errors_by_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement history with error numbers, for the error detail report."""
    errno = F.when(F.col("v") > 80, 1205).when(F.col("v") > 40, 1213).otherwise(0)
    return event_statements(spark, sf_dir).select(
        "server_id",
        "schema_name",
        "digest_text",
        errno.alias("errno"),
        F.when(F.col("v") > 40, 1).otherwise(0).alias("errors"),
        F.when(F.col("v") > 20, 1).otherwise(0).alias("warnings"),
    )




def timed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement history with error numbers and times of execution.

    A day's statements are in the snapshot that bears its date; to have run before it they are dated back by a day.
    """
    errno = F.when(F.col("v") > 80, 1205).when(F.col("v") > 40, 1213).otherwise(0)
    earlier = F.expr("ts - INTERVAL 1 DAY")
    return event_statements(spark, sf_dir).withColumn("ts", earlier).select(
        "server_id",
        "schema_name",
        "digest_text",
        utc_instant("ts").alias("executed_at"),
        errno.alias("errno"),
        F.when(F.col("v") > 40, 1).otherwise(0).alias("errors"),
        F.when(F.col("v") > 20, 1).otherwise(0).alias("warnings"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event snapshots, taken at the end of each day, with the records of each key: least and greatest time, first and last seen."""
    parts = ["server_id", "schema_name", "digest_text", "row_ordinal"]
    totals = (
        event_statements(spark, sf_dir)
        .groupBy(*parts, "collected_time")
        .agg(
            F.count("*").alias("count_star"),
            F.sum("timer_ps").alias("sum_timer_wait"),
            F.min("timer_ps").alias("min_timer_wait"),
            F.max("timer_ps").alias("max_timer_wait"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )
    so_far = Window.partitionBy(*parts).orderBy("collected_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    records = {c: F.min(c).over(so_far) for c in ("min_timer_wait", "first_seen")} | {c: F.max(c).over(so_far) for c in ("max_timer_wait", "last_seen")}
    running = _running(_number_snapshots(totals).withColumns(records), parts, ["count_star", "sum_timer_wait"])
    times = {c: utc_instant(c) for c in ("first_seen", "last_seen")}
    return running.withColumns({**times, "collected_time": utc_instant("collected_time") + F.expr("INTERVAL 1 DAY")})
