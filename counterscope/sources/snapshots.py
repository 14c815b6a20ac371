"""Snapshot log: read, stamp, append, write."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterscope.functions.keys import portable_digest
from counterscope.schema import BIGINT, COUNTERS, digest_schema, require_columns, snapshot_schema

DIGEST = "digest"


def read_snapshot_log(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    counters: Iterable[str] = COUNTERS,
    counter_type: T.DataType = BIGINT,
    **options: str,
) -> DataFrame:
    """Read a snapshot log with its fixed schema; a log that lacks a column is refused.

    A digest that the writer stored comes along, so that the texts need not be read and hashed again.
    Self-describing files are checked by their own schema. CSV is checked by its header and JSON by its
    required fields, both at run time.
    """
    schema = snapshot_schema(counters, counter_type)
    if fmt in ("parquet", "orc"):
        log = spark.read.format(fmt).options(**options).load(path)
        require_columns(log, schema.names)
        stored = [F.col(DIGEST)] if DIGEST in log.columns else []
        return log.select([_checked(f) for f in schema] + stored)
    reader = spark.read.format(fmt).schema(schema).option("mode", "FAILFAST")
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    log = reader.options(**options).load(path)
    return log.select([_required(f.name) if not f.nullable else F.col(f.name) for f in schema])


def _checked(field: T.StructField) -> Column:
    """The field in its type, refusing NULL where the log cannot have it.

    Server and snapshot number stay plain columns, so that filters on them still prune files and row groups.
    """
    if field.nullable or field.name in ("server_id", "collection_seq"):
        return F.col(field.name).cast(field.dataType)
    return _required(field.name).cast(field.dataType).alias(field.name)


def _required(name: str) -> Column:
    present = F.col(name).isNotNull()
    return F.when(present, F.col(name)).otherwise(F.raise_error(F.lit(f"snapshot log: no {name}"))).alias(name)


def read_digest_table(
    spark: SparkSession,
    url: str,
    table: str,
    counters: Iterable[str] = COUNTERS,
    counter_type: T.DataType = BIGINT,
    **options: str,
) -> DataFrame:
    """One server's digest table over JDBC. Column choice and text filters are pushed to the server."""
    source = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    return digest_rows(source, counters, counter_type)


def digest_rows(
    source: DataFrame, counters: Iterable[str] = COUNTERS, counter_type: T.DataType = BIGINT
) -> DataFrame:
    """The digest columns of a table with any letter case and integer types; too large a counter fails."""
    lowered = source.select([F.col(c).alias(c.lower()) for c in source.columns])
    schema = digest_schema(counters, counter_type)
    require_columns(lowered, schema.names)
    return lowered.select([_checked(f) for f in schema])


def stamp_snapshot(digest_rows: DataFrame, server_id: int, seq: int, collected: datetime) -> DataFrame:
    """Turn a digest table into snapshot log rows. The ordinal keeps the order of arrival."""
    return digest_rows.select(
        F.lit(server_id).cast("int").alias("server_id"),
        F.lit(seq).cast("int").alias("collection_seq"),
        F.lit(collected).cast("timestamp").alias("collected_time"),
        F.monotonically_increasing_id().alias("row_ordinal"),
        *digest_rows.columns,
    )


def collect_round(tables: Mapping[int, DataFrame], seq: int, collected: datetime) -> DataFrame:
    """One collection round: snapshot ``seq`` of every server from its digest table."""
    return append_snapshots(stamp_snapshot(rows, server_id, seq, collected) for server_id, rows in tables.items())


def append_snapshots(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of all snapshots; duplicates stay."""
    return reduce(DataFrame.unionByName, parts)


def write_snapshot_log(snapshots: DataFrame, path: str, mode: str = "append") -> None:
    """Store the log one folder per server, ordered by snapshot inside each file, with the digest of each text.

    The rebalance hint lets AQE split a server that holds much of the data over many tasks, and the sort
    lets row groups be skipped when only the end snapshots are read.
    """
    (
        with_digest(snapshots).hint("rebalance", "server_id")
        .sortWithinPartitions("server_id", "collection_seq")
        .write.mode(mode)
        .partitionBy("server_id")
        .parquet(path)
    )


def scan_digest(snapshots: DataFrame, counters: Iterable[str] = COUNTERS) -> DataFrame:
    """The columns a collection fetches: digest, schema, text and the counters."""
    return snapshots.select(
        "server_id",
        "collection_seq",
        F.md5("digest_text").alias("md5_digest"),
        "schema_name",
        "digest_text",
        *counters,
    )


def with_digest(snapshots: DataFrame) -> DataFrame:
    """The rows with their digest, computed from the text unless it is stored."""
    return snapshots if DIGEST in snapshots.columns else snapshots.withColumn(DIGEST, portable_digest())


def scan_keys(snapshots: DataFrame) -> DataFrame:
    """Add the key columns; NULL schemas become ``''``."""
    return with_digest(snapshots).withColumn("schema_name", F.coalesce(F.col("schema_name"), F.lit("")))


def snapshot_index(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot. Build it before filtering, so that a snapshot left empty still counts."""
    return snapshots.groupBy("server_id", "collection_seq").agg(
        F.max("collected_time").alias("collected_time")
    )
