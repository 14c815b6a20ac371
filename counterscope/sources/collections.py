"""Snapshots as they are collected: a data source with a partition per server and snapshot.

``write_collections`` stores rounds of snapshots in a folder, one folder per server and snapshot, and then lists them in
a manifest; only what a manifest lists is there. The source ``collections`` reads them, as a table or as a stream:

* A batch read plans one partition per snapshot. Filters on server and snapshot number leave out whole partitions, and
  a filter on the statement's text is applied where the file is read, before a row reaches Spark.
* A stream's offset is the last snapshot number of each server, so it goes on after the snapshots it has had,
  whatever else lies in the folder; a server that lags behind does not hold up the others.

Needs a folder that pyarrow can open (local, hdfs://, s3://, gs://) and, for pruning, spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
)

from counterscope.schema import BIGINT, COUNTERS, snapshot_schema
from counterscope.session import ship
from counterscope.sources.files import listed, opened, read_text, write_text

NAME = "collections"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_MANIFESTS = "_manifests"


def write_collections(snapshots: DataFrame, path: str) -> None:
    """Add the snapshots of a log to a folder. They appear together, once all of their files are written."""
    spark = snapshots.sparkSession
    batch = uuid.uuid4().hex
    stored = f"{path}/{batch}"
    names = ("server_id", "collection_seq")
    folders = [f"of_{n}" for n in names]
    # a snapshot is one file, unless it is large enough to be split
    rows = snapshots.select("*", *[F.col(n).alias(f) for n, f in zip(names, folders)]).hint("rebalance", *names)
    rows.write.partitionBy(*folders).parquet(stored)
    there = spark.read.parquet(stored).select(*folders, F.col("_metadata.file_path").alias("file")).distinct().collect()
    lines = [json.dumps({"server_id": r[0], "collection_seq": r[1], "file": r.file}) for r in there]
    files, at = opened(f"{path}/{_MANIFESTS}")
    files.create_dir(at, recursive=True)
    write_text(f"{path}/{_MANIFESTS}/{batch}.jsonl", "\n".join(lines))


def snapshot_files(path: str) -> dict[tuple[int, int], list[str]]:
    """Files by (server, snapshot), of everything the manifests list."""
    found: dict[tuple[int, int], list[str]] = {}
    for info in listed(f"{path}/{_MANIFESTS}"):
        if info.base_name.endswith(".jsonl"):
            for line in filter(None, read_text(f"{path}/{_MANIFESTS}/{info.base_name}").split("\n")):
                entry = json.loads(line)
                found.setdefault((entry["server_id"], entry["collection_seq"]), []).append(entry["file"])
    return found


@dataclass
class SnapshotFiles(InputPartition):
    server_id: int
    collection_seq: int
    files: tuple[str, ...]


_COMPARED = {
    EqualTo: lambda have, value: have == value,
    GreaterThan: lambda have, value: have > value,
    GreaterThanOrEqual: lambda have, value: have >= value,
    LessThan: lambda have, value: have < value,
    LessThanOrEqual: lambda have, value: have <= value,
    In: lambda have, value: have in value,
}


def _batches(part: SnapshotFiles | None, schema: pa.Schema, texts: list[str]) -> Iterator[pa.RecordBatch]:
    for file in part.files if part else ():  # without any snapshot Spark plans one partition of nothing
        files, at = opened(file)
        for batch in ds.dataset(at, format="parquet", filesystem=files).to_batches(columns=schema.names):
            for text in texts:
                batch = batch.filter(pc.match_substring(batch.column("digest_text"), text))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(schema.field(n).type) for n in schema.names], schema=schema)


class CollectionReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema
        self.kept: list[Filter] = []
        self.texts: list[str] = []

    def pushFilters(self, filters: list[Filter]):
        """Take what decides whole snapshots, and texts; the rest stays with Spark."""
        for one in filters:
            name = getattr(one, "attribute", ())
            if type(one) in _COMPARED and name in (("server_id",), ("collection_seq",)):
                self.kept.append(one)
            elif isinstance(one, StringContains) and name == ("digest_text",):
                self.texts.append(one.value)
            else:
                yield one

    def partitions(self) -> list[SnapshotFiles]:
        def wanted(key: tuple[int, int]) -> bool:
            own = dict(zip(("server_id", "collection_seq"), key))
            return all(_COMPARED[type(f)](own[f.attribute[0]], f.value) for f in self.kept)

        return [SnapshotFiles(*key, tuple(files)) for key, files in sorted(snapshot_files(self.path).items()) if wanted(key)]

    def read(self, partition: SnapshotFiles) -> Iterator[pa.RecordBatch]:
        return _batches(partition, _arrow(self.schema), self.texts)


class CollectionStream(DataSourceStreamReader):
    """Offsets are the last snapshot number of each server that was read."""

    def __init__(self, path: str, schema: T.StructType, first: dict):
        self.path, self.schema, self.first = path, schema, first

    def initialOffset(self) -> dict:
        return dict(self.first)

    def latestOffset(self) -> dict:
        newest: dict[str, int] = {}
        for server_id, seq in snapshot_files(self.path):
            newest[str(server_id)] = max(seq, newest.get(str(server_id), seq))
        return newest or dict(self.first)

    def partitions(self, start: dict, end: dict) -> list[SnapshotFiles]:
        def new(server_id: int, seq: int) -> bool:
            name = str(server_id)
            return name in end and seq <= end[name] and (name not in start or seq > start[name])

        found = sorted(snapshot_files(self.path).items())
        return [SnapshotFiles(*key, tuple(files)) for key, files in found if new(*key)]

    def read(self, partition: SnapshotFiles) -> Iterator[pa.RecordBatch]:
        return _batches(partition, _arrow(self.schema), [])

    def commit(self, end: dict) -> None:
        pass


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Collections(DataSource):
    """Options: ``path``; for a stream ``after``, a JSON object with the snapshot number of each server to go on from."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return snapshot_schema()

    def reader(self, schema: T.StructType) -> CollectionReader:
        return CollectionReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> CollectionStream:
        return CollectionStream(self.options["path"], schema, json.loads(self.options.get("after", "{}")))


def _registered(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(Collections)
    spark.conf.set(_PUSHDOWN, "true")
    return spark


def read_collections(spark: SparkSession, path: str, counters: tuple[str, ...] = COUNTERS, counter_type: T.DataType = BIGINT) -> DataFrame:
    """All snapshots in the folder, as rows of a snapshot log."""
    return _registered(spark).read.format(NAME).schema(snapshot_schema(counters, counter_type)).load(path)


def stream_collections(
    spark: SparkSession, path: str, after: dict[int, int] | None = None, counters: tuple[str, ...] = COUNTERS, counter_type: T.DataType = BIGINT
) -> DataFrame:
    """Snapshots as they arrive, from the one after ``after`` (by server) on."""
    first = json.dumps({str(k): v for k, v in (after or {}).items()})
    reader = _registered(spark).readStream.format(NAME).schema(snapshot_schema(counters, counter_type))
    return reader.option("after", first).load(path)
