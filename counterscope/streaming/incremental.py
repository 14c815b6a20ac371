"""Incremental samples with Structured Streaming, for snapshots that arrive in order.

A snapshot is closed by the second newer one of its server (``open_snapshots``), whatever the time, so rows that come after that are set
aside as late and the samples then depend on the cut into batches; ``streaming.keyed`` closes by time instead. In
return duplicates are combined before the shuffle, by the operators of the batch job.

A micro-batch merges and differences with the very operators of the batch job. What it must remember of a
server are the rows of its newest snapshots, not merged yet: further rows of a snapshot that is still open join
them, rows delivered again are recognised by their ordinal and dropped, and the pairs concerned are emitted
once more. ``results`` takes the latest emission of each pair. Rows of a snapshot that is closed go to a table of
late rows with the reason; nothing vanishes.

All state is in the shared folder, so a lost executor or a restarted driver finds it again. It does not grow with the
number of batches: a batch writes the memory of the servers that arrived, and folders no server refers to are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from counterscope.operators.clean import clean, dedup, without_repeats
from counterscope.operators.deltas import deltas
from counterscope.schema import BIGINT, COUNTERS, snapshot_schema
from counterscope.session import BROADCAST_ROWS

_MARKS = "server_id int, newest int, rows_batch long, batch_id long"


@dataclass(frozen=True)
class SampleStream:
    """Where a stream reads, writes and remembers. All three folders must be shared and its own.

    ``open_snapshots`` is how many of a server's newest snapshots still take rows; older ones are late.
    """

    source: str
    output: str
    memory: str
    query_filter: str = ""
    ignore_performance_schema: bool = False
    counters: tuple[str, ...] = COUNTERS
    counter_type: T.DataType = BIGINT
    case_sensitive: bool = True
    wrap_unsigned: bool = False
    open_snapshots: int = 2

    def read(self, spark: SparkSession, max_files: int | None = None) -> DataFrame:
        reader = spark.readStream.schema(snapshot_schema(self.counters, self.counter_type))
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(self.source)

    def start(self, spark: SparkSession, max_files: int | None = None, **trigger) -> StreamingQuery:
        """Start the query; by default it takes what is there and stops."""
        return (
            self.read(spark, max_files)
            .writeStream.foreachBatch(self.take_batch)
            .option("checkpointLocation", f"{self.memory}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def take_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Difference one micro-batch and renew the memory of its servers.

        Two slots of marks take turns and other folders are named after the batch, so running a batch again
        after a failure reads the same memory and overwrites the same results.
        """
        spark = batch.sparkSession
        marks = self._marks(spark, batch_id).persist()
        try:
            self._forget(spark, marks, batch_id)
            keyed = clean(batch, self.query_filter, self.ignore_performance_schema, self.case_sensitive).drop("digest_text")
            keyed = keyed.join(_known(marks.select("server_id", "newest")), "server_id", "left").persist()
            self._take(spark, keyed, marks, batch_id)
            keyed.unpersist()
        finally:
            marks.unpersist()

    def _take(self, spark: SparkSession, keyed: DataFrame, marks: DataFrame, batch_id: int) -> None:
        late = F.coalesce(F.col("collection_seq") <= F.col("newest") - self.open_snapshots, F.lit(False))
        reason = F.lit("snapshot is closed: late or delivered again").alias("reason")
        keyed.where(late).drop("newest").select("*", reason).write.mode("overwrite").parquet(f"{self.late}/batch_id={batch_id}")

        fresh = keyed.where(~late).drop("newest")
        arrived = fresh.groupBy("server_id").agg(F.min("collection_seq").alias("touched"), F.max("collection_seq").alias("last"))
        arrived = arrived.join(marks.select("server_id", "newest"), "server_id", "left")
        arrived = arrived.withColumn("last", F.greatest("last", F.coalesce("newest", "last"))).drop("newest").persist()
        known = self._rows(spark, marks).join(_known(arrived.select("server_id")), "server_id", "left_semi")
        rows = without_repeats(known.unionByName(fresh)).join(_known(arrived), "server_id").persist()
        try:
            samples = deltas(dedup(rows, self.counters), self.counters, wrap_unsigned=self.wrap_unsigned)
            # a pair is complete here if its earlier snapshot is: those up to one before the first touched one are
            again = samples.join(_known(arrived), "server_id").where(F.col("sample_seq") >= F.col("touched") - 1)
            again.drop("touched", "last").write.mode("overwrite").parquet(f"{self.samples}/batch_id={batch_id}")
            emitted = arrived.select("server_id", "touched")
            emitted.write.mode("overwrite").parquet(f"{self.emitted}/batch_id={batch_id}")
            keep = rows.where(F.col("collection_seq") >= F.col("last") - self.open_snapshots).drop("touched", "last")
            keep.write.mode("overwrite").parquet(f"{self.memory}/rows/batch_id={batch_id}")
            old = marks.select("server_id", "newest", "rows_batch").join(_known(arrived.select("server_id")), "server_id", "left_anti")
            new = arrived.select("server_id", F.col("last").alias("newest"), F.lit(batch_id).cast("long").alias("rows_batch"))
            slot = old.unionByName(new).withColumn("batch_id", F.lit(batch_id).cast("long"))
            slot.coalesce(1).write.mode("overwrite").parquet(self._slot(batch_id))
        finally:
            rows.unpersist()
            arrived.unpersist()

    @property
    def samples(self) -> str:
        return f"{self.output}/samples"

    @property
    def late(self) -> str:
        return f"{self.output}/late"

    @property
    def emitted(self) -> str:
        return f"{self.output}/emitted"

    def results(self, spark: SparkSession) -> DataFrame:
        """The samples so far. A pair of snapshots counts as its latest emission has it, even if that is empty."""
        later = Window.partitionBy("server_id").orderBy("batch_id").rowsBetween(1, Window.unboundedFollowing)
        emitted = spark.read.parquet(self.emitted).select("server_id", "batch_id", F.min("touched").over(later).alias("again_from"))
        samples = spark.read.parquet(self.samples).join(_known(emitted), ["server_id", "batch_id"], "left")
        latest = F.col("again_from").isNull() | (F.col("sample_seq") < F.col("again_from") - 1)
        return samples.where(latest).drop("batch_id", "again_from")

    def late_rows(self, spark: SparkSession) -> DataFrame:
        """Rows that came for a closed snapshot, with the reason."""
        return spark.read.parquet(self.late).drop("batch_id")

    def _slot(self, batch_id: int) -> str:
        return f"{self.memory}/slot{batch_id % 2}"

    def _marks(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What the batch before left: a row per server with its newest snapshot and the batch its rows are in."""
        if batch_id == 0:
            return spark.createDataFrame([], _MARKS)
        stored = spark.read.schema(_MARKS).parquet(self._slot(batch_id - 1))
        checked = F.when(F.col("batch_id") == batch_id - 1, F.col("batch_id")).otherwise(
            F.raise_error(F.lit(f"memory slot does not belong to batch {batch_id - 1}")).cast("long")
        )
        return stored.withColumn("batch_id", checked).where(F.col("batch_id") >= 0)

    def _rows(self, spark: SparkSession, marks: DataFrame) -> DataFrame:
        fields = [f for f in snapshot_schema(self.counters, self.counter_type) if f.name != "digest_text"]
        schema = T.StructType([*fields, T.StructField("digest", T.StringType())])
        batches = [r["rows_batch"] for r in marks.select("rows_batch").distinct().collect()]
        if not batches:
            return spark.createDataFrame([], schema)
        paths = [f"{self.memory}/rows/batch_id={b}" for b in batches]
        stored = spark.read.schema(schema.add("batch_id", T.LongType())).option("basePath", f"{self.memory}/rows").parquet(*paths)
        own = marks.select("server_id", F.col("rows_batch").alias("batch_id"))
        return stored.join(_known(own), ["server_id", "batch_id"], "left_semi").drop("batch_id")

    def _forget(self, spark: SparkSession, marks: DataFrame, batch_id: int) -> None:
        """Delete row folders of earlier batches that no server refers to. There are few more than referred ones."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.memory}/rows")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return
        used = {r["rows_batch"] for r in marks.select("rows_batch").distinct().collect()}
        for status in files.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("batch_id=") and int(name.split("=")[1]) < batch_id and int(name.split("=")[1]) not in used:
                files.delete(status.getPath(), True)


def _known(servers: DataFrame) -> DataFrame:
    """A row per server; broadcast while these are few."""
    return F.broadcast(servers) if servers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else servers
