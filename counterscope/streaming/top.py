"""The busiest queries of a stream of snapshots, in bounded memory.

A key's elapsed time over the period is its last value minus its first, so its last value is an upper bound. For each
server the newest snapshot is summed up by weighted Space-Saving: a summary of ``capacity`` keys whose estimates are
too high by a known error at most, and whose least estimate bounds every key that is not in it. Each task makes its own summary and summaries
are merged. Asked for the top, the few keys of the summary are recounted exactly in the log; if the n-th of them
reaches the bound nothing outside can beat it, else the whole log is ranked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from counterscope.operators.clean import clean
from counterscope.operators.deltas import at_ends_of_one, first_last
from counterscope.operators.ranking import topn
from counterscope.schema import DEFAULT_TOP_N, snapshot_schema
from counterscope.session import ship
from counterscope.sources.snapshots import scan_keys

_SUMMARY = "server_id int, collection_seq int, digest string, schema_name string, estimate double, error double, floor double"


class SpaceSaving:
    """Weights by key, at most ``capacity`` of them. A key left out weighs no more than ``floor``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.floor = 0.0
        self.weights: dict = {}
        self.heap: list = []

    def add(self, key, weight: float, error: float = 0.0) -> None:
        if key in self.weights:
            have, wrong = self.weights[key]
            self.weights[key] = have + weight, wrong + error
        else:
            # it may have been here before and been put out
            self.weights[key] = weight + self.floor, error + self.floor
            heapq.heappush(self.heap, (weight + self.floor, key))
            if len(self.weights) > self.capacity:
                self._put_out()

    def _put_out(self) -> None:
        while True:
            seen, key = self.heap[0]
            if (now := self.weights[key][0]) == seen:
                heapq.heappop(self.heap)
                del self.weights[key]
                self.floor = max(self.floor, now)
                return
            heapq.heapreplace(self.heap, (now, key))

    def merge(self, entries: list[tuple], floor: float) -> None:
        """Take in another summary: keys that only one side has may have weighed its floor on the other."""
        have = self.weights
        theirs = {key: (weight, error) for key, weight, error in entries}
        both = {key: (w + theirs.get(key, (floor, floor))[0], e + theirs.get(key, (floor, floor))[1]) for key, (w, e) in have.items()}
        both |= {key: (w + self.floor, e + self.floor) for key, (w, e) in theirs.items() if key not in have}
        self.floor += floor
        kept = heapq.nlargest(self.capacity, both.items(), key=lambda x: (x[1][0], x[0]))
        if len(both) > len(kept):
            self.floor = max(self.floor, max(w for key, (w, _) in both.items() if key not in dict(kept)))
        self.weights = dict(kept)
        self.heap = [(w, key) for key, (w, _) in kept]
        heapq.heapify(self.heap)


def _rows(server_id: int, seq: int, summary: SpaceSaving) -> list[tuple]:
    return [(server_id, seq, *key, w, e, summary.floor) for key, (w, e) in summary.weights.items()]


def summarised(rows: DataFrame, capacity: int) -> DataFrame:
    """A summary per server and snapshot of keyed rows (server_id, collection_seq, digest, schema_name, sum_timer_wait)."""
    ship(rows.sparkSession)
    names = [c.split()[0] for c in _SUMMARY.split(", ")]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summaries: dict = {}
        for batch in batches:
            for server_id, seq, digest, schema, weight in batch.itertuples(index=False):
                summaries.setdefault((server_id, seq), SpaceSaving(capacity)).add((digest, schema), float(weight))
        yield pd.DataFrame([r for key, s in summaries.items() for r in _rows(*key, s)], columns=names)

    columns = ["server_id", "collection_seq", "digest", "schema_name", "sum_timer_wait"]
    return merged_summaries(rows.select(columns).mapInPandas(partial, _SUMMARY).withColumn("part", F.spark_partition_id()), capacity)


def merged_summaries(parts: DataFrame, capacity: int) -> DataFrame:
    """Merge summaries told apart by ``part``, those of one server and snapshot."""
    names = [c.split()[0] for c in _SUMMARY.split(", ")]

    def merge(key, group: pd.DataFrame) -> pd.DataFrame:
        whole = SpaceSaving(capacity)
        for _, part in group.groupby("part"):
            entries = [((d, s), w, e) for d, s, w, e in part[["digest", "schema_name", "estimate", "error"]].itertuples(index=False)]
            whole.merge(entries, float(part["floor"].iloc[0]))
        return pd.DataFrame(_rows(*key, whole), columns=names)

    return parts.groupBy("server_id", "collection_seq").applyInPandas(merge, _SUMMARY)


@dataclass(frozen=True)
class TopStream:
    """Keeps the summary of each server's newest snapshot in ``memory``, a shared folder of its own."""

    source: str
    memory: str
    capacity: int = 1024

    def start(self, spark: SparkSession, max_files: int | None = None, **trigger) -> StreamingQuery:
        reader = spark.readStream.schema(snapshot_schema())
        log = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(self.source)
        writer = log.writeStream.foreachBatch(self.take_batch).option("checkpointLocation", f"{self.memory}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def take_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Merge the batch into the summaries. Older snapshots than the newest drop out; running a batch again writes the same."""
        spark = batch.sparkSession
        before = self._read(spark, batch_id - 1).withColumn("part", F.lit(-1))
        new = summarised(scan_keys(batch), self.capacity).withColumn("part", F.lit(0))
        both = before.unionByName(new)
        newest = both.groupBy("server_id").agg(F.max("collection_seq").alias("collection_seq"))
        current = both.join(newest, ["server_id", "collection_seq"], "left_semi")
        merged_summaries(current, self.capacity).write.mode("overwrite").parquet(self._folder(batch_id))
        path = spark._jvm.org.apache.hadoop.fs.Path(self._folder(batch_id - 2))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def _folder(self, batch_id: int) -> str:
        return f"{self.memory}/summary-{batch_id}"

    def _read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.createDataFrame([], _SUMMARY) if batch_id < 0 else spark.read.schema(_SUMMARY).parquet(self._folder(batch_id))

    def summary(self, spark: SparkSession) -> DataFrame:
        """What the last batch left: at most ``capacity`` rows a server."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.memory)
        names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
        done = [int(n.split("-")[1]) for n in names if n.startswith("summary-")]
        return self._read(spark, max(done, default=-1))

    def top(self, spark: SparkSession, log: DataFrame, server_id: int = 0, n: int = DEFAULT_TOP_N) -> DataFrame:
        """The top of the period so far, as ``topn`` gives it for the log that the stream has read."""
        own = log.where(F.col("server_id") == server_id)
        entries = self.summary(spark).where(F.col("server_id") == server_id)
        floor = entries.agg(F.max("floor")).first()[0] or 0.0
        # at most ``capacity`` keys
        keys = F.broadcast(entries.select("digest", "schema_name"))
        ends = at_ends_of_one(clean(own).join(keys, ["digest", "schema_name"], "left_semi"), own)
        best = topn(first_last(ends), n)
        found = best.agg(F.count("*"), F.min("sum_timer_wait")).first()
        # ties at the bound are decided by the key, so the bound must be exceeded
        certain = floor == 0 or (found[0] == n and found[1] > floor)
        return best if certain else topn(first_last(at_ends_of_one(clean(own), own)), n)
