"""Samples from arriving snapshots, with the state kept per query and snapshots closed by event time.

Each key of a server has its own state in the state store: the snapshots it still takes rows for, merged as far as they have
come, and its last closed snapshot. A snapshot stays open until rows ``lateness_s`` seconds newer have been seen anywhere; then a timer
closes it, merges what came and pairs it with the snapshot before. Which files the rows were in, in what order these came and how they were
cut into batches then makes no difference, as long as no row is later than that. Rows that are come out as late, with
the reason, and no row goes to waste. A key that falls silent is forgotten ``keep_s`` seconds after its last snapshot was closed.

Every pair leaves once, through an exactly-once file sink. A lost executor or driver resumes from the checkpoint.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from counterscope.functions.keys import text_contains
from counterscope.operators.deltas import classified, delta_rejects, kept
from counterscope.schema import BIGINT, COUNTERS, PERFORMANCE_SCHEMA, require_ansi, snapshot_schema
from counterscope.session import ship
from counterscope.sources.collections import read_collections, stream_collections, write_collections
from counterscope.sources.snapshots import scan_keys

LATE = "snapshot is closed: late or delivered again"
# The engine drops rows behind the watermark unseen. Its clock is set ahead by this and its delay is longer by as much: the watermark
# stays what it is, and a row has to be so much too late to be dropped before it can be listed as late.
GRACE_DAYS = 100 * 365
# The server of a row that only tells the time.
CLOCK = -1
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def seen_before(seen: list[int], ordinal: int) -> bool:
    """Add an ordinal to sorted, disjoint ranges [first, last, first, last, ...]; true if it is in one already."""
    at = bisect_right(seen, ordinal)
    if at % 2 or (at and seen[at - 1] == ordinal):
        return True
    joins_left, joins_right = at > 0 and seen[at - 1] == ordinal - 1, at < len(seen) and seen[at] == ordinal + 1
    if joins_left and joins_right:
        del seen[at - 1 : at + 1]
    elif joins_left:
        seen[at - 1] = ordinal
    elif joins_right:
        seen[at] = ordinal
    else:
        seen[at:at] = [ordinal, ordinal]
    return False


class SnapshotState(StatefulProcessor):
    """State of one key: open snapshots by number, and the last closed one.

    Duplicate rows are merged as they come: rows with activity are added up; of idle ones the last counts, if
    there are no others. So the state of a snapshot is one row, however many copies a key has, and the ordinals seen as ranges.
    """

    def __init__(self, counters: tuple[str, ...], counter_type: str, keep_s: float):
        self.counters, self.counter_type = counters, counter_type
        self.keep_ms = int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = f"array<{self.counter_type}>"
        self.handle = handle
        self.open = handle.getMapState("open", "seq int", f"at long, busy {values}, idle_ordinal long, idle {values}, seen array<long>")
        self.last = handle.getValueState("last", f"seq int, at long, counts {values}")

    def due(self, at: int) -> int:
        """The watermark, in milliseconds, that closes a snapshot taken at ``at`` microseconds."""
        return -(-at // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[0] == CLOCK:
            return
        now = timerValues.getCurrentWatermarkInMs()
        touched: dict[int, list] = {}
        for row in rows:
            if self.due(row.at) <= now:
                yield self.out(key, kind="late", seq=row.collection_seq, end=row.at, ordinal=row.row_ordinal, counts=[row[c] for c in self.counters])
                continue
            seq = row.collection_seq
            if seq not in touched:
                known = self.open.getValue((seq,)) if self.open.containsKey((seq,)) else None
                touched[seq] = [known[0], _list(known[1]), known[2], _list(known[3]), _list(known[4])] if known else [row.at, None, None, None, []]
                if known is None:
                    self.handle.registerTimer(self.due(row.at))
            state = touched[seq]
            if row.at > state[0]:  # rows of a snapshot that disagree on its time: the latest counts, as in the batch job
                state[0] = row.at
                self.handle.registerTimer(self.due(row.at))
            if seen_before(state[4], row.row_ordinal):
                continue
            counts = [row[c] for c in self.counters]
            if row.count_star or row.sum_timer_wait:
                state[1] = [a + b for a, b in zip(state[1], counts)] if state[1] else counts
            elif state[2] is None or row.row_ordinal > state[2]:
                state[2], state[3] = row.row_ordinal, counts
        for seq, state in touched.items():
            if state[1] and self.counter_type == "bigint" and max(state[1]) >= 1 << 63:
                raise OverflowError(f"a counter of snapshot {seq} leaves the range of BIGINT")
            self.open.updateValue((seq,), tuple(state))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        closing = sorted((k[0], v) for k, v in list(self.open.iterator()) if self.due(v[0]) <= now)
        last = self.last.get() if self.last.exists() else None
        for seq, (at, busy, _, idle, _) in closing:
            counts = _list(busy) or _list(idle)
            if last and last[0] == seq - 1:
                yield self.out(key, kind="pair", seq=last[0], start=last[1], end=at, counts=counts, before=_list(last[2]))
            if not last or seq > last[0]:
                last = (seq, at, counts)
                self.last.update(last)
                self.handle.registerTimer(self.due(at) + self.keep_ms)
            self.open.removeKey((seq,))
        if last and self.due(last[1]) + self.keep_ms <= now:
            self.last.clear()

    def out(self, key, kind, seq, end, counts, start=None, ordinal=None, before=None) -> Row:
        return Row(kind=kind, server_id=key[0], digest=key[1], schema_name=key[2], seq=seq, start_at=start, end_at=end, ordinal=ordinal, counts=counts, before=before)

    def close(self) -> None:
        pass


def _list(values) -> list | None:
    return None if values is None else list(values)


@dataclass(frozen=True)
class StateStream:
    """Where a stream reads, writes and keeps its checkpoint, all in shared folders of its own.

    ``lateness_s``: how many seconds of event time a snapshot stays open once newer rows have come, from any server.
    ``keep_s``: how long the last snapshot of a key waits for the next; set it above the longest pause between snapshots.
    """

    source: str
    output: str
    checkpoint: str
    lateness_s: float
    keep_s: float
    query_filter: str = ""
    ignore_performance_schema: bool = False
    counters: tuple[str, ...] = COUNTERS
    counter_type: T.DataType = BIGINT
    case_sensitive: bool = True
    wrap_unsigned: bool = False

    def read(self, spark: SparkSession, max_files: int | None = None) -> DataFrame:
        reader = spark.readStream.schema(snapshot_schema(self.counters, self.counter_type))
        return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(self.source)

    def pairs(self, snapshots: DataFrame) -> DataFrame:
        """The stateful step over a stream of snapshot rows: closed pairs and late rows, told apart by ``kind``."""
        require_ansi(snapshots.sparkSession)
        ship(snapshots.sparkSession)
        mark = F.col("server_id") == CLOCK
        ahead = F.col("collected_time") + F.make_dt_interval(F.lit(GRACE_DAYS))
        delay = f"{int((self.lateness_s + GRACE_DAYS * 86400) * 1000)} milliseconds"
        timed = snapshots.withColumn("clock", ahead).withWatermark("clock", delay)
        if self.query_filter:
            timed = timed.where(text_contains("digest_text", self.query_filter, self.case_sensitive) | mark)
        if self.ignore_performance_schema:
            timed = timed.where((F.coalesce("schema_name", F.lit("")) != PERFORMANCE_SCHEMA) | mark)
        rows = scan_keys(timed).select(
            "server_id", "digest", "schema_name", "collection_seq", "row_ordinal", F.expr("unix_micros(collected_time)").alias("at"), "clock", *self.counters
        )
        kind = self.counter_type.simpleString()
        out = f"kind string, server_id int, digest string, schema_name string, seq int, start_at long, end_at long, ordinal long, counts array<{kind}>, before array<{kind}>"
        processor = SnapshotState(self.counters, kind, self.keep_s)
        return rows.groupBy("server_id", "digest", "schema_name").transformWithState(processor, out, "append", "eventTime")

    def start(
        self, spark: SparkSession, max_files: int | None = None, snapshots: DataFrame | None = None, **trigger
    ) -> StreamingQuery:
        """Start the query; by default it takes what is there and stops. ``snapshots``, a stream, replaces the files of ``source``."""
        before = spark.conf.get(_PROVIDER)
        spark.conf.set(_PROVIDER, _ROCKS)
        try:
            arriving = self.read(spark, max_files) if snapshots is None else snapshots
            writer = self.pairs(arriving).writeStream.partitionBy("kind").format("parquet").outputMode("append")
            return writer.option("checkpointLocation", self.checkpoint).trigger(**(trigger or {"availableNow": True})).start(self.output)
        finally:
            spark.conf.set(_PROVIDER, before)

    def end_mark(self, snapshots: DataFrame, number: int = 0) -> DataFrame:
        """A row that, once it has come, closes all snapshots which are in ``snapshots``. Newer ones may follow."""
        ends = snapshots.where(F.col("server_id") != CLOCK).agg(
            F.max("collected_time").alias("collected_time"), F.max("collection_seq").alias("collection_seq")
        )
        later = F.timestamp_micros(F.expr("unix_micros(collected_time)") + int(self.lateness_s * 1_000_000))
        fixed = {"server_id": F.lit(CLOCK), "collection_seq": F.col("collection_seq") + number, "row_ordinal": F.lit(0), "collected_time": later}
        schema = snapshot_schema(self.counters, self.counter_type)
        values = [fixed.get(f.name, F.lit(None if f.nullable else 0)).cast(f.dataType).alias(f.name) for f in schema]
        return ends.where("collected_time is not null").select(values)

    def close(self, spark: SparkSession) -> None:
        """Tell the stream that all snapshots which are in ``source`` are whole: the next run closes them."""
        there = spark.read.schema(snapshot_schema(self.counters, self.counter_type)).parquet(self.source)
        self.end_mark(there).write.mode("append").parquet(self.source)

    def run_collections(self, spark: SparkSession, path: str, close: bool = False) -> None:
        """Take the snapshots that have been collected in a folder; ``close`` also closes all of them.

        A Python source gets no empty batch at the end of a run, in which timers could fire that the run's own rows have made due. So
        the end mark is delivered twice: the first one moves the clock, and the run of the second one sees it.
        """
        self.start(spark, snapshots=stream_collections(spark, path, None, self.counters, self.counter_type)).awaitTermination()
        for number in range(2 if close else 0):
            there = read_collections(spark, path, self.counters, self.counter_type)
            write_collections(self.end_mark(there, number), path)
            self.start(spark, snapshots=stream_collections(spark, path, None, self.counters, self.counter_type)).awaitTermination()

    def _written(self, spark: SparkSession, kind: str) -> DataFrame:
        values = T.ArrayType(self.counter_type)
        schema = T.StructType.fromDDL("server_id int, digest string, schema_name string, seq int, start_at long, end_at long, ordinal long")
        schema = schema.add("counts", values).add("before", values).add("kind", T.StringType())
        return spark.read.schema(schema).parquet(self.output).where(F.col("kind") == kind)

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """All neighbouring pairs so far, with their ``outcome``."""
        pairs = self._written(spark, "pair").select(
            "server_id",
            "digest",
            "schema_name",
            F.col("seq").alias("sample_seq"),
            F.timestamp_micros("start_at").alias("start_time"),
            F.timestamp_micros("end_at").alias("end_time"),
            *[F.col("counts")[i].alias(c) for i, c in enumerate(self.counters)],
            *[F.col("before")[i].alias(f"before_{c}") for i, c in enumerate(self.counters)],
        )
        return classified(pairs, self.counters, wrap_unsigned=self.wrap_unsigned)

    def results(self, spark: SparkSession) -> DataFrame:
        """The samples so far, as ``deltas`` gives them."""
        return kept(self.outcomes(spark))

    def rejects(self, spark: SparkSession) -> DataFrame:
        return delta_rejects(self.outcomes(spark))

    def late_rows(self, spark: SparkSession) -> DataFrame:
        """Rows that came for a closed snapshot, with the reason."""
        return self._written(spark, "late").select(
            "server_id",
            F.col("seq").alias("collection_seq"),
            F.timestamp_micros("end_at").alias("collected_time"),
            F.col("ordinal").alias("row_ordinal"),
            "digest",
            "schema_name",
            *[F.col("counts")[i].alias(c) for i, c in enumerate(self.counters)],
            F.lit(LATE).alias("reason"),
        )
