"""Incremental samples equal the batch result, survive reruns and ignore what came too late."""

import pytest
from pyspark.sql import functions as F

from counterscope.operators import clean as cl
from counterscope.operators import deltas as dl
from counterscope.schema import COUNTERS, UNSIGNED, snapshot_schema
from counterscope.streaming.incremental import SampleStream
from tests.test_deltas import busy, random_log, series

SHAPE = ("server_id", "sample_seq", "start_time", "duration_s", "digest", "schema_name", *COUNTERS)


def rows(df):
    return sorted(tuple(r) for r in df.select(*SHAPE).collect())


@pytest.fixture
def stream(tmp_path):
    return SampleStream(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/memory")


def deliver(stream, spark, df):
    df.coalesce(1).write.mode("append").parquet(stream.source)
    query = stream.start(spark)
    query.awaitTermination()
    assert query.exception() is None


def test_equals_batch_over_several_runs(spark, log, stream):
    df = random_log(log, 11, snapshots=12).cache()
    for low, high in ((1, 4), (5, 5), (6, 12)):
        deliver(stream, spark, df.where(F.col("collection_seq").between(low, high)))
    want = rows(dl.deltas(cl.collect_clean(df)))
    assert want and rows(stream.results(spark)) == want


def test_many_files_in_one_run_keep_their_order(spark, log, stream):
    df = random_log(log, 12, snapshots=6).cache()
    for seq in range(1, 7):
        df.where(F.col("collection_seq") == seq).coalesce(1).write.mode("append").parquet(stream.source)
    query = stream.start(spark, max_files=2)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 3
    assert rows(stream.results(spark)) == rows(dl.deltas(cl.collect_clean(df)))


def test_late_rows_join_open_snapshots_and_are_listed_for_closed_ones(spark, log, stream):
    df = log(series(1, 2, 3, 5, 8, 9)).cache()
    at = lambda *seqs: df.where(F.col("collection_seq").isin(*seqs))
    deliver(stream, spark, at(1, 3))
    deliver(stream, spark, at(2))  # the newest but one is still open
    deliver(stream, spark, at(3))
    deliver(stream, spark, at(6))
    deliver(stream, spark, at(4))
    assert rows(stream.results(spark)) == rows(dl.deltas(cl.collect_clean(at(1, 2, 3, 6))))
    late = stream.late_rows(spark).select("server_id", "collection_seq", "reason").collect()
    assert [tuple(r) for r in late] == [(0, 4, "snapshot is closed: late or delivered again")]


@pytest.mark.parametrize("max_files", [1, 2, None])
def test_a_snapshot_in_several_files_is_not_cut(spark, log, stream, max_files):
    df = random_log(log, 13, snapshots=4).cache()
    for seq in range(1, 5):
        for part in range(3):
            own = (F.col("collection_seq") == seq) & (F.col("row_ordinal") % 3 == part)
            df.where(own).coalesce(1).write.mode("append").parquet(stream.source)
    stream.start(spark, max_files=max_files).awaitTermination()
    assert rows(stream.results(spark)) == rows(dl.deltas(cl.collect_clean(df)))
    assert stream.late_rows(spark).isEmpty()


def test_files_delivered_again_change_nothing(spark, log, stream):
    df = random_log(log, 14, snapshots=5).cache()
    at = lambda low, high: df.where(F.col("collection_seq").between(low, high))
    at(1, 2).coalesce(1).write.mode("append").parquet(stream.source)
    deliver(stream, spark, at(1, 2))  # twice in one run
    deliver(stream, spark, at(2, 3))  # and again in another
    deliver(stream, spark, at(4, 5))
    assert rows(stream.results(spark)) == rows(dl.deltas(cl.collect_clean(df)))


def test_a_pair_that_later_rows_reject_is_withdrawn(spark, log, stream):
    first = {"count_star": 5, "sum_timer_wait": 50}
    df = log([(0, 1, "q", "s", first), (0, 2, "q", "s", {"count_star": 9, "sum_timer_wait": 90}), (0, 1, "q", "s", first)]).cache()
    deliver(stream, spark, df.where("row_ordinal < 2"))
    assert stream.results(spark).count() == 1
    deliver(stream, spark, df.where("row_ordinal = 2"))  # now 10 executions before 9: a reset
    assert stream.results(spark).isEmpty() and dl.deltas(cl.collect_clean(df)).isEmpty()


def test_unsigned_counters_and_settings(spark, log, tmp_path):
    big = 2**64 - 10
    base = log([(0, 1, "Q x", "s", {"sum_errors": 5}), (0, 2, "Q x", "s", {"sum_errors": 3})])
    grown = F.expr("cast(collection_seq as decimal(20,0))")
    wide = base.select(*[F.col(c).cast(UNSIGNED).alias(c) if c in COUNTERS else F.col(c) for c in base.columns])
    wide = wide.withColumns({"count_star": grown + F.lit(str(big)).cast(UNSIGNED), "sum_timer_wait": grown})
    wide = wide.select([F.col(f.name).cast(f.dataType) for f in snapshot_schema(COUNTERS, UNSIGNED)])
    folders = [f"{tmp_path}/{x}" for x in ("in", "out", "memory")]
    stream = SampleStream(*folders, query_filter="q X", case_sensitive=False, counter_type=UNSIGNED, wrap_unsigned=True)
    deliver(stream, spark, wide.where("collection_seq = 1"))
    deliver(stream, spark, wide.where("collection_seq = 2"))
    got = stream.results(spark).select("count_star", "sum_errors").collect()
    assert [tuple(map(int, r)) for r in got] == [(1, 2**64 - 2)]


def test_a_silent_server_keeps_its_last_snapshot(spark, log, stream):
    df = log(series(1, 2) + series(4, 7, 9, server=1)).cache()
    deliver(stream, spark, df.where("collection_seq = 1"))
    deliver(stream, spark, df.where("server_id = 1 and collection_seq > 1"))
    deliver(stream, spark, df.where("server_id = 0 and collection_seq = 2"))
    got = {(r.server_id, r.sample_seq, r.count_star) for r in stream.results(spark).collect()}
    assert got == {(0, 1, 1), (1, 1, 3), (1, 2, 2)}


def test_vanished_keys_are_forgotten(spark, log, stream):
    df = log(series(1, None, 5, text="gone") + series(1, 2, 3, text="here")).cache()
    for seq in (1, 2, 3):
        deliver(stream, spark, df.where(F.col("collection_seq") == seq))
    assert stream.results(spark).select("digest").distinct().count() == 1


def test_repeating_a_batch_changes_nothing(spark, log, stream):
    df = log(series(1, 2, 4) + series(1, 3, 9, text="b")).cache()
    for seq in (1, 2):
        stream.take_batch(df.where(F.col("collection_seq") == seq), seq - 1)
    third = df.where("collection_seq = 3")
    stream.take_batch(third, 2)
    once = rows(stream.results(spark))
    stream.take_batch(third, 2)
    assert rows(stream.results(spark)) == once == rows(dl.deltas(cl.collect_clean(df)))


def test_foreign_memory_is_refused(spark, log, stream):
    df = log(series(1, 2, 3)).cache()
    stream.take_batch(df.where("collection_seq = 1"), 0)
    with pytest.raises(Exception, match="does not belong to batch 6"):
        stream.take_batch(df.where("collection_seq = 2"), 7)


def test_filters_apply(spark, log, tmp_path):
    stream = SampleStream(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/memory", query_filter="b")
    df = log(series(1, 2) + series(1, 3, text="b"))
    deliver(stream, spark, df)
    assert [r.count_star for r in stream.results(spark).collect()] == [2]


def test_memory_does_not_grow_and_only_arriving_servers_are_written(spark, log, stream):
    df = log(series(*[busy(i) for i in range(1, 9)]) + series(3, server=7)).cache()
    for seq in range(1, 9):
        stream.take_batch(df.where(F.col("collection_seq") == seq), seq - 1)
    kept = spark.read.parquet(f"{stream.memory}/rows")
    # the silent server's batch, the last one and the one before it
    assert {r.batch_id for r in kept.select("batch_id").distinct().collect()} == {0, 6, 7}
    newest = kept.where("batch_id = 7")
    assert {(r.server_id, r.collection_seq) for r in newest.collect()} == {(0, 6), (0, 7), (0, 8)}
    assert spark.read.parquet(f"{stream.memory}/slot1").count() == 2
