"""Bounded summaries keep their bounds; streams give what the batch jobs give."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from counterscope.operators import clean as cl
from counterscope.operators import deltas as dl
from counterscope.operators import dictionary as di
from counterscope.operators.ranking import topn
from counterscope.streaming.dictionary import DictionaryStream
from counterscope.streaming.top import SpaceSaving, TopStream, summarised
from counterscope.sources.snapshots import scan_keys
from tests.test_deltas import busy, random_log


def holds(summary, truth):
    assert len(summary.weights) <= summary.capacity
    for key, n in truth.items():
        if key in summary.weights:
            estimate, error = summary.weights[key]
            assert estimate - error <= n <= estimate
        else:
            assert n <= summary.floor


@pytest.mark.parametrize("capacity", [1, 5, 20, 1000])
def test_bounds_hold_after_adding_and_merging(capacity):
    rnd = random.Random(capacity)
    for _ in range(20):
        parts, truth = [], Counter()
        for _ in range(rnd.randint(1, 4)):
            one, own = SpaceSaving(capacity), Counter()
            for _ in range(rnd.randint(0, 200)):
                key, weight = ("k", int(rnd.paretovariate(0.6)) % 60), rnd.choice([0, 1, 5, 100])
                one.add(key, weight)
                own[key] += weight
            holds(one, own)
            parts.append(one)
            truth += own
        whole = SpaceSaving(capacity)
        for one in parts:
            whole.merge([(key, *w) for key, w in one.weights.items()], one.floor)
        holds(whole, truth)
        whole.add(("k", 3), 7)
        truth[("k", 3)] += 7
        holds(whole, truth)


def top(df, server=0, n=5):
    own = df.where(F.col("server_id") == server)
    return topn(dl.first_last(dl.at_ends(cl.clean(own), own)), n).collect()


@pytest.mark.parametrize("capacity", [2, 6, 1000])
def test_the_top_equals_the_batch_job(spark, log, tmp_path, capacity):
    rnd = random.Random(7)
    totals = Counter()
    rows = []
    for seq in range(1, 5):
        for server in (0, 1):
            for k in range(25):
                totals[server, k] += rnd.randint(1, 3) * (k * k + 1)
                rows.append((server, seq, f"q{k}", "s", busy(seq * 2, totals[server, k])))
                if k % 5 == 0:  # a duplicate row of the key
                    rows.append((server, seq, f"q{k}", "s", busy(seq, totals[server, k] // 2)))
    df = log(rows).cache()
    stream = TopStream(f"{tmp_path}/in", f"{tmp_path}/memory", capacity)
    for low, high in ((1, 2), (3, 3), (4, 4)):
        df.where(F.col("collection_seq").between(low, high)).write.mode("append").parquet(stream.source)
        stream.start(spark).awaitTermination()
        seen = df.where(F.col("collection_seq") <= high)
        for server in (0, 1):
            assert stream.top(spark, seen, server).collect() == top(seen, server) != []
        assert stream.summary(spark).groupBy("server_id").count().agg(F.max("count")).first()[0] <= capacity
    assert len(list((tmp_path / "memory").glob("summary-*"))) <= 2


def test_running_a_batch_again_changes_nothing(spark, log, tmp_path):
    df = random_log(log, 61, snapshots=3).cache()
    stream = TopStream(f"{tmp_path}/in", f"{tmp_path}/memory", 4)
    for i, seq in enumerate((1, 2, 3)):
        stream.take_batch(df.where(F.col("collection_seq") == seq), i)
    first = sorted(map(tuple, stream.summary(spark).collect()))
    stream.take_batch(df.where("collection_seq = 3"), 2)
    assert sorted(map(tuple, stream.summary(spark).collect())) == first != []


def test_parts_of_a_snapshot_are_summed(spark, log):
    df = log([(0, 1, f"q{k % 3}", "s", busy(1, 10 + k)) for k in range(30)])
    got = {r.digest: r.estimate for r in summarised(scan_keys(df).repartition(4), 10).collect()}
    want = {r.digest: float(r.t) for r in scan_keys(df).groupBy("digest").agg(F.sum("sum_timer_wait").alias("t")).collect()}
    assert got == want


def test_the_dictionary_grows_with_the_stream(spark, log, tmp_path):
    df = random_log(log, 62, snapshots=6).cache()
    stream = DictionaryStream(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    written = []
    for seq in (1, 2, 3, 3, 6, 5, 4):
        df.where(F.col("collection_seq") == seq).write.mode("append").parquet(stream.source)
        stream.start(spark).awaitTermination()
        written.append(spark.read.schema("query_key string, digest_text string").parquet(stream.output).count())
    assert sorted(stream.results(spark).collect()) == sorted(di.query_dictionary(df).collect()) != []
    assert written[2] == written[3] and written[-1] == stream.entries(spark).count()  # nothing is appended twice
    assert stream.conflicts(spark).isEmpty()


def test_conflicts_come_out(spark, tmp_path):
    stream = DictionaryStream(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    rows = [("k", "one"), ("k", "two"), ("m", "same"), ("m", "same")]
    spark.createDataFrame(rows, "query_key string, digest_text string").write.parquet(stream.output)
    assert [tuple(r) for r in stream.conflicts(spark).collect()] == [("k", 2, "one", "two")]
    with pytest.raises(Exception, match="several texts"):
        stream.conflicts(spark, strict=True).collect()
