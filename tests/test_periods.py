"""Intervals, restarts, rollups and records against plain Python."""

import random
import statistics
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from counterscope.operators import clean as cl
from counterscope.operators import deltas as dl
from counterscope.operators.intervals import error_detail_by_sample, join_intervals
from counterscope.operators.metrics import metric_stats
from counterscope.operators.records import merge_records, record_deltas
from counterscope.operators.rollup import combined, period_stats, rollup, stats_of
from counterscope.operators.segments import period_segmented
from counterscope.schema import COUNTERS
from tests.test_deltas import busy, random_log, series

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(us):
    return START + timedelta(microseconds=us)


# Intervals


@pytest.mark.parametrize("seed", range(3))
def test_events_meet_all_their_intervals(spark, seed):
    rnd = random.Random(seed)
    lengths = [0, 1, 2, 3, 1000, 1024, 10**6, 10**9, 4 * 10**12]
    intervals = []
    for i in range(120):
        low = rnd.randint(-(10**9), 10**9)
        intervals.append((rnd.choice("ab"), i, at(low), at(low + rnd.choice(lengths) + rnd.choice([0, 0, 1]))))
    edges = [t for x in intervals for t in x[2:]]
    events = [(rnd.choice("abc"), i, rnd.choice(edges) + timedelta(microseconds=rnd.choice([-1, 0, 0, 1]))) for i in range(300)]
    want = sorted((e, i) for k, e, t in events for own, i, low, high in intervals if own == k and low <= t < high)
    intervals += [(None, 900, at(0), at(10**6)), ("a", 901, None, at(5)), ("a", 902, at(5), None)]
    events += [(None, 900, at(5)), ("a", 901, None)]
    left = spark.createDataFrame(events, "k string, event int, moment timestamp")
    right = spark.createDataFrame(intervals, "k string, interval int, low timestamp, high timestamp")
    got = join_intervals(left, right, ["k"], "moment", "low", "high")
    assert got.columns == ["k", "event", "moment", "interval", "low", "high"]
    assert sorted((r.event, r.interval) for r in got.collect()) == want != []


def test_the_join_is_by_equality_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.createDataFrame([("a", at(1))], "k string, moment timestamp")
        right = spark.createDataFrame([("a", at(0), at(5))], "k string, low timestamp, high timestamp")
        plan = join_intervals(left, right, ["k"], "moment", "low", "high")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_intervals_and_no_events(spark):
    left = spark.createDataFrame([("a", at(1))], "k string, moment timestamp")
    right = spark.createDataFrame([], "k string, low timestamp, high timestamp")
    assert join_intervals(left, right, ["k"], "moment", "low", "high").count() == 0
    assert join_intervals(left.limit(0), right, ["k"], "moment", "low", "high").count() == 0


def test_statements_belong_to_the_sample_they_ran_in(spark, log):
    df = log(series(1, 2, 4, 5))  # snapshots at 10, 20, 30 and 40 seconds
    samples = dl.deltas(cl.collect_clean(df))
    key = samples.first()
    times = [9, 10, 19.999999, 20, 35, 40]
    rows = [(0, key.digest, "", at(int(t * 10**6)), 1205, 1, 0) for t in times] + [(0, key.digest, "", at(12 * 10**6), 0, 0, 0)]
    rows += [(0, key.digest, "", at(22 * 10**6), 1213, 2, 3), (1, key.digest, "", at(12 * 10**6), 1, 1, 1)]
    history = spark.createDataFrame(rows, "server_id int, digest string, schema_name string, executed_at timestamp, errno int, errors long, warnings long")
    got = error_detail_by_sample(history, samples).select("sample_seq", "errno", "n_statements", "errors", "warnings").collect()
    assert sorted(map(tuple, got)) == [(1, 1205, 2, 2, 0), (2, 1205, 1, 1, 0), (2, 1213, 1, 2, 3), (3, 1205, 1, 1, 0)]


# Restarts


def brute_segments(rows, from_zero):
    history = defaultdict(list)
    for r in rows:
        history[r.server_id, r.digest, r.schema_name].append(r)
    out = {}
    for key, own in history.items():
        own.sort(key=lambda r: r.collection_seq)
        sums, cuts, seconds = dict.fromkeys(COUNTERS, 0), 0, 0.0
        for a, b in zip(own, own[1:]):
            fell = b.count_star < a.count_star or b.sum_timer_wait < a.sum_timer_wait
            cuts += fell
            seconds += 0 if fell else (b.collected_time - a.collected_time).total_seconds()
            for c in COUNTERS:
                sums[c] += (b[c] if from_zero else 0) if fell else b[c] - a[c]
        if sums["count_star"] > 0 and sums["sum_timer_wait"] > 0:
            out[key] = (cuts + 1, seconds, own[0].collected_time, own[-1].collected_time, *sums.values())
    return out


@pytest.mark.parametrize(("span", "from_zero"), [(1, False), (3, True), (64, False)])
def test_segments_equal_brute_force(log, span, from_zero):
    df = cl.collect_clean(random_log(log, 41, snapshots=14)).cache()
    got = {
        (r.server_id, r.digest, r.schema_name): (r.segments, r.covered_s, r.start_time, r.end_time, *[r[c] for c in COUNTERS])
        for r in period_segmented(df, span=span, from_zero=from_zero).collect()
    }
    assert got == brute_segments(df.collect(), from_zero)
    assert any(v[0] > 1 for v in got.values())


def test_without_resets_it_is_the_last_value_minus_the_first(log):
    rnd = random.Random(5)
    rows = []
    for k in range(6):
        n = 0
        for seq in range(1, 9):
            n += rnd.randint(0, 5)
            if seq in (1, 8) or rnd.random() < 0.7:
                rows.append((0, seq, f"q{k}", "s", busy(n, 7 * n, sum_errors=2 * n)))
    df = log(rows)
    ends = dl.first_last(dl.at_ends(cl.clean(df), df))
    shape = ("digest", "schema_name", "query_key", "start_time", *COUNTERS)
    assert sorted(period_segmented(cl.collect_clean(df), span=2).select(*shape).collect()) == sorted(ends.select(*shape).collect()) != []


# Rollups


def values(df):
    return {(r.server_id, r.digest, r.schema_name, r.metric): (r.n, r.avg, r.stddev, r.min, r.max) for r in df.collect()}


@pytest.mark.parametrize("span", [1, 4, 100])
def test_rollups_give_the_statistics_of_all_samples(log, span):
    samples = dl.deltas(cl.collect_clean(random_log(log, 51, snapshots=20))).cache()
    want = values(metric_stats(samples))
    got = values(stats_of(rollup(samples, span=span)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


@pytest.mark.parametrize(("first", "last"), [(1, 20), (3, 14), (5, 6), (4, 7), (8, 8), (7, 8), (90, 99)])
def test_any_period_is_answered(log, first, last):
    samples = dl.deltas(cl.collect_clean(random_log(log, 52, snapshots=20))).cache()
    want = values(metric_stats(samples.where(F.col("sample_seq").between(first, last))))
    got = values(period_stats(rollup(samples, span=4), samples, first, last, span=4))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def test_rollups_of_rollups_and_small_deviations_of_large_values(spark):
    rnd = random.Random(3)
    data = [1e9 + rnd.random() for _ in range(3000)]
    cuts = [data[i : i + 50] for i in range(0, 3000, 50)]
    rows = [(i, i // 7, len(c), statistics.fmean(c), statistics.pvariance(c) * len(c), min(c), max(c)) for i, c in enumerate(cuts)]
    parts = spark.createDataFrame(rows, "i int, week int, n long, mean double, m2 double, min double, max double").withColumn("all", F.lit(1))
    once = combined(parts, ["all"]).first()
    twice = combined(combined(parts, ["week", "all"]), ["all"]).first()
    for r in (once, twice):
        assert (r.n, r.min, r.max) == (3000, min(data), max(data))
        assert r.mean == pytest.approx(statistics.fmean(data), rel=1e-14) and (r.m2 / r.n) ** 0.5 == pytest.approx(statistics.pstdev(data), rel=1e-6)


# Records


def test_records_are_known_only_where_they_move(spark):
    def row(seq, lo, hi, first, last, n=5, ordinal=0):
        return (0, seq, at(10**7 * seq), ordinal, "d", "", n, n * 10, lo, hi, at(first), at(last))

    schema = "server_id int, collection_seq int, collected_time timestamp, row_ordinal long, digest string, schema_name string, count_star long, sum_timer_wait long, min_timer_wait long, max_timer_wait long, first_seen timestamp, last_seen timestamp"
    rows = [
        row(1, 5, 9, 1, 2),
        row(2, 5, 12, 1, 15 * 10**6),
        row(2, 4, 8, 3, 4, ordinal=1),  # merged with the row before
        row(2, 0, 99, 0, 0, n=0, ordinal=2),  # idle: does not count
        row(3, 4, 12, 1, 15 * 10**6),  # nothing happened
        row(4, 7, 8, 35 * 10**6, 36 * 10**6),  # restarted
        row(6, 7, 8, 35 * 10**6, 36 * 10**6),
    ]
    merged = merge_records(spark.createDataFrame(rows, schema))
    got = record_deltas(merged, span=2).orderBy("sample_seq").collect()
    assert [(r.sample_seq, r.min_timer_wait, r.max_timer_wait, r.min_at_least, r.max_at_most, r.last_seen is not None, r.is_new) for r in got] == [
        (1, 4, 12, 4, 12, True, False),
        (2, None, None, 4, 12, False, False),
    ]
