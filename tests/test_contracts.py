"""Promises at the edges: order of counters, missing values, overflow, absent keys, idle servers."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from counterscope import Comparison, compare_servers, read_snapshot_log, write_snapshot_log
from counterscope.operators import clean as cl
from counterscope.operators import deltas as dl
from counterscope.operators.quality import idle_status
from counterscope.plans import report as rp
from counterscope.schema import COUNTERS, EXTRA_COUNTERS, METRIC_NAMES, digest_schema
from counterscope.sources.snapshots import collect_round
from tests.test_deltas import series


def outcomes(df, counters):
    return [r.outcome for r in dl.adjacent_pairs(cl.collect_clean(df, counters=counters), counters).collect()]


def test_resets_are_found_by_name_in_any_order_of_counters(spark, log):
    df = log([(0, 1, "q", "s", {"count_star": 9, "sum_timer_wait": 90}), (0, 2, "q", "s", {"count_star": 2, "sum_timer_wait": 95})])
    for counters in (COUNTERS, ("sum_errors", "sum_warnings", "count_star", "sum_timer_wait"), ("count_star", "sum_timer_wait")):
        assert outcomes(df, counters) == ["reset"]
    assert dl.adjacent_pairs(cl.collect_clean(df, counters=COUNTERS[:2]), COUNTERS[:2]).first().negative_counter is False


def test_missing_counters_are_refused_in_any_format(spark, log, tmp_path):
    df = log(series(1, 2)).withColumn("count_star", F.expr("nullif(count_star, 1)"))
    for fmt in ("parquet", "orc"):
        df.write.format(fmt).save(f"{tmp_path}/{fmt}")
        with pytest.raises(Exception, match="no count_star"):
            read_snapshot_log(spark, f"{tmp_path}/{fmt}", fmt).collect()


def test_sums_never_wrap(spark, log):
    big = {"count_star": 2**62, "sum_timer_wait": 1}
    df = log([(0, 1, "q", "s", big), (0, 1, "q", "s", big)])
    with pytest.raises(Exception, match="(?i)overflow"):
        cl.collect_clean(df).collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ValueError, match="ansi"):
            cl.collect_clean(df)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_absent_keys_have_empty_series(spark, log):
    df = log(series(1, 2, 4) + series(1, 1, 1, text="other", server=1))
    arrays = Comparison(df, (0, 1)).arrays().collect()
    by_server = {s: [len(r["values"]) for r in arrays if r.server_id == s] for s in (0, 1)}
    assert by_server == {0: [2] * len(METRIC_NAMES), 1: [0] * len(METRIC_NAMES)}


def test_extra_counters_reach_the_comparison(spark, log):
    df = log(series(1, 2, 4)).withColumn(EXTRA_COUNTERS[0], F.col("count_star") * 3)
    wide = compare_servers(df, [0], counters=(*COUNTERS, EXTRA_COUNTERS[0])).collect()
    assert [r.metric for r in wide] == [*METRIC_NAMES, EXTRA_COUNTERS[0]] or len(wide) == len(METRIC_NAMES) + 1
    extra = next(r for r in wide if r.metric == EXTRA_COUNTERS[0])
    assert extra.metric_ord == len(METRIC_NAMES) + 1 and extra.avg_0 == pytest.approx(4.5)


def test_filters_can_ignore_case_from_the_top(spark, log):
    df = log(series(1, 2, text="SELECT a"))
    assert compare_servers(df, [0], query_filter="select").isEmpty()
    assert not compare_servers(df, [0], query_filter="select", case_sensitive=False).isEmpty()


def test_an_idle_server_keeps_its_header(spark, log):
    df = log(series(1, 1))
    servers = spark.createDataFrame([(0, "host", "1.0")], "server_id int, name string, version string")
    lines = rp.server_listing(Comparison(df, (0,)).metrics(), servers, cl.sample_counts(df)).collect()
    assert [r.line for r in lines] == ["Host: host / 1.0. Have 1 entries. Looking at top 0 queries"]


def test_idle_status_counts_compared_servers_only(spark, log):
    df = log(series(1, 2) + series(1, 2, 3, server=9))
    period = Comparison(df, (0,)).period()
    assert idle_status(period, df, 0, [0]).first().n_samples == 1
    assert idle_status(period, df, 0).first().n_samples == 3


def test_a_round_collects_every_server_and_keys_match(spark):
    table = spark.createDataFrame([("s", "select 1", *range(1, 11)), (None, None, *range(1, 11))], digest_schema())
    log = collect_round({3: table, 5: table}, 2, datetime(2024, 1, 1, tzinfo=timezone.utc))
    found = cl.collect_clean(log).collect()
    assert sorted({(r.server_id, r.collection_seq) for r in found}) == [(3, 2), (5, 2)] and len(found) == 4
    for r in found:
        assert r.query_key.startswith(r.digest) and r.query_key.endswith(r.schema_name)


def test_a_stored_log_is_compared_without_its_texts(spark, log, tmp_path):
    df = log(series(1, 2, 4) + series(2, 3, 9, text="b", server=1))
    write_snapshot_log(df, str(tmp_path / "log"))
    stored = read_snapshot_log(spark, str(tmp_path / "log"))
    for build in (lambda x: dl.deltas(cl.collect_clean(x)), lambda x: Comparison(x, (0, 1)).samples()):
        plan = build(stored)._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "ReadSchema" in line]
        assert scans and not any("digest_text" in line for line in scans)
        assert sorted(map(tuple, build(stored).collect())) == sorted(map(tuple, build(df).collect()))


def test_many_servers_are_reported_like_few(spark, log):
    rows = [r for s in range(12) for r in series(1, 2, 4, server=s)]
    c = Comparison(log(rows), tuple(range(12)))
    servers = spark.createDataFrame([(s, f"h{s}") for s in range(11)], "server_id int, short_name string")
    lines = rp.report_lines(c.metrics(), c.top_texts, servers, tuple(range(12))).orderBy("query_rank", "line_no").collect()
    assert lines[2].line.count(" | ") == 11 and lines[2].line.index("h10") > lines[2].line.index("h9")
    assert all(r.line.count(" | ") == 11 for r in lines[3:])
