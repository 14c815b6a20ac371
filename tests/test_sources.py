"""Snapshot logs on disk, the server table and the text report."""

from datetime import datetime, timezone
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from counterscope.plans import report as rp
from counterscope.plans.compare import Comparison
from counterscope.schema import COUNTERS, UNSIGNED, snapshot_schema
from counterscope.session import materialized, shared_folder, shared_root
from counterscope.sources import snapshots as sn
from counterscope.sources.servers import server_dim
from tests.test_deltas import busy, series


@pytest.fixture
def small(log):
    return log(series(1, 2, 4) + [(1, 1, None, None, busy(3))])


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_round_trip(spark, small, tmp_path, fmt):
    small.write.format(fmt).save(f"{tmp_path}/log")
    same(sn.read_snapshot_log(spark, f"{tmp_path}/log", fmt), small)


def test_csv_round_trip_and_header_check(spark, small, tmp_path):
    small.write.option("header", True).csv(f"{tmp_path}/log")
    same(sn.read_snapshot_log(spark, f"{tmp_path}/log", "csv"), small)
    renamed = small.withColumnRenamed("sum_errors", "errors")
    renamed.write.option("header", True).csv(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="(?i)header|sum_errors"):
        sn.read_snapshot_log(spark, f"{tmp_path}/bad", "csv").collect()


def test_missing_columns_are_refused(spark, small, tmp_path):
    cut = small.drop("sum_errors", "row_ordinal")
    cut.write.parquet(f"{tmp_path}/log")
    with pytest.raises(ValueError, match="row_ordinal, sum_errors"):
        sn.read_snapshot_log(spark, f"{tmp_path}/log")
    cut.write.json(f"{tmp_path}/json")
    with pytest.raises(Exception, match="snapshot log: no row_ordinal"):
        sn.read_snapshot_log(spark, f"{tmp_path}/json", "json").collect()


def test_log_is_partitioned_by_server(spark, small, tmp_path):
    sn.write_snapshot_log(small, f"{tmp_path}/log")
    back = sn.read_snapshot_log(spark, f"{tmp_path}/log")
    assert back.schema.names == [*snapshot_schema().names, "digest"]
    same(back.drop("digest"), small)
    plan = back.where("server_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(server_id" in plan


def test_end_snapshots_reach_the_scan(spark, small, tmp_path):
    sn.write_snapshot_log(small, f"{tmp_path}/log")
    period = Comparison(sn.read_snapshot_log(spark, f"{tmp_path}/log"), (0,)).period()
    plan = period._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters: [((collection_seq" in plan and "Subquery" in plan


def test_text_filter_reaches_the_scan(spark, small, tmp_path):
    sn.write_snapshot_log(small, f"{tmp_path}/log")
    log = sn.read_snapshot_log(spark, f"{tmp_path}/log")
    plan = Comparison(log, (0,), query_filter="SELECT").cleaned()._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(digest_text,SELECT)" in plan


def test_stamp_and_append(spark):
    digest = spark.createDataFrame([("app", t, *range(1, 11)) for t in "abcdef"], sn.digest_schema())
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    both = sn.append_snapshots([sn.stamp_snapshot(digest, s, 3, at) for s in (0, 1)])
    assert both.columns == snapshot_schema().names
    assert {(r.server_id, r.collection_seq) for r in both.collect()} == {(0, 3), (1, 3)}
    arrival = both.where("server_id = 1").orderBy("row_ordinal").collect()
    assert [r.digest_text for r in arrival] == list("abcdef")


def test_digest_rows_take_unsigned_source_types(spark):
    source = spark.createDataFrame([("app", "q", *range(1, 11))], sn.digest_schema())
    source = source.select([F.col(c).cast("decimal(20,0)").alias(c.upper()) if c in COUNTERS else F.col(c) for c in source.columns])
    rows = sn.digest_rows(source)
    assert rows.schema.names == sn.digest_schema().names and rows.first().sum_timer_wait == 2
    with pytest.raises(ValueError, match="sum_errors"):
        sn.digest_rows(source.drop("SUM_ERRORS"))
    with pytest.raises(Exception, match="(?i)overflow"):
        sn.digest_rows(source.withColumn("SUM_ERRORS", F.expr("cast('18446744073709551615' as decimal(20,0))"))).collect()


def test_counters_beyond_bigint(spark, log, tmp_path):
    """The whole chain on unsigned counters above 2^63."""
    base = 2**63
    wide = log(series(1, 3)).select(
        *[F.col(c) for c in snapshot_schema().names if c not in COUNTERS],
        *[F.expr(f"cast({c} as decimal(20,0)) + {base}").cast("decimal(20,0)").alias(c) for c in COUNTERS],
    )
    sn.write_snapshot_log(wide, f"{tmp_path}/log")
    back = sn.read_snapshot_log(spark, f"{tmp_path}/log", counter_type=UNSIGNED)
    wide = Comparison(back, (0,)).wide().where("metric = 'queries'").first()
    assert (wide.n_0, wide.avg_0) == (1, 2.0)
    with pytest.raises(Exception, match="(?i)overflow"):
        sn.read_snapshot_log(spark, f"{tmp_path}/log").collect()


def test_shared_folder_follows_the_session(spark):
    def session(**settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default: settings.get(k.split(".")[1], default)))

    assert shared_root(session(checkpoint="/shared/place/", master="yarn")) == "/shared/place"
    assert shared_root(session(master="local[4]")) == tempfile.gettempdir()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session(master="yarn"))
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_materialized_cuts_the_plan(spark):
    df = materialized(spark.range(5).where("id > 2"))
    assert df.count() == 2 and "Range" not in df._jdf.queryExecution().analyzed().toString()


def test_server_table(spark):
    rows = [(0, "user:pw@tcp(metric1.example.net:3306)/performance_schema", "5.6.25-log")]
    servers = server_dim(spark.createDataFrame(rows, "server_id int, dsn string, version string"))
    assert servers.first().asDict() == {
        "server_id": 0,
        "user": "user",
        "host": "metric1.example.net",
        "version": "5.6.25-log",
        "name": "'user'@'metric1.example.net'",
        "short_name": "'user'@'metric1.example.net'",
    }


@pytest.fixture
def servers(spark):
    rows = [(i, f"user:pw@tcp(metric{i + 1}.example.net:3306)/x", f"5.{i}") for i in (0, 1)]
    return server_dim(spark.createDataFrame(rows, "server_id int, dsn string, version string"))


def test_report_layout(spark, log, servers, tmp_path):
    rows = series(0, 640, 1280, text="SELECT 1") + series(0, 512, 1024, server=1, text="SELECT 1")
    c = Comparison(log(rows), (0, 1))
    lines = rp.report_lines(c.metrics(), c.top_texts, servers, (0, 1))
    text = [r.line for r in lines.orderBy("query_rank", "line_no").collect()]
    assert text[:5] == [
        "Looking at top 1 queries",
        "Query 1: SELECT 1",
        "Server:            'user'@'metric1.example.net'             | 'user'@'metric2.example.net'            ",
        "  Avg queries:      640, σ 0                                | 512, σ 0                               ",
        "  Avg QPS:          64.0 qps, σ 0                           | 51.2 qps, σ 0                          ",
    ]
    assert len(text) == 14
    rp.write_report(lines, f"{tmp_path}/report")
    stored = spark.read.text(f"{tmp_path}/report")
    assert [r.value for r in stored.collect()] == text


def test_report_of_an_idle_server_has_only_its_headline(log, servers):
    c = Comparison(log(series(1, 1)), (0, 1))
    lines = rp.report_lines(c.metrics(), c.top_texts, servers, (0, 1))
    assert [r.line for r in lines.collect()] == ["Looking at top 0 queries"]


def test_listing(log, servers):
    from counterscope.operators.clean import sample_counts

    df = log(series(0, 10, 20))
    lines = rp.server_listing(Comparison(df, (0,)).metrics(), servers, sample_counts(df))
    text = [r.line for r in lines.orderBy("server_id", "query_rank", "line_no").collect()]
    assert text[:4] == [
        "Host: 'user'@'metric1.example.net' / 5.0. Have 2 entries. Looking at top 1 queries",
        "Query 1:",
        "  Avg queries: 10.0, σ 0",
        "  Avg QPS: 1.00 qps, σ 0",
    ]
    assert len(text) == 13


def test_dumps(log):
    from counterscope.operators.clean import collect_clean
    from counterscope.operators.deltas import deltas

    deduped = collect_clean(log([(0, s, "q", "app", busy(n)) for s, n in ((1, 2), (2, 5))]))
    line = rp.dump_events(deduped.where("collection_seq = 1"), COUNTERS).first().line
    assert line.startswith("MD5_DIGEST: 7694f4a66316e53c8cdd9d9954bd611d, SCHEMA: app, COUNT_STAR: 2, SUM_TIMER_WAIT: 2000,")
    line = rp.dump_samples(deltas(deduped)).first().line
    assert line.startswith("Key: 7694f4a66316e53c8cdd9d9954bd611d.app, SUM_TIMER_WAIT: 3000, COUNT_STAR: 3, SUM_ERRORS: 0,")
