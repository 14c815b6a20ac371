"""The collection source prunes by server and snapshot and resumes; the report sink publishes whole reports."""

import pytest
from pyspark.sql import functions as F

from counterscope.operators import clean as cl
from counterscope.operators import deltas as dl
from counterscope.plans.report_sink import Part, ReportWriter, read_report, write_report
from counterscope.schema import UNSIGNED, snapshot_schema
from counterscope.sources.collections import read_collections, snapshot_files, stream_collections, write_collections
from tests.test_deltas import random_log
from tests.test_streaming import rows


@pytest.fixture
def collected(spark, log, tmp_path):
    df = random_log(log, 31, snapshots=6).cache()
    path = f"{tmp_path}/collected"
    for seqs in ((1, 2, 3), (4, 5, 6)):
        write_collections(df.where(F.col("collection_seq").isin(*seqs)), path)
    return df, path


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect())) != []


def scanned(df):
    return df.rdd.getNumPartitions()


def test_it_gives_the_log_back(spark, collected):
    df, path = collected
    got = read_collections(spark, path)
    assert got.schema.names == snapshot_schema().names
    same(got, df)
    servers = df.select("server_id").distinct().count()
    assert scanned(got) == 6 * servers == len(snapshot_files(path))
    assert rows(dl.deltas(cl.collect_clean(got))) == rows(dl.deltas(cl.collect_clean(df)))


@pytest.mark.parametrize(
    ("condition", "snapshots"),
    [("server_id = 0", 6), ("collection_seq > 2 AND collection_seq <= 4 AND server_id = 1", 2), ("collection_seq IN (1, 6) AND server_id = 0", 2), ("collection_seq >= 6 AND server_id < 1", 1)],
)
def test_filters_leave_out_partitions(spark, collected, condition, snapshots):
    df, path = collected
    got = read_collections(spark, path).where(condition)
    assert scanned(got) == snapshots
    same(got, df.where(condition))


def test_other_filters_stay_with_spark(spark, collected):
    df, path = collected
    condition = "count_star % 2 = 0 AND (server_id = 0 OR collection_seq = 3) AND digest_text IS NOT NULL"
    same(read_collections(spark, path).where(condition), df.where(condition))


def test_texts_are_filtered_where_they_are_read(spark, collected):
    df, path = collected
    text = df.where("digest_text is not null").first().digest_text
    got = cl.filter_text(read_collections(spark, path), text[:-1])
    assert "Contains" not in got._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
    same(got, cl.filter_text(df, text[:-1]))


def test_counters_in_another_type(spark, collected):
    df, path = collected
    got = read_collections(spark, path, counter_type=UNSIGNED)
    assert dict(got.dtypes)["count_star"] == "decimal(20,0)" and got.agg(F.sum("count_star")).first()[0] == df.agg(F.sum("count_star")).first()[0]


def test_what_no_manifest_lists_is_not_there(spark, log, tmp_path):
    df = random_log(log, 32, snapshots=2)
    path = f"{tmp_path}/collected"
    df.write.parquet(f"{path}/half-written")
    assert read_collections(spark, path).count() == 0
    write_collections(df, path)
    same(read_collections(spark, path), df)


def test_a_stream_goes_on_after_what_it_has_had(spark, log, tmp_path):
    df = random_log(log, 33, snapshots=6).cache()
    path, out = f"{tmp_path}/collected", f"{tmp_path}/out"
    counts = []
    for seqs in ((1, 2), (3,), (), (4, 5, 6)):
        if seqs:
            write_collections(df.where(F.col("collection_seq").isin(*seqs)), path)
        writer = stream_collections(spark, path).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint")
        query = writer.trigger(availableNow=True).start(out)
        query.awaitTermination()
        assert query.exception() is None
        counts.append(spark.read.schema(snapshot_schema()).parquet(out).count())
    same(spark.read.parquet(out), df)
    assert counts[0] < counts[1] == counts[2] < counts[3]


def test_a_stream_from_an_offset(spark, collected, tmp_path):
    df, path = collected
    stream = stream_collections(spark, path, after={0: 4, 1: 2})
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/o")
    query.awaitTermination()
    later = "NOT (server_id = 0 AND collection_seq <= 4) AND NOT (server_id = 1 AND collection_seq <= 2)"
    same(spark.read.parquet(f"{tmp_path}/o"), df.where(later))


def lines_of(spark, n):
    return spark.range(n).select((F.col("id") / 3).cast("int").alias("query_rank"), (F.col("id") % 3).alias("line_no"), F.concat(F.lit("line ü "), "id").alias("line"))


def text(spark, path):
    return [r.line for r in read_report(spark, path).orderBy("part", "place").collect()]


def test_a_report_is_written_by_several_tasks_in_order(spark, tmp_path):
    path = f"{tmp_path}/report"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_report(lines_of(spark, 500).repartition(5), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "report").glob("part-*.txt"))) > 1
    assert text(spark, path) == [f"line ü {i}" for i in range(500)]
    write_report(lines_of(spark, 4), path)
    assert text(spark, path) == [f"line ü {i}" for i in range(4)]
    with pytest.raises(Exception, match="there is a report"):
        write_report(lines_of(spark, 9), path, mode="append")
    assert text(spark, path) == [f"line ü {i}" for i in range(4)]
    assert [p.name for p in tmp_path.iterdir()] == ["report"]


def test_a_job_that_fails_leaves_the_old_report(spark, tmp_path):
    path = f"{tmp_path}/report"
    write_report(lines_of(spark, 3), path)
    broken = lines_of(spark, 300).withColumn("line", F.when(F.col("query_rank") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        write_report(broken, path)
    assert text(spark, path) == [f"line ü {i}" for i in range(3)]
    assert [p.name for p in tmp_path.iterdir()] == ["report"]


def test_what_failed_attempts_wrote_is_dropped(spark, tmp_path):
    writer = ReportWriter(f"{tmp_path}/report", True)
    (tmp_path / writer.folder).mkdir()
    for name in ("part-000000-first", "part-000000-again", "part-000001-only"):
        (tmp_path / writer.folder / f"{name}.txt").write_text(f"{name}\n")
    writer.commit([Part("part-000000-again.txt", 1), Part("part-000001-only.txt", 1), None])
    assert text(spark, f"{tmp_path}/report") == ["part-000000-again", "part-000001-only"]
