"""Keyed state gives the batch result for any cut and order of files; late rows are listed; state does not grow."""

import random

import pytest
from pyspark.sql import functions as F

from counterscope.operators import clean as cl
from counterscope.operators import deltas as dl
from counterscope.streaming.keyed import LATE, StateStream, seen_before
from tests.test_deltas import busy, random_log, series
from tests.test_streaming import rows


@pytest.fixture
def stream(tmp_path):
    return lambda lateness=1000, keep=10_000, **more: StateStream(
        f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", lateness, keep, **more
    )


def deliver(stream, spark, df=None, max_files=None):
    if df is not None:
        df.coalesce(1).write.mode("append").parquet(stream.source)
    query = stream.start(spark, max_files)
    query.awaitTermination()
    assert query.exception() is None
    return query


def finish(stream, spark):
    stream.close(spark)
    return deliver(stream, spark)


@pytest.mark.parametrize("files", [1, 2, 5])
def test_any_cut_and_order_of_files_gives_the_batch_result(spark, log, stream, files):
    df = random_log(log, 21, snapshots=8).cache()
    own = stream()
    part = F.pmod(F.xxhash64("digest_text", "row_ordinal"), F.lit(files))
    order = list(range(files))
    random.Random(files).shuffle(order)
    for i in order:
        df.where(part == i).coalesce(1).write.mode("append").parquet(own.source)
    deliver(own, spark, max_files=1)
    assert rows(own.results(spark)) == []  # nothing is newer by the lateness yet
    finish(own, spark)
    pairs = dl.adjacent_pairs(cl.collect_clean(df))
    assert rows(own.results(spark)) == rows(dl.kept(pairs)) != []
    assert rows(own.rejects(spark)) == rows(dl.delta_rejects(pairs))
    assert own.late_rows(spark).isEmpty()


def test_snapshots_in_reverse_order_and_twice(spark, log, stream):
    df = random_log(log, 22, snapshots=5).cache()
    own = stream()
    for seq in (5, 4, 3, 2, 1, 3, 5):
        deliver(own, spark, df.where(F.col("collection_seq") == seq))
    finish(own, spark)
    assert rows(own.results(spark)) == rows(dl.deltas(cl.collect_clean(df)))


def test_snapshots_close_by_time_and_later_rows_are_listed(spark, log, stream):
    df = log(series(1, 2, 3, 5, 8, 9)).cache()  # ten seconds apart
    own = stream(lateness=20)
    at = lambda *seqs: df.where(F.col("collection_seq").isin(*seqs))
    deliver(own, spark, at(1, 3))
    deliver(own, spark, at(2))  # 1 is closed by 3, 2 is not
    deliver(own, spark, at(3))  # a row of an open snapshot again
    deliver(own, spark, at(6))  # closes 4 and older, which has not come
    deliver(own, spark, at(4, 5))
    finish(own, spark)
    want = dl.deltas(cl.collect_clean(at(1, 2, 3, 5, 6)))
    assert rows(own.results(spark)) == rows(want)
    late = own.late_rows(spark).select("server_id", "collection_seq", "row_ordinal", "count_star", "reason").collect()
    assert [tuple(r) for r in late] == [(0, 4, 3, 5, LATE)]


def test_snapshots_go_on_after_a_close(spark, log, stream):
    df = random_log(log, 23, snapshots=6).cache()
    own = stream()
    deliver(own, spark, df.where("collection_seq <= 3"))
    finish(own, spark)
    assert rows(own.results(spark)) == rows(dl.deltas(cl.collect_clean(df.where("collection_seq <= 3"))))
    deliver(own, spark, df.where("collection_seq > 3"))
    finish(own, spark)
    assert rows(own.results(spark)) == rows(dl.deltas(cl.collect_clean(df)))


def test_filters(spark, log, stream):
    df = random_log(log, 24, snapshots=4).cache()
    text = df.where("digest_text is not null").first().digest_text
    settings = dict(query_filter=text, ignore_performance_schema=True)
    own = stream(**settings)
    deliver(own, spark, df)
    finish(own, spark)
    assert rows(own.results(spark)) == rows(dl.deltas(cl.collect_clean(df, text, True)))


def test_state_is_forgotten_and_stays_flat(spark, log, stream):
    snapshots = []
    for seq in range(1, 13):  # each query is seen in two snapshots only
        snapshots += [(0, seq, f"q{seq + d}", "s", busy(10 * seq, 100 * seq)) for d in (0, 1)]
    df = log(snapshots).cache()
    own = stream(lateness=15, keep=25)
    sizes = []
    for seq in range(1, 13):
        query = deliver(own, spark, df.where(F.col("collection_seq") == seq))
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(sizes[6:]) <= max(sizes[:6])
    finish(own, spark)
    assert rows(own.results(spark)) == rows(dl.deltas(cl.collect_clean(df))) != []


def test_ranges_of_ordinals():
    rnd = random.Random(1)
    for _ in range(50):
        seen, known = [], set()
        for x in rnd.choices(range(40), k=60):
            assert seen_before(seen, x) == (x in known)
            known.add(x)
            assert seen == sorted(seen) and {v for a, b in zip(seen[::2], seen[1::2]) for v in range(a, b + 1)} == known


def test_collected_snapshots_go_into_keyed_state(spark, log, tmp_path):
    from counterscope.sources.collections import write_collections

    df = random_log(log, 25, snapshots=6).cache()
    own = StateStream("", f"{tmp_path}/out", f"{tmp_path}/checkpoint", 15, 100)
    for last, part in ((False, "collection_seq <= 3"), (True, "collection_seq = 4"), (True, "collection_seq > 4")):
        write_collections(df.where(part), f"{tmp_path}/in")
        own.run_collections(spark, f"{tmp_path}/in", close=last)
    assert rows(own.results(spark)) == rows(dl.deltas(cl.collect_clean(df))) != []
    assert own.late_rows(spark).isEmpty()
