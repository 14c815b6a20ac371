"""Keys, filters and the duplicate merge."""

import hashlib

import pytest
from pyspark.sql import functions as F

from counterscope.operators import clean as cl
from counterscope.operators import dictionary as di
from counterscope.schema import COUNTERS
from counterscope.sources.snapshots import scan_keys


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def busy(n, **more):
    return {"count_star": n, "sum_timer_wait": n * 10, **more}


def merged(log, rows):
    out = cl.collect_clean(log([(0, 1, "k", "s", r) for r in rows])).collect()
    assert len(out) == 1
    return out[0]


def test_keys_keep_null_and_empty_apart(log):
    rows = [(0, 1, None, None, {}), (0, 1, "", None, {}), (0, 1, "q", "", {}), (0, 1, "q", "app", {})]
    keys = {r.query_key for r in cl.collect_clean(log(rows)).collect()}
    assert keys == {"", md5(""), md5("q"), md5("q") + ".app"}


def test_merge_adds_busy_rows(log):
    assert merged(log, [busy(3), busy(4)]).count_star == 7


def test_merge_ignores_idle_rows(log):
    for rows in ([{"sum_errors": 9}, busy(5, sum_errors=1)], [busy(5, sum_errors=1), {"sum_errors": 9}]):
        row = merged(log, rows)
        assert (row.count_star, row.sum_timer_wait, row.sum_errors) == (5, 50, 1)


def test_merge_of_idle_rows_takes_the_last(log):
    row = merged(log, [{"sum_errors": 1}, {"sum_errors": 3}, {"sum_errors": 2}])
    assert (row.count_star, row.sum_errors) == (0, 2)


def test_merge_counts_rows_with_only_time_or_only_executions(log):
    row = merged(log, [{"count_star": 2, "sum_errors": 1}, {"sum_timer_wait": 7, "sum_errors": 1}, {"sum_errors": 5}])
    assert (row.count_star, row.sum_timer_wait, row.sum_errors) == (2, 7, 2)


def test_merge_matches_a_fold_in_row_order(log):
    """Every mix of idle and busy rows, against merging row by row."""
    import itertools

    rows, want = [], {}
    for n, mix in enumerate(itertools.product("eb", repeat=4)):
        kept = None
        for i, kind in enumerate(mix):
            cells = {"sum_errors": 10**i}
            if kind == "b":
                cells |= {"count_star": 2**i, "sum_timer_wait": 3**i}
            rows.append((0, 1, f"q{n}", "s", cells))
            full = {c: cells.get(c, 0) for c in COUNTERS}
            idle = kept is None or (kept["count_star"] == 0 and kept["sum_timer_wait"] == 0)
            if idle:
                kept = full
            elif kind == "b":
                kept = {c: kept[c] + full[c] for c in COUNTERS}
        want[md5(f"q{n}")] = kept
    got = {r.digest: {c: r[c] for c in COUNTERS} for r in cl.collect_clean(log(rows)).collect()}
    assert got == want


def test_merge_does_not_depend_on_row_order(log):
    rows = log([(0, 1, f"q{i % 3}", "s", busy(i % 2 * i, sum_errors=i)) for i in range(30)])
    a = cl.collect_clean(rows).orderBy("digest").collect()
    b = cl.collect_clean(rows.repartition(5).orderBy(F.rand(3))).orderBy("digest").collect()
    assert a == b


def test_merge_overflow_fails_instead_of_wrapping(log):
    with pytest.raises(Exception, match="(?i)overflow"):
        merged(log, [busy(1, sum_errors=2**62), busy(1, sum_errors=2**62)])


def test_text_filter(log):
    rows = [(0, 1, t, None, busy(1)) for t in ("SELECT 50%", "select a_b", "a\\b", None, "SELECT x")]
    texts = lambda f, **k: sorted(r.digest_text or "-" for r in cl.filter_text(log(rows), f, **k).collect())
    assert texts("SELECT") == ["SELECT 50%", "SELECT x"]
    assert texts("SELECT", case_sensitive=False) == ["SELECT 50%", "SELECT x", "select a_b"]
    assert texts("a_b") == ["a\\b", "select a_b"]
    assert texts("a\\b") == ["a\\b"]
    assert texts("\\") == ["a\\b"]
    assert len(texts("")) == 5 and len(texts("%")) == 4


def test_schema_filter_keeps_null_schemas(log):
    rows = [(0, 1, "q", s, busy(1)) for s in (None, "", "app", "performance_schema", "Performance_Schema")]
    kept = cl.filter_schema(log(rows), True).collect()
    assert {r.schema_name for r in kept} == {None, "", "app", "Performance_Schema"}
    assert cl.filter_schema(log(rows), False).count() == 5


def test_is_empty_vectors(spark):
    df = spark.createDataFrame([(0, 0), (100, 0), (0, 100), (100, 100)], "count_star bigint, sum_timer_wait bigint")
    assert [r[0] for r in df.select(cl.is_empty()).collect()] == [True, False, False, False]


def test_audit_names_the_branch(log):
    rows = [
        (0, 1, "added", None, busy(1)),
        (0, 1, "added", None, busy(2)),
        (0, 1, "mixed", None, busy(1)),
        (0, 1, "mixed", None, {}),
        (0, 1, "idle", None, {}),
        (0, 1, "idle", None, {}),
        (0, 1, "single", None, busy(1)),
    ]
    got = {r.query_key: r.branch for r in cl.dedup_audit(scan_keys(log(rows))).collect()}
    assert got == {md5("added"): "added", md5("mixed"): "kept_busy_row", md5("idle"): "kept_last_empty_row"}


def test_sizes_count_emptied_snapshots(log):
    rows = log([(0, 1, "a", None, busy(1)), (0, 1, "a", None, busy(1)), (0, 2, "b", None, busy(1)), (1, 1, "a", None, busy(1))])
    sizes = cl.collection_rows(cl.collect_clean(rows, query_filter="a"), cl.snapshot_index(rows))
    assert {tuple(r) for r in sizes.collect()} == {(0, 1, 1), (0, 2, 0), (1, 1, 1)}
    assert {tuple(r) for r in cl.collection_sizes(sizes).collect()} == {(0, 2, 1, 0), (1, 1, 1, 1)}
    assert {tuple(r) for r in cl.sample_counts(rows).collect()} == {(0, 1), (1, 0)}


def test_dictionary(log):
    rows = log([(0, 1, "a", "performance_schema", busy(1)), (1, 2, "a", "performance_schema", busy(1)), (0, 1, None, None, {})])
    got = {tuple(r) for r in di.query_dictionary(rows).collect()}
    assert got == {(md5("a") + ".performance_schema", "a"), ("", "")}
    assert di.query_dictionary(rows, "b").count() == 0


def test_conflicts(spark):
    texts = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "b"), ("m", "a"), ("n", None)], "query_key string, digest_text string")
    assert [tuple(r) for r in di.dictionary_conflicts(texts).collect()] == [("k", 2, "a", "b")]
    assert di.dictionary_conflicts(texts.where("query_key <> 'k'"), strict=True).count() == 0
    with pytest.raises(Exception, match="one key, several texts: k"):
        di.dictionary_conflicts(texts, strict=True).collect()
