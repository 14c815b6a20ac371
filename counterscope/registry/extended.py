"""Further named queries: collection source and report sink, restarts, rollups, records, intervals and more streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterscope.functions.keys import query_key
from counterscope.operators import clean as cl
from counterscope.operators import deltas as dl
from counterscope.operators.intervals import error_detail_by_sample as errors_in_samples
from counterscope.operators.records import merge_records, record_deltas
from counterscope.operators.rollup import period_stats, rollup, stats_of
from counterscope.operators.segments import period_segmented as segmented
from counterscope.plans import compare as cp
from counterscope.plans import report as rp
from counterscope.registry import derived as dv
from counterscope.registry import oracles as sq
from counterscope.registry import queries as q
from counterscope.registry.queries import REGISTRY, plain_times, query
from counterscope.schema import COUNTERS, METRIC_NAMES
from counterscope.session import shared_folder
from counterscope.sources.collections import read_collections, write_collections
from counterscope.sources.servers import server_dim
from counterscope.sources.snapshots import collect_round, scan_keys
from counterscope.streaming.dictionary import DictionaryStream
from counterscope.streaming.keyed import StateStream
from counterscope.streaming.top import TopStream

__all__ = ["REGISTRY"]

_LOG, _SERVERS = q._LOG, q._SERVERS
_ITEM_LOG, _ITEM_DELTAS, _ITEM_DEDUPED = q._ITEM_LOG, q._ITEM_DELTAS, q._ITEM_DELTAS[:3]


# Collected snapshots


@query(
    sq.with_(_LOG)
    + f"""SELECT {q._LOG_COLUMNS} FROM snapshots
      WHERE server_id = 1 AND collection_seq > 3 AND collection_seq <= 20 AND digest_text LIKE '%c%'"""
)
def collection_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots 4 to 20 of a server, with its texts filtered, out of a folder of collected snapshots."""
    path = shared_folder(spark, "collected")
    write_collections(dv.event_snapshots(spark, sf_dir), path)
    wanted = read_collections(spark, path).where("server_id = 1 AND collection_seq > 3 AND collection_seq <= 20")
    return plain_times(cl.filter_text(wanted, "c"))


@query(
    sq.with_(_LOG)
    + f"""SELECT server_id, 1 AS collection_seq, schema_name, digest_text, {sq.listed(COUNTERS)} FROM snapshots s
      WHERE collection_seq = (SELECT max(collection_seq) FROM snapshots x WHERE x.server_id = s.server_id)"""
)
def collection_round(spark, sf_dir):
    """One round: the present digest table of each server, stamped."""
    log = dv.stored_events(spark, sf_dir)
    last = F.col("collection_seq") == log.groupBy().agg(F.max("collection_seq")).scalar()
    tables = {s: log.where((F.col("server_id") == s) & last).select("schema_name", "digest_text", *COUNTERS) for s in _SERVERS}
    taken = collect_round(tables, 1, datetime(2024, 1, 1, tzinfo=timezone.utc))
    return taken.select("server_id", "collection_seq", "schema_name", "digest_text", *COUNTERS)


@query(sq.with_(*q._DELTAS) + q._DELTA_SELECT + "deltas")
def stream_collected_deltas(spark, sf_dir):
    """Snapshots are collected in two rounds into a folder and read as a stream into keyed state."""
    root = shared_folder(spark, "collected")
    stream = StateStream("", f"{root}/out", f"{root}/checkpoint", 86400.0, 3 * 86400.0)
    log = dv.event_snapshots(spark, sf_dir)
    for last, part in ((False, F.col("collection_seq") <= 17), (True, F.col("collection_seq") > 17)):
        write_collections(log.where(part), f"{root}/in")
        stream.run_collections(spark, f"{root}/in", close=last)
    return plain_times(stream.results(spark))


@query(sq.with_(_LOG) + f"SELECT {q._LOG_COLUMNS} FROM snapshots WHERE digest_text ILIKE '%select P%'")
def filter_text_nocase(spark, sf_dir):
    return plain_times(cl.filter_text(dv.event_snapshots(spark, sf_dir), "select P", case_sensitive=False))


# Reports


@query(sq.with_(q._COMPARED, *q._EVENT_NAMES) + f"SELECT line FROM ({q._report_sql(_SERVERS)})")
def report_published(spark, sf_dir):
    """The lines of a report as they stand in its published files."""
    comparison = q._comparison(spark, sf_dir)
    servers = server_dim(dv.event_servers(spark, sf_dir))
    lines = rp.report_lines(comparison.metrics(), comparison.top_texts, servers, _SERVERS)
    path = shared_folder(spark, "report")
    rp.write_report(lines, path)
    return rp.read_report(spark, path).select("line")


@query(
    sq.with_(sq.compared(_LOG, _SERVERS, "digest_text LIKE '%no such text%'"), *q._EVENT_NAMES)
    + """SELECT server_id, 0 AS query_rank, 0 AS line_no,
      concat('Host: ', name, ' / ', version, '. Have ',
        (SELECT count(DISTINCT collection_seq) - 1 FROM snapshots x WHERE x.server_id = d.server_id), ' entries. Looking at top 0 queries') AS line
    FROM server_dim d"""
)
def server_listing_idle(spark, sf_dir):
    """Servers whose statements are all filtered away keep the header of their listing."""
    log = dv.stored_events(spark, sf_dir)
    metrics = cp.Comparison(log, _SERVERS, query_filter="no such text").metrics()
    return rp.server_listing(metrics, server_dim(dv.event_servers(spark, sf_dir)), cl.sample_counts(log))


# Samples


_WRAPPED = ", ".join(f"CAST(CASE WHEN {c} < 0 THEN {c} + 18446744073709551616::HUGEINT ELSE {c} END AS VARCHAR) AS {c}" for c in COUNTERS)


@query(sq.with_(*q._DELTAS) + f"SELECT server_id, sample_seq, query_key, {_WRAPPED} FROM deltas")
def deltas_wrapped(spark, sf_dir):
    """A counter that fell is read as an overflow of 64 bits."""
    samples = dl.deltas(q._deduped(spark, sf_dir), wrap_unsigned=True)
    return samples.select("server_id", "sample_seq", "query_key", *[F.col(c).cast("string").alias(c) for c in COUNTERS])


_HISTORY = """history AS (
  SELECT server_id, coalesce(md5(digest_text), '') AS digest, coalesce(schema_name, '') AS schema_name,
    ts - INTERVAL 1 DAY AS executed_at, CASE WHEN v > 80 THEN 1205 WHEN v > 40 THEN 1213 ELSE 0 END AS errno,
    CASE WHEN v > 40 THEN 1 ELSE 0 END AS errors, CASE WHEN v > 20 THEN 1 ELSE 0 END AS warnings
  FROM timed)"""
_TIMED = sq.STATEMENTS.replace("base AS (", "timed AS (").replace("date_trunc('day', ts) AS collected_time", "ts")


@query(
    sq.with_(*q._DELTAS, _TIMED, _HISTORY)
    + """SELECT d.server_id, d.sample_seq, d.digest, d.schema_name, h.errno, count(*) AS n_statements,
      CAST(sum(h.errors) AS BIGINT) AS errors, CAST(sum(h.warnings) AS BIGINT) AS warnings
    FROM deltas d JOIN history h ON d.server_id = h.server_id AND d.digest = h.digest AND d.schema_name = h.schema_name
      AND h.executed_at >= d.start_time AND h.executed_at < d.start_time + to_microseconds(CAST(round(d.duration_s * 1000000) AS BIGINT))
    WHERE h.errors > 0 OR h.warnings > 0 GROUP BY ALL"""
)
def error_detail_by_sample(spark, sf_dir):
    """The statements of a day are in the snapshot that bears its date, so they ran before that and belong to the sample that it ends."""
    history = scan_keys(dv.timed_statements(spark, sf_dir))
    return errors_in_samples(history, dl.deltas(q._deduped(spark, sf_dir)))


# Periods


def _segmented_sql(from_zero: bool = False) -> str:
    fell = "(count_star < b_count_star OR sum_timer_wait < b_sum_timer_wait)"
    after = "{c}" if from_zero else "0"
    sums = ", ".join(
        f"CAST(sum(CASE WHEN b_count_star IS NULL THEN 0 WHEN {fell} THEN {after.format(c=c)} ELSE {c} - b_{c} END) AS BIGINT) AS {c}" for c in COUNTERS
    )
    lags = ", ".join(f"lag({c}) OVER h AS b_{c}" for c in COUNTERS)
    return f"""SELECT * FROM (SELECT server_id, digest, schema_name, query_key, min(collected_time) AS start_time, max(collected_time) AS end_time,
      sum(CASE WHEN b_time IS NULL OR {fell} THEN 0 ELSE date_diff('microsecond', b_time, collected_time) END) / 1000000.0::DOUBLE AS covered_s,
      count(*) FILTER ({fell}) + 1 AS segments, {sums}
    FROM (SELECT *, lag(collected_time) OVER h AS b_time, {lags} FROM deduped
      WINDOW h AS (PARTITION BY server_id, digest, schema_name ORDER BY collection_seq)) GROUP BY server_id, digest, schema_name, query_key)
    WHERE count_star > 0 AND sum_timer_wait > 0"""


@query(sq.with_(*q._DEDUPED) + _segmented_sql())
def period_segmented(spark, sf_dir):
    return plain_times(segmented(q._deduped(spark, sf_dir)))


@query(sq.with_(*q._DEDUPED) + _segmented_sql(from_zero=True))
def period_segmented_from_zero(spark, sf_dir):
    """Short spans, and what counters had right after a reset counts."""
    return plain_times(segmented(q._deduped(spark, sf_dir), span=4, from_zero=True))


_STAT_SQL, _KEY_VALUES = q._STAT_SQL, q._KEY_VALUES


@query(sq.with_(*_ITEM_DELTAS, _KEY_VALUES) + _STAT_SQL)
def metric_stats_rollup(spark, sf_dir):
    """All statistics from stored moments of eight samples each."""
    samples = dl.deltas(cl.collect_clean(dv.lineitem_snapshots(spark, sf_dir)))
    path = shared_folder(spark, "rollup")
    rollup(samples, span=8).write.parquet(path)
    return q._rounded_stats(stats_of(spark.read.parquet(path)), ["server_id", "digest", "schema_name"])


@query(
    sq.with_(*_ITEM_DELTAS, _KEY_VALUES.replace("FROM deltas", "FROM deltas WHERE sample_seq BETWEEN 13 AND 50")) + _STAT_SQL
)
def metric_stats_period(spark, sf_dir):
    """Samples 13 to 50: whole spans from rollups, both ends from samples."""
    samples = dl.deltas(cl.collect_clean(dv.lineitem_snapshots(spark, sf_dir)))
    stats = period_stats(rollup(samples, span=8), samples, 13, 50, span=8)
    return q._rounded_stats(stats, ["server_id", "digest", "schema_name"])


_RECORD_LOG = """timed AS (
  SELECT CAST(user_id % 2 AS INT) AS server_id,
    CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 7 = 1 THEN 'performance_schema' ELSE concat('app', user_id % 3) END AS schema_name,
    CASE WHEN event_id % 97 = 0 THEN '' ELSE md5(concat('SELECT ', event_type, ' WHERE k = ?')) END AS digest,
    CAST(event_id % 2 AS INT) AS shard, date_trunc('day', ts) AS day, ts, CAST(round(value*100) AS BIGINT)*10000000 AS timer_ps FROM events),
by_day AS (
  SELECT server_id, schema_name, digest, shard, day, count(*) AS c, sum(timer_ps) AS t, min(timer_ps) AS lo, max(timer_ps) AS hi, min(ts) AS f, max(ts) AS l
  FROM timed GROUP BY ALL),
running AS (
  SELECT server_id, schema_name, digest, day, dense_rank() OVER (PARTITION BY server_id ORDER BY day) AS seq, sum(c) OVER w AS c, sum(t) OVER w AS t,
    min(lo) OVER w AS lo, max(hi) OVER w AS hi, min(f) OVER w AS f, max(l) OVER w AS l
  FROM by_day WINDOW w AS (PARTITION BY server_id, schema_name, digest, shard ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
merged AS (
  SELECT server_id, schema_name, digest, seq, max(day) + INTERVAL 1 DAY AS at, min(lo) AS lo, max(hi) AS hi, min(f) AS f, max(l) AS l
  FROM running WHERE c > 0 OR t > 0 GROUP BY server_id, schema_name, digest, seq)"""


@query(
    f"WITH {_RECORD_LOG} "
    + """SELECT b.server_id, CAST(a.seq AS INT) AS sample_seq, b.digest, b.schema_name,
      CASE WHEN b.schema_name <> '' THEN concat(b.digest, '.', b.schema_name) ELSE b.digest END AS query_key,
      CASE WHEN b.lo <> a.lo THEN b.lo END AS min_timer_wait, CASE WHEN b.hi <> a.hi THEN b.hi END AS max_timer_wait,
      b.lo AS min_at_least, b.hi AS max_at_most, CASE WHEN b.l <> a.l THEN b.l END AS last_seen, b.f >= a.at AS is_new
    FROM merged a JOIN merged b ON a.server_id = b.server_id AND a.digest = b.digest AND a.schema_name = b.schema_name AND b.seq = a.seq + 1
    WHERE NOT (b.hi < a.hi OR b.lo > a.lo OR b.l < a.l OR b.f > a.f)"""
)
def deltas_records(spark, sf_dir):
    keyed = scan_keys(dv.event_records(spark, sf_dir))
    return plain_times(record_deltas(merge_records(keyed)))


# Comparison


@query(
    sq.with_(
        sq.compared(_LOG, _SERVERS, "digest_text LIKE '%e%'", 3),
        "there AS (SELECT DISTINCT query_rank, server_id FROM metric_values)",
    )
    + """SELECT g.query_rank, g.query_key, g.server_id, g.metric_ord, g.metric, count(v.value) AS n_values
    FROM grid g LEFT JOIN metric_values v ON v.query_rank = g.query_rank AND v.server_id = g.server_id AND v.metric_ord = g.metric_ord GROUP BY ALL"""
)
def metrics_arrays_all(spark, sf_dir):
    """Every query and server has its series, empty ones included."""
    comparison = q._comparison(spark, sf_dir, query_filter="e", top_n=3)
    n = F.size("values").cast("long")
    series = comparison.arrays().groupBy("query_rank", "server_id", "metric_ord", "metric").agg(F.sum(n).alias("n_values"))
    return series.join(F.broadcast(comparison.top_keys.select("query_rank", "query_key")), "query_rank")


_ALL_METRICS = [*METRIC_NAMES, *q.EXTRA_COUNTERS]


@query(
    sq.with_(
        sq.event_snapshots(extra=True), sq.ALL_TEXTS, sq.keyed(counters=q._WIDE_COUNTERS), sq.deduped(q._WIDE_COUNTERS), sq.period(), sq.topkeys(), sq.deltas(q._WIDE_COUNTERS)
    )
    + "\nUNION ALL ".join(
        f"""SELECT t.query_rank, t.query_key, {len(METRIC_NAMES) + i} AS metric_ord, '{c}' AS metric,
          {", ".join(f"count(*) FILTER (d.server_id = {s}) AS n_{s}, {sq.rounded(f'coalesce(avg(d.{c}) FILTER (d.server_id = {s}), 0)')} AS avg_{s}" for s in _SERVERS)}
        FROM topkeys t LEFT JOIN deltas d USING (digest, schema_name) GROUP BY t.query_rank, t.query_key"""
        for i, c in enumerate(q.EXTRA_COUNTERS, start=1)
    )
)
def compare_servers_all_counters(spark, sf_dir):
    """The comparison has a line for each further counter too."""
    log = dv.event_snapshots(spark, sf_dir, extra=True)
    wide = cp.compare_servers(log, _SERVERS, counters=q._WIDE_COUNTERS).where(F.col("metric_ord") > len(METRIC_NAMES))
    cells = [c for s in _SERVERS for c in (F.col(f"n_{s}"), q.rounded(f"avg_{s}"))]
    return wide.select("query_rank", "query_key", "metric_ord", "metric", *cells)


# Streams


@query(sq.with_(_ITEM_LOG, sq.keyed(), sq.deduped(), sq.period(), sq.ALL_TEXTS, sq.topkeys()) + "SELECT query_rank, digest, schema_name, query_key, sum_timer_wait FROM topkeys")
def topn_stream(spark, sf_dir):
    """The log comes in three parts; the memory of the stream holds 128 keys a server."""
    root = shared_folder(spark, "top")
    stream = TopStream(f"{root}/in", f"{root}/memory", capacity=128)
    log = dv.stored_lineitem(spark, sf_dir)
    seq = F.col("collection_seq")
    for part in (seq <= 30, (seq > 30) & (seq <= 60), seq > 60):
        log.where(part).drop("digest").write.mode("append").parquet(stream.source)
        stream.start(spark).awaitTermination()
    return stream.top(spark, log)


def _dictionary(spark: SparkSession, log: DataFrame) -> DictionaryStream:
    root = shared_folder(spark, "dictionary")
    stream = DictionaryStream(f"{root}/in", f"{root}/out", f"{root}/checkpoint")
    for part in (F.col("collection_seq") % 2 == 0, F.col("collection_seq") % 2 == 1):
        log.where(part).write.mode("append").parquet(stream.source)
        stream.start(spark).awaitTermination()
    return stream


@query(REGISTRY["query_dictionary"].sql)
def stream_dictionary(spark, sf_dir):
    return _dictionary(spark, dv.event_snapshots(spark, sf_dir)).results(spark)


@query(
    sq.with_(_LOG, sq.ALL_TEXTS, "texts AS (SELECT schema_name AS query_key, digest_text FROM all_texts)") + q._CONFLICTS
)
def stream_conflicts(spark, sf_dir):
    """Keys cut to their schema have several texts each; the stream's dictionary says which."""
    entries = _dictionary(spark, dv.event_snapshots(spark, sf_dir)).entries(spark)
    schema = F.when(F.col("query_key").contains("."), F.substring_index("query_key", ".", -1)).otherwise(
        F.when(F.length("query_key") == 32, F.lit("")).otherwise(F.col("query_key"))
    )
    return q.di.dictionary_conflicts(entries.select(schema.alias("query_key"), "digest_text"))


# The inventory's name, which an import above bears too.
REGISTRY["collect_round"] = REGISTRY.pop("collection_round")
