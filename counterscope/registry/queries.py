"""Named queries: what to run on Spark, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterscope.functions.keys import is_empty, query_key
from counterscope.functions.rates import latency
from counterscope.functions.text import float_number, float_time, picosecond_time, steady
from counterscope.operators import clean as cl
from counterscope.operators import deltas as dl
from counterscope.operators import dictionary as di
from counterscope.operators.quality import idle_status
from counterscope.plans import compare as cp
from counterscope.plans import report as rp
from counterscope.registry import derived as dv
from counterscope.registry import oracles as sq
from counterscope.schema import COUNTERS, EXTRA_COUNTERS, METRIC_NAMES
from counterscope.session import shared_folder
from counterscope.sources.servers import server_dim
from counterscope.sources.snapshots import scan_digest, scan_keys
from counterscope.streaming.incremental import SampleStream
from counterscope.streaming.keyed import StateStream

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        REGISTRY[run.__name__] = Query(run, sql)
        return run

    return add


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps as UTC clock times without a zone, as the SQL side has them."""
    zoned = [name for name, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({c: dv.utc_clock(c) for c in zoned}) if zoned else df


def rounded(value: str) -> Column:
    """Ten significant digits, for comparing values that two engines add up in different orders.

    Cutting to twelve first makes a value that lies on a rounding boundary the same on both sides.
    """
    return steady(steady(F.col(value)), 10).alias(value)


_SERVERS = dv.EVENT_SERVERS
_LOG = sq.event_snapshots()
_KEYED = [_LOG, sq.keyed()]
_DEDUPED = [*_KEYED, sq.deduped()]
_DELTAS = [*_DEDUPED, sq.deltas()]
_COMPARED = sq.compared(_LOG, _SERVERS)
_IDLE = [sq.idle_snapshots(), sq.keyed()]
_COUNTERS = sq.listed(COUNTERS)
_DELTA_SELECT = f"SELECT {sq.listed(sq.DELTA_COLUMNS)} FROM "
_LOG_COLUMNS = f"server_id, collection_seq, collected_time, row_ordinal, schema_name, digest_text, {_COUNTERS}"
_DEDUPED_COLUMNS = f"server_id, collection_seq, collected_time, digest, schema_name, query_key, {_COUNTERS}"


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.clean(dv.event_snapshots(spark, sf_dir))


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.dedup(_cleaned(spark, sf_dir))


def _comparison(spark: SparkSession, sf_dir: str, **settings) -> cp.Comparison:
    return cp.Comparison(dv.stored_events(spark, sf_dir), _SERVERS, **settings)


# Sources


@query(
    sq.with_(_LOG)
    + f"SELECT server_id, collection_seq, md5(digest_text) AS md5_digest, schema_name, digest_text, {_COUNTERS} FROM snapshots"
)
def scan_digest_table(spark, sf_dir):
    return scan_digest(dv.event_snapshots(spark, sf_dir))


@query(sq.with_(_LOG) + f"SELECT {_LOG_COLUMNS} FROM snapshots")
def snapshot_log(spark, sf_dir):
    log = dv.event_snapshots(spark, sf_dir)
    return plain_times(log.where(F.col("server_id").isin(*_SERVERS)))


_CLEAN_WHERE = "digest_text LIKE '%c%' AND coalesce(schema_name, '') <> 'performance_schema'"


@query(sq.with_(_LOG, sq.keyed(_CLEAN_WHERE), sq.deduped()) + f"SELECT {_DEDUPED_COLUMNS} FROM deduped")
def collect_clean(spark, sf_dir):
    log = dv.event_snapshots(spark, sf_dir)
    return plain_times(cl.collect_clean(log, query_filter="c", ignore_performance_schema=True))


_SERVER_COLUMNS = 'server_id, "user", host, name, short_name, version, uptime_s'


@query(sq.with_(sq.CUSTOMER_SERVERS, sq.server_names("servers")) + f"SELECT {_SERVER_COLUMNS} FROM server_dim")
def server_dimension(spark, sf_dir):
    return server_dim(dv.customer_servers(spark, sf_dir))


# Keys and filters


@query(
    sq.with_(*_KEYED)
    + f"SELECT server_id, collection_seq, row_ordinal, digest, schema_name, {sq.QUERY_KEY} AS query_key FROM keyed"
)
def query_keys(spark, sf_dir):
    keyed = scan_keys(dv.event_snapshots(spark, sf_dir))
    return keyed.select(
        "server_id", "collection_seq", "row_ordinal", "digest", "schema_name", query_key().alias("query_key")
    )


@query(sq.with_(_LOG) + f"SELECT {_LOG_COLUMNS} FROM snapshots WHERE digest_text LIKE '%T c_i%'")
def filter_text(spark, sf_dir):
    return plain_times(cl.filter_text(dv.event_snapshots(spark, sf_dir), "T c_i"))


@query(
    sq.with_(_LOG)
    + f"SELECT {_LOG_COLUMNS} FROM snapshots WHERE coalesce(schema_name, '') <> 'performance_schema'"
)
def filter_schema(spark, sf_dir):
    return plain_times(cl.filter_schema(dv.event_snapshots(spark, sf_dir), True))


@query(
    sq.with_(sq.idle_snapshots())
    + """SELECT server_id, collection_seq, row_ordinal, schema_name, digest_text,
         count_star = 0 AND sum_timer_wait = 0 AS is_empty FROM snapshots"""
)
def empty_rows(spark, sf_dir):
    log = dv.idle_snapshots(spark, sf_dir)
    return log.select(
        "server_id", "collection_seq", "row_ordinal", "schema_name", "digest_text", is_empty().alias("is_empty")
    )


# Duplicates


@query(sq.with_(*_DEDUPED) + f"SELECT {_DEDUPED_COLUMNS} FROM deduped")
def dedup(spark, sf_dir):
    return plain_times(_deduped(spark, sf_dir))


@query(sq.with_(*_IDLE, sq.deduped()) + f"SELECT {_DEDUPED_COLUMNS} FROM deduped")
def dedup_idle(spark, sf_dir):
    return plain_times(cl.collect_clean(dv.idle_snapshots(spark, sf_dir)))


@query(
    sq.with_(*_IDLE)
    + f"""SELECT server_id, collection_seq, query_key, n_empty, n_busy,
       CASE WHEN n_busy > 1 THEN 'added' WHEN n_busy = 1 THEN 'kept_busy_row' ELSE 'kept_last_empty_row' END AS branch
  FROM (SELECT server_id, collection_seq, {sq.QUERY_KEY} AS query_key,
               count(*) FILTER (WHERE count_star = 0 AND sum_timer_wait = 0) AS n_empty,
               count(*) FILTER (WHERE NOT (count_star = 0 AND sum_timer_wait = 0)) AS n_busy
        FROM keyed GROUP BY 1, 2, 3)
  WHERE n_empty + n_busy > 1"""
)
def dedup_audit(spark, sf_dir):
    return cl.dedup_audit(scan_keys(dv.idle_snapshots(spark, sf_dir)))


_RARE = "digest_text LIKE '%purchase%' AND coalesce(schema_name, '') <> 'performance_schema'"
_SIZES = f"""index AS (SELECT DISTINCT server_id, collection_seq FROM snapshots),
sizes AS (
  SELECT i.server_id, i.collection_seq, count(d.digest) AS n_rows
  FROM index i LEFT JOIN deduped d ON i.server_id = d.server_id AND i.collection_seq = d.collection_seq
  GROUP BY i.server_id, i.collection_seq)"""


def _collection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = dv.stored_events(spark, sf_dir)
    filtered = cl.collect_clean(log, query_filter="purchase", ignore_performance_schema=True)
    return cl.collection_rows(filtered, cl.snapshot_index(log))


@query(sq.with_(_LOG, sq.keyed(_RARE), sq.deduped(), _SIZES) + "SELECT * FROM sizes")
def collection_rows(spark, sf_dir):
    return _collection_rows(spark, sf_dir)


@query(
    sq.with_(_LOG, sq.keyed(_RARE), sq.deduped(), _SIZES)
    + """SELECT server_id, count(*) AS n_collections, min_by(n_rows, collection_seq) AS first_rows,
         max_by(n_rows, collection_seq) AS last_rows FROM sizes GROUP BY server_id"""
)
def collection_sizes(spark, sf_dir):
    return cl.collection_sizes(_collection_rows(spark, sf_dir))


# Dictionary


@query(
    sq.with_(_LOG, sq.ALL_TEXTS)
    + f"""SELECT {sq.QUERY_KEY} AS query_key, min(digest_text) AS digest_text FROM all_texts
      GROUP BY 1"""
)
def query_dictionary(spark, sf_dir):
    return di.query_dictionary(dv.event_snapshots(spark, sf_dir))


_CONFLICTS = """SELECT query_key, count(DISTINCT digest_text) AS n_texts, min(digest_text) AS first_text,
  max(digest_text) AS last_text FROM texts GROUP BY query_key HAVING count(DISTINCT digest_text) > 1"""


@query(
    sq.with_(_LOG, sq.ALL_TEXTS, f"texts AS (SELECT {sq.QUERY_KEY} AS query_key, digest_text FROM all_texts)")
    + _CONFLICTS
)
def dictionary_conflicts(spark, sf_dir):
    keyed = scan_keys(dv.event_snapshots(spark, sf_dir))
    return di.dictionary_conflicts(keyed.select(query_key().alias("query_key"), "digest_text"))


@query(
    sq.with_(
        sq.lineitem_snapshots(),
        "texts AS (SELECT left(md5(digest_text), 2) AS query_key, digest_text FROM snapshots)",
    )
    + _CONFLICTS
)
def dictionary_conflicts_short_digest(spark, sf_dir):
    """Digests cut to two characters stand for several texts each."""
    keyed = scan_keys(dv.lineitem_snapshots(spark, sf_dir))
    return di.dictionary_conflicts(keyed.select(F.left("digest", F.lit(2)).alias("query_key"), "digest_text"))


# Deltas


@query(sq.with_(*_DELTAS) + _DELTA_SELECT + "deltas")
def deltas(spark, sf_dir):
    return plain_times(dl.deltas(_deduped(spark, sf_dir)))


@query(sq.with_(*_DELTAS) + _DELTA_SELECT + "deltas")
def deltas_join(spark, sf_dir):
    return plain_times(dl.deltas_join(_deduped(spark, sf_dir)))


_REJECTED = "outcome IN ('zero_duration', 'reset')"


@query(
    sq.with_(*_DELTAS)
    + f"SELECT {sq.listed(sq.DELTA_COLUMNS)}, outcome AS reason FROM pairs WHERE {_REJECTED}"
)
def delta_rejects(spark, sf_dir):
    return plain_times(dl.delta_rejects(dl.adjacent_pairs(_deduped(spark, sf_dir))))


@query(
    sq.with_(*_IDLE, sq.deduped(), sq.deltas())
    + "SELECT server_id, sample_seq, outcome, count(*) AS n FROM pairs GROUP BY ALL"
)
def delta_outcomes(spark, sf_dir):
    pairs = dl.adjacent_pairs(cl.collect_clean(dv.idle_snapshots(spark, sf_dir)))
    return pairs.groupBy("server_id", "sample_seq", "outcome").agg(F.count("*").alias("n"))


@query(sq.with_(*_DEDUPED, sq.period()) + _DELTA_SELECT + "period")
def first_last(spark, sf_dir):
    log = dv.stored_events(spark, sf_dir)
    return plain_times(dl.first_last(dl.at_ends(cl.clean(log), log)))


_WIDE_COUNTERS = (*COUNTERS, *EXTRA_COUNTERS)


@query(
    sq.with_(
        sq.event_snapshots(extra=True),
        sq.keyed(counters=_WIDE_COUNTERS),
        sq.deduped(_WIDE_COUNTERS),
        sq.deltas(_WIDE_COUNTERS),
    )
    + f"SELECT {sq.listed([*sq.DELTA_COLUMNS, *EXTRA_COUNTERS])} FROM deltas"
)
def deltas_wide(spark, sf_dir):
    log = dv.event_snapshots(spark, sf_dir, extra=True)
    return plain_times(dl.deltas(cl.collect_clean(log, counters=_WIDE_COUNTERS), _WIDE_COUNTERS))


@query(
    sq.with_(*_DELTAS)
    + f"""SELECT server_id, sample_seq, query_key,
         {sq.rounded("(sum_timer_wait // 1000) / 1e9 / count_star")} AS latency_s FROM deltas"""
)
def latencies(spark, sf_dir):
    samples = dl.deltas(_deduped(spark, sf_dir)).withColumn("latency_s", latency())
    return samples.select("server_id", "sample_seq", "query_key", rounded("latency_s"))


@query(
    sq.with_(_LOG)
    + "SELECT server_id, count(DISTINCT collection_seq) - 1 AS n_samples FROM snapshots GROUP BY server_id"
)
def sample_counts(spark, sf_dir):
    return cl.sample_counts(dv.event_snapshots(spark, sf_dir))


# Ranking


@query(
    sq.with_(_COMPARED) + "SELECT query_rank, digest, schema_name, query_key, sum_timer_wait FROM topkeys"
)
def topn(spark, sf_dir):
    return _comparison(spark, sf_dir).top_keys


@query(
    sq.with_(_COMPARED)
    + f"""SELECT query_rank, query_key, digest_text, sum_timer_wait,
          {sq.picosecond_time("sum_timer_wait")} AS elapsed FROM top_texts"""
)
def topn_text(spark, sf_dir):
    return rp.topn_elapsed(_comparison(spark, sf_dir).top_texts)


_STATUS = """SELECT 0 AS server_id, p.n AS active_keys, s.n AS n_samples, p.n = 0 AS idle, s.n = 0 AS no_data
FROM (SELECT count(*) AS n FROM period WHERE server_id = 0) p,
     (SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(DISTINCT collection_seq) - 1 AS n FROM snapshots GROUP BY server_id)) s"""


def _status(spark: SparkSession, sf_dir: str, query_filter: str) -> DataFrame:
    log = dv.stored_events(spark, sf_dir)
    period = cp.Comparison(log, _SERVERS, query_filter=query_filter).period()
    return idle_status(period, log, _SERVERS[0])


@query(sq.with_(*_DEDUPED, sq.period()) + _STATUS)
def run_status(spark, sf_dir):
    return _status(spark, sf_dir, "")


@query(sq.with_(_LOG, sq.keyed("digest_text LIKE '%no such text%'"), sq.deduped(), sq.period()) + _STATUS)
def run_status_idle(spark, sf_dir):
    return _status(spark, sf_dir, "no such text")


# Metrics


def _rounded_stats(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.select(*ids, "metric_ord", "metric", "n", *[rounded(c) for c in ("avg", "stddev", "min", "max")])


_STAT_SQL = f"""SELECT server_id, digest, schema_name, metric_ord, metric, count(*) AS n,
  {sq.rounded("avg(value)")} AS avg, {sq.rounded("stddev_pop(value)")} AS stddev,
  {sq.rounded("min(value)")} AS min, {sq.rounded("max(value)")} AS max
FROM metric_values GROUP BY server_id, digest, schema_name, metric_ord, metric"""
_KEY_VALUES = sq.metric_values("deltas", "server_id, digest, schema_name")


@query(sq.with_(*_DELTAS, _KEY_VALUES) + _STAT_SQL)
def metric_stats(spark, sf_dir):
    stats = cp.all_key_stats(dv.event_snapshots(spark, sf_dir))
    return _rounded_stats(stats, ["server_id", "digest", "schema_name"])


@query(
    sq.with_(_COMPARED)
    + f"""SELECT DISTINCT g.query_rank, g.query_key, g.server_id, v.sample_seq, g.metric_ord, g.metric,
          {sq.rounded("v.value")} AS value
          FROM grid g LEFT JOIN metric_values v ON v.query_rank = g.query_rank
           AND v.server_id = g.server_id AND v.metric_ord = g.metric_ord"""
)
def metrics_long(spark, sf_dir):
    values = _comparison(spark, sf_dir).values()
    return values.select(
        "query_rank", "query_key", "server_id", "sample_seq", "metric_ord", "metric", rounded("value")
    )


@query(
    sq.with_(_COMPARED)
    + """SELECT query_rank, server_id, 0 AS chunk_no, metric_ord, metric, count(*) AS n_values,
         string_agg(CAST(CAST(round(value * 1e9) AS BIGINT) AS VARCHAR), ',' ORDER BY sample_seq) AS nano_values
         FROM metric_values GROUP BY query_rank, server_id, metric_ord, metric"""
)
def metrics_arrays(spark, sf_dir):
    series = _comparison(spark, sf_dir).arrays()
    nanos = F.transform("values", lambda v: F.round(v * F.lit(1e9)).cast("bigint").cast("string"))
    return series.select(
        "query_rank",
        "server_id",
        "chunk_no",
        "metric_ord",
        "metric",
        F.size("values").cast("bigint").alias("n_values"),
        F.array_join(nanos, ",").alias("nano_values"),
    )


# Comparison


def _rounded_wide(wide: DataFrame, server_ids) -> DataFrame:
    cells = [c for s in server_ids for c in (f"n_{s}", f"avg_{s}", f"stddev_{s}")]
    return wide.select(
        "query_rank",
        "query_key",
        "metric_ord",
        "metric",
        *[F.col(c) if c.startswith("n_") else rounded(c) for c in cells],
    )


def _wide_sql(server_ids) -> str:
    cells = ", ".join(
        f"n_{s}, {sq.rounded(f'avg_{s}')} AS avg_{s}, {sq.rounded(f'stddev_{s}')} AS stddev_{s}"
        for s in server_ids
    )
    return f"SELECT query_rank, query_key, metric_ord, metric, {cells} FROM wide"


@query(sq.with_(_COMPARED) + _wide_sql(_SERVERS))
def compare_servers(spark, sf_dir):
    wide = _comparison(spark, sf_dir).wide()
    return _rounded_wide(wide, _SERVERS)


@query(
    sq.with_(sq.compared(_LOG, (1, 0), "coalesce(schema_name, '') <> 'performance_schema'", 12))
    + _wide_sql((1, 0))
)
def compare_wide(spark, sf_dir):
    """The other server ranks, its own monitoring left out, more queries."""
    log = dv.stored_events(spark, sf_dir)
    wide = cp.compare_servers(log, (1, 0), top_n=12, ignore_performance_schema=True)
    return _rounded_wide(wide, (1, 0))


@query(sq.with_(sq.compared(_LOG, (1,))) + _wide_sql((1,)))
def profile_server(spark, sf_dir):
    return _rounded_wide(cp.profile_server(dv.stored_events(spark, sf_dir), 1), (1,))


@query(
    sq.with_(_COMPARED)
    + f"""SELECT query_rank, query_key, metric_ord, metric, {sq.rounded("avg_0")} AS avg_0,
          {sq.rounded("CASE WHEN avg_0 <> 0 THEN (avg_1 - avg_0) / avg_0 * 100 END")} AS pct_1 FROM wide"""
)
def compare_pct(spark, sf_dir):
    pct = cp.compare_pct(_comparison(spark, sf_dir).wide(), _SERVERS)
    return pct.select(
        "query_rank", "query_key", "metric_ord", "metric", rounded("avg_0"), rounded("pct_1")
    )


@query(
    sq.with_(
        _COMPARED,
        """history AS (
  SELECT server_id, coalesce(md5(digest_text), '') AS digest, coalesce(schema_name, '') AS schema_name,
         CASE WHEN v > 80 THEN 1205 WHEN v > 40 THEN 1213 ELSE 0 END AS errno,
         CASE WHEN v > 40 THEN 1 ELSE 0 END AS errors, CASE WHEN v > 20 THEN 1 ELSE 0 END AS warnings
  FROM base),
found AS (
  SELECT server_id, digest, schema_name, errno, count(*) AS n_statements, CAST(sum(errors) AS BIGINT) AS errors,
         CAST(sum(warnings) AS BIGINT) AS warnings
  FROM history WHERE errors > 0 OR warnings > 0 GROUP BY ALL)""",
    )
    + """SELECT t.query_rank, t.query_key, f.server_id, f.errno, coalesce(n_statements, 0) AS n_statements,
         coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings
         FROM topkeys t LEFT JOIN found f ON t.digest = f.digest AND t.schema_name = f.schema_name"""
)
def error_detail(spark, sf_dir):
    history = scan_keys(dv.errors_by_statement(spark, sf_dir))
    return cp.error_detail(history, _comparison(spark, sf_dir).top_keys)


# Text


@query(
    sq.with_(*_DELTAS, _KEY_VALUES, f"stats AS ({_STAT_SQL})")
    + f"""SELECT server_id, digest, schema_name, metric, {sq.float_number("avg")} AS avg_text,
          {sq.float_number("stddev")} AS stddev_text, {sq.float_number("-min")} AS negative_text FROM stats"""
)
def fmt_number(spark, sf_dir):
    stats = metric_stats(spark, sf_dir).withColumn("negative", -F.col("min"))
    return stats.select(
        "server_id",
        "digest",
        "schema_name",
        "metric",
        float_number("avg").alias("avg_text"),
        float_number("stddev").alias("stddev_text"),
        float_number("negative").alias("negative_text"),
    )


_SCALES = (1.0, 1e-3, 1e-6, 1e-9)
_LATENCY_TABLE = f"""latencies AS (
  SELECT server_id, sample_seq, query_key, {sq.rounded("(sum_timer_wait // 1000) / 1e9 / count_star")} AS s
  FROM deltas)"""


@query(
    sq.with_(*_DELTAS, _LATENCY_TABLE)
    + "SELECT server_id, sample_seq, query_key, "
    + ", ".join(f"{sq.float_time(f'(s * {x}::DOUBLE)')} AS text_{i}" for i, x in enumerate(_SCALES))
    + f", {sq.float_time('(s * 1000)')} AS text_up FROM latencies"
)
def fmt_time(spark, sf_dir):
    """Latencies, also scaled up and down so that every unit occurs."""
    factors = dict(enumerate(_SCALES)) | {"up": 1000.0}
    scaled = {f"s_{i}": F.col("latency_s") * F.lit(x) for i, x in factors.items()}
    return (
        latencies(spark, sf_dir)
        .withColumns(scaled)
        .select("server_id", "sample_seq", "query_key", *[float_time(f"s_{i}").alias(f"text_{i}") for i in factors])
    )


_PICO_STEPS = (1, 10**3, 10**6, 10**9, 10**12)


@query(
    sq.with_(*_DELTAS)
    + "SELECT server_id, sample_seq, query_key, "
    + ", ".join(f"{sq.picosecond_time(f'(sum_timer_wait // {x})')} AS text_{i}" for i, x in enumerate(_PICO_STEPS))
    + f", {sq.picosecond_time('(sum_timer_wait * 1000)')} AS text_up FROM deltas"
)
def fmt_ps(spark, sf_dir):
    """Elapsed times, also scaled up and down so that every unit occurs."""
    df = dl.deltas(_deduped(spark, sf_dir))
    for i, step in enumerate(_PICO_STEPS):
        df = df.withColumn(f"ps_{i}", F.expr(f"sum_timer_wait div {step}"))
    df = df.withColumn("ps_up", F.col("sum_timer_wait") * 1000)
    return df.select(
        "server_id",
        "sample_seq",
        "query_key",
        *[picosecond_time(f"ps_{i}").alias(f"text_{i}") for i in range(len(_PICO_STEPS))],
        picosecond_time("ps_up").alias("text_up"),
    )


def _report_sql(server_ids) -> str:
    names = "\n  UNION ALL ".join(
        f"SELECT {i} AS pos, coalesce((SELECT short_name FROM server_dim WHERE server_id = {s}), '') AS short_name"
        for i, s in enumerate(server_ids)
    )
    cells = ", ' | ', ".join(
        sq.padded(sq.metric_cell(f"avg_{s}", f"stddev_{s}"), 39) for s in server_ids
    )
    heading = sq.padded("concat('  Avg ', metric, ':')", 19)
    return f"""SELECT 0 AS query_rank, 0 AS line_no, concat('Looking at top ', count(*), ' queries') AS line FROM topkeys
UNION ALL SELECT query_rank, 1, concat('Query ', query_rank, ': ', digest_text) FROM top_texts
UNION ALL SELECT t.query_rank, 2, concat('Server:            ', s.names) FROM topkeys t,
  (SELECT string_agg({sq.padded("short_name", 40)}, ' | ' ORDER BY pos) AS names FROM ({names})) s
UNION ALL SELECT query_rank, metric_ord + 2, concat({heading}, ' ', {cells}) FROM wide"""


_EVENT_NAMES = [sq.EVENT_SERVERS, sq.server_names("servers")]


@query(sq.with_(_COMPARED, *_EVENT_NAMES) + _report_sql(_SERVERS))
def report_lines(spark, sf_dir):
    comparison = _comparison(spark, sf_dir)
    servers = server_dim(dv.event_servers(spark, sf_dir))
    return rp.report_lines(comparison.metrics(), comparison.top_texts, servers, _SERVERS)


@query(
    sq.with_(_COMPARED, *_EVENT_NAMES)
    + f"""SELECT server_id, 0 AS query_rank, 0 AS line_no,
  concat('Host: ', name, ' / ', version, '. Have ',
         (SELECT count(DISTINCT collection_seq) - 1 FROM snapshots x WHERE x.server_id = d.server_id),
         ' entries. Looking at top ', (SELECT count(*) FROM topkeys), ' queries') AS line
FROM server_dim d
UNION ALL SELECT DISTINCT server_id, query_rank, 0, concat('Query ', query_rank, ':') FROM metrics
UNION ALL SELECT server_id, query_rank, metric_ord, concat('  Avg ', metric, ': ', {sq.metric_cell("avg", "stddev")})
FROM metrics"""
)
def server_listing(spark, sf_dir):
    log = dv.stored_events(spark, sf_dir)
    servers = server_dim(dv.event_servers(spark, sf_dir))
    metrics = cp.Comparison(log, _SERVERS).metrics()
    return rp.server_listing(metrics, servers, cl.sample_counts(log))


def _dump_sql(pairs) -> str:
    return "concat(" + ", ', ', ".join(f"'{name}: ', {column}" for name, column in pairs) + ")"


@query(
    sq.with_(*_DEDUPED)
    + "SELECT server_id, collection_seq, query_key, "
    + _dump_sql([("MD5_DIGEST", "digest"), ("SCHEMA", "schema_name"), *[(c.upper(), c) for c in COUNTERS]])
    + " AS line FROM deduped"
)
def row_dump(spark, sf_dir):
    return rp.dump_events(_deduped(spark, sf_dir), COUNTERS)


_SAMPLE_FIELDS = ["sum_timer_wait", "count_star", *COUNTERS[2:]]


@query(
    sq.with_(*_DELTAS)
    + "SELECT server_id, sample_seq, query_key, "
    + _dump_sql([("Key", "query_key"), *[(c.upper(), c) for c in _SAMPLE_FIELDS]])
    + " AS line FROM deltas"
)
def sample_dump(spark, sf_dir):
    return rp.dump_samples(dl.deltas(_deduped(spark, sf_dir)))


@query(
    sq.with_(
        sq.event_snapshots(extra=True), sq.keyed(counters=_WIDE_COUNTERS), sq.deduped(_WIDE_COUNTERS), sq.deltas(_WIDE_COUNTERS)
    )
    + "\nUNION ALL ".join(
        f"""SELECT server_id, digest, schema_name, {len(METRIC_NAMES) + i} AS metric_ord, '{c}' AS metric, count(*) AS n,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM deltas GROUP BY ALL"""
        for i, c in enumerate(EXTRA_COUNTERS, start=1)
    )
)
def metric_stats_wide(spark, sf_dir):
    """Counters beyond the default ten are metrics of their own name."""
    stats = cp.all_key_stats(dv.event_snapshots(spark, sf_dir, extra=True), _WIDE_COUNTERS)
    extra = stats.where(F.col("metric_ord") > len(METRIC_NAMES))
    return extra.select("server_id", "digest", "schema_name", "metric_ord", "metric", "n", "min", "max")


@query(
    sq.with_(_COMPARED)
    + """SELECT query_rank, server_id, sample_seq // 4 AS chunk_no, metric_ord, metric, count(*) AS n_values
         FROM metric_values WHERE sample_seq IS NOT NULL GROUP BY ALL"""
)
def metrics_arrays_chunked(spark, sf_dir):
    """Series in chunks of four samples."""
    series = _comparison(spark, sf_dir).arrays(chunk=4).where(F.size("values") > 0)
    n = F.size("values").cast("long").alias("n_values")
    return series.select("query_rank", "server_id", "chunk_no", "metric_ord", "metric", n)


# Streaming


@query(sq.with_(*_DELTAS) + _DELTA_SELECT + "deltas")
def stream_deltas(spark, sf_dir):
    """The log arrives in two halves; the second run resumes from what the first one remembered."""
    root = shared_folder(spark, "stream")
    stream = SampleStream(f"{root}/in", f"{root}/out", f"{root}/memory")
    log = dv.event_snapshots(spark, sf_dir)
    early = F.col("collection_seq") <= 15
    for part in (early, ~early):
        log.where(part).write.mode("append").parquet(stream.source)
        stream.start(spark).awaitTermination()
    return plain_times(stream.results(spark))


@query(sq.with_(*_DELTAS) + _DELTA_SELECT + "deltas")
def stream_deltas_split(spark, sf_dir):
    """Snapshots 10 and 20 come in two parts, in two runs."""
    root = shared_folder(spark, "stream")
    stream = SampleStream(f"{root}/in", f"{root}/out", f"{root}/memory")
    half = F.when(F.pmod(F.xxhash64("digest_text"), F.lit(2)) == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    place = F.col("collection_seq") + half
    log = dv.event_snapshots(spark, sf_dir)
    for part in (place <= 10, (place > 10) & (place <= 20), place > 20):
        log.where(part).write.mode("append").parquet(stream.source)
        stream.start(spark).awaitTermination()
    return plain_times(stream.results(spark))


@query(sq.with_(*_DELTAS) + _DELTA_SELECT + "deltas")
def stream_deltas_repeated(spark, sf_dir):
    """The second half comes twice in one run, and its end once more in the next one."""
    root = shared_folder(spark, "stream")
    stream = SampleStream(f"{root}/in", f"{root}/out", f"{root}/memory")
    log = dv.event_snapshots(spark, sf_dir)
    seq = F.col("collection_seq")
    for runs in ([seq <= 15], [seq > 15, seq > 15], [seq > 15]):
        for part in runs:
            log.where(part).write.mode("append").parquet(stream.source)
        stream.start(spark).awaitTermination()
    return plain_times(stream.results(spark))


_DAY = 86400


def _state_stream(spark: SparkSession, lateness_days: int) -> StateStream:
    root = shared_folder(spark, "stream")
    return StateStream(f"{root}/in", f"{root}/out", f"{root}/checkpoint", lateness_days * _DAY, 3 * _DAY)


@query(sq.with_(*_DELTAS) + _DELTA_SELECT + "deltas")
def stream_state_deltas(spark, sf_dir):
    """The log lies in five parts cut by text, each with all snapshots, and they come from the last to the first.

    Snapshots stay open for 400 days and are closed by the stream's end mark.
    """
    stream = _state_stream(spark, 400)
    log = dv.event_snapshots(spark, sf_dir)
    part = F.pmod(F.xxhash64("digest_text", "row_ordinal"), F.lit(5))
    for i in (4, 3, 2, 1, 0):
        log.where(part == i).write.mode("append").parquet(stream.source)
    stream.start(spark).awaitTermination()
    stream.close(spark)
    stream.start(spark).awaitTermination()
    return plain_times(stream.results(spark))


_HELD_BACK = "(collection_seq IN (12, 18) AND row_ordinal = 1)"


@query(
    sq.with_(*_KEYED, f"arrival AS (SELECT *, CASE WHEN {_HELD_BACK} OR collection_seq > 20 THEN 2 ELSE 1 END AS run FROM keyed)")
    + f"""SELECT server_id, collection_seq, collected_time, row_ordinal, digest, schema_name, {_COUNTERS},
      'snapshot is closed: late or delivered again' AS reason
    FROM arrival WHERE run = 2
      AND collected_time <= (SELECT max(collected_time) FROM arrival WHERE run = 1) - INTERVAL 3 DAY"""
)
def stream_late(spark, sf_dir):
    """A row each of snapshots 12 and 18 comes after snapshot 20, when three days' worth is still open: that of 12 is late."""
    stream = _state_stream(spark, 3)
    log = dv.event_snapshots(spark, sf_dir)
    second = F.expr(_HELD_BACK) | (F.col("collection_seq") > 20)
    for part in (~second, second):
        log.where(part).write.mode("append").parquet(stream.source)
        stream.start(spark).awaitTermination()
    return plain_times(stream.late_rows(spark))


# The same jobs on the log that grows with the data

_ITEM_SERVERS = dv.LINEITEM_SERVERS
_ITEM_LOG = sq.lineitem_snapshots()
_ITEM_DELTAS = [_ITEM_LOG, sq.keyed(), sq.deduped(), sq.deltas()]
_ITEM_COMPARED = sq.compared(_ITEM_LOG, _ITEM_SERVERS)


@query(sq.with_(_ITEM_LOG) + f"SELECT {_LOG_COLUMNS} FROM snapshots")
def lineitem_snapshot_log(spark, sf_dir):
    return plain_times(dv.lineitem_snapshots(spark, sf_dir))


@query(sq.with_(*_ITEM_DELTAS) + _DELTA_SELECT + "deltas")
def lineitem_deltas(spark, sf_dir):
    return plain_times(dl.deltas(cl.collect_clean(dv.lineitem_snapshots(spark, sf_dir))))


@query(sq.with_(*_ITEM_DELTAS, _KEY_VALUES) + _STAT_SQL)
def lineitem_metric_stats(spark, sf_dir):
    stats = cp.all_key_stats(dv.lineitem_snapshots(spark, sf_dir))
    return _rounded_stats(stats, ["server_id", "digest", "schema_name"])


@query(
    sq.with_(_ITEM_COMPARED) + "SELECT query_rank, digest, schema_name, query_key, sum_timer_wait FROM topkeys"
)
def lineitem_topn(spark, sf_dir):
    return cp.Comparison(dv.stored_lineitem(spark, sf_dir), _ITEM_SERVERS).top_keys


@query(sq.with_(_ITEM_COMPARED) + _wide_sql(_ITEM_SERVERS))
def lineitem_compare(spark, sf_dir):
    wide = cp.compare_servers(dv.stored_lineitem(spark, sf_dir), _ITEM_SERVERS)
    return _rounded_wide(wide, _ITEM_SERVERS)


# Names of the operator inventory that would shadow an import above.
for _public, _function in {
    "scan_digest": "scan_digest_table",
    "server_dim": "server_dimension",
    "query_key": "query_keys",
    "latency": "latencies",
    "idle_status": "run_status",
    "idle_status_filtered": "run_status_idle",
    "is_empty": "empty_rows",
}.items():
    REGISTRY[_public] = REGISTRY.pop(_function)
