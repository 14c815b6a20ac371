"""The SQL each registered query is checked against.

Written for DuckDB over the same parquet tables. The steps are chained as common table expressions; deltas
come from a self-join here, where the library uses a window.
"""

from __future__ import annotations

from counterscope.schema import COUNTERS, EXTRA_COUNTERS, METRIC_NAMES

_EXTRA_SUMS = {c: f"sum(CASE WHEN k % {i + 2} = 0 THEN 1 ELSE 0 END)" for i, c in enumerate(EXTRA_COUNTERS)}

_EVENT_SUMS = {
    "count_star": "count(*)",
    "sum_timer_wait": "sum(timer_ps)",
    "sum_errors": "sum(CASE WHEN v > 40 THEN 1 ELSE 0 END)",
    "sum_warnings": "sum(CASE WHEN v > 20 THEN 1 ELSE 0 END)",
    "sum_rows_affected": "sum(CASE WHEN et = 'purchase' THEN 1 ELSE 0 END)",
    "sum_rows_sent": "sum(k)",
    "sum_rows_examined": "sum(3*k)",
    "sum_select_scan": "sum(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)",
    "sum_no_index_used": "sum(CASE WHEN k < 20 THEN 1 ELSE 0 END)",
    "sum_no_good_index_used": "sum(CASE WHEN k = 7 THEN 1 ELSE 0 END)",
}

_EMPTY = "(count_star = 0 AND sum_timer_wait = 0)"
QUERY_KEY = "CASE WHEN schema_name <> '' THEN concat(digest, '.', schema_name) ELSE digest END"


def listed(names) -> str:
    return ", ".join(names)


STATEMENTS = """base AS (
  SELECT CAST(user_id % 2 AS INT) AS server_id,
         CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN 'performance_schema'
              ELSE concat('app', CAST(user_id % 3 AS VARCHAR)) END AS schema_name,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('SELECT ', event_type, ' WHERE k = ?') END
           AS digest_text,
         CAST(event_id % 2 AS INT) AS shard, date_trunc('day', ts) AS collected_time,
         CAST(round(value*100) AS BIGINT)*10000000 AS timer_ps, event_type AS et, value AS v,
         CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS k
  FROM events)"""


def event_snapshots(extra: bool = False) -> str:
    sums = _EVENT_SUMS | (_EXTRA_SUMS if extra else {})
    day = ", ".join(f"{s} AS {c}" for c, s in sums.items())
    running = ", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS {c}" for c in sums)
    return f"""{STATEMENTS},
day AS (
  SELECT server_id, collected_time, schema_name, digest_text, shard, {day}
  FROM base GROUP BY server_id, collected_time, schema_name, digest_text, shard),
snapshots AS (
  SELECT server_id,
         CAST(dense_rank() OVER (PARTITION BY server_id ORDER BY collected_time) AS INT) AS collection_seq,
         collected_time, CAST(shard AS BIGINT) AS row_ordinal, schema_name, digest_text, {running}
  FROM day
  WINDOW w AS (PARTITION BY server_id, schema_name, digest_text, shard ORDER BY collected_time
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def idle_snapshots() -> str:
    idle = "(day(collected_time) % 3 = row_ordinal OR day(collected_time) % 5 = 0)"
    changed = ", ".join(f"CASE WHEN {idle} THEN 0 ELSE {c} END AS {c}" for c in COUNTERS[:2])
    log = event_snapshots().replace("snapshots AS (", "full_log AS (")
    return f"""{log},
snapshots AS (
  SELECT server_id, collection_seq, collected_time, row_ordinal, schema_name, digest_text, {changed},
         {listed(COUNTERS[2:])}
  FROM full_log)"""


def lineitem_snapshots() -> str:
    absent = ", ".join(
        f"CAST(0 AS BIGINT) AS {c}"
        for c in COUNTERS
        if c not in ("count_star", "sum_timer_wait", "sum_rows_sent")
    )
    return f"""m AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS server_id,
         date_trunc('month', l_shipdate) AS collected_time, l_linestatus AS schema_name,
         concat('SUPP ', CAST(l_suppkey AS VARCHAR)) AS digest_text,
         count(*) AS c, sum(CAST(round(l_extendedprice*100) AS BIGINT)*1000000) AS t,
         sum(CAST(l_quantity AS BIGINT)) AS r
  FROM lineitem GROUP BY 1,2,3,4),
snapshots AS (
  SELECT server_id,
         CAST(dense_rank() OVER (PARTITION BY server_id ORDER BY collected_time) AS INT) AS collection_seq,
         collected_time, CAST(0 AS BIGINT) AS row_ordinal, schema_name, digest_text,
         CAST(sum(c) OVER w AS BIGINT) AS count_star, CAST(sum(t) OVER w AS BIGINT) AS sum_timer_wait,
         CAST(sum(r) OVER w AS BIGINT) AS sum_rows_sent, {absent}
  FROM m
  WINDOW w AS (PARTITION BY server_id, schema_name, digest_text ORDER BY collected_time
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def keyed(where: str = "TRUE", counters=COUNTERS) -> str:
    return f"""keyed AS (
  SELECT server_id, collection_seq, collected_time, row_ordinal, digest_text,
         coalesce(schema_name, '') AS schema_name, coalesce(md5(digest_text), '') AS digest,
         {listed(counters)}
  FROM snapshots WHERE {where})"""


def deduped(counters=COUNTERS) -> str:
    merged = ", ".join(
        f"CAST(coalesce(sum({c}) FILTER (WHERE NOT {_EMPTY}), max_by({c}, row_ordinal)) AS BIGINT) AS {c}"
        for c in counters
    )
    return f"""deduped_raw AS (
  SELECT server_id, collection_seq, max(collected_time) AS collected_time, digest, schema_name, {merged}
  FROM keyed GROUP BY server_id, collection_seq, digest, schema_name),
deduped AS (SELECT *, {QUERY_KEY} AS query_key FROM deduped_raw)"""


def _differenced(source: str, counters) -> str:
    gaps = ", ".join(f"b.{c} - a.{c} AS {c}" for c in counters)
    negative = " OR ".join(f"b.{c} < a.{c}" for c in counters[2:])
    return f"""
  SELECT a.server_id, a.collection_seq AS sample_seq, a.collected_time AS start_time,
         date_diff('microsecond', a.collected_time, b.collected_time) / 1000000.0::DOUBLE AS duration_s,
         a.digest, a.schema_name, a.query_key, {gaps}, ({negative}) AS negative_counter,
         CASE WHEN b.count_star = 0 AND b.sum_timer_wait = 0 THEN 'empty'
              WHEN a.collected_time = b.collected_time THEN 'zero_duration'
              WHEN a.sum_timer_wait > b.sum_timer_wait OR a.count_star > b.count_star THEN 'reset'
              WHEN b.count_star > a.count_star AND b.sum_timer_wait > a.sum_timer_wait THEN 'kept'
              ELSE 'no_progress' END AS outcome
  FROM {source}"""


DELTA_COLUMNS = (
    "server_id",
    "sample_seq",
    "start_time",
    "duration_s",
    "digest",
    "schema_name",
    "query_key",
    *COUNTERS,
    "negative_counter",
)


def deltas(counters=COUNTERS) -> str:
    step = """deduped a JOIN deduped b ON a.server_id = b.server_id AND a.digest = b.digest
       AND a.schema_name = b.schema_name AND b.collection_seq = a.collection_seq + 1"""
    return f"""pairs AS ({_differenced(step, counters)}),
deltas AS (SELECT * EXCLUDE (outcome) FROM pairs WHERE outcome = 'kept')"""


def period(counters=COUNTERS) -> str:
    ends = """deduped a JOIN ends ON a.server_id = ends.server_id AND a.collection_seq = ends.first_seq
       JOIN deduped b ON b.server_id = ends.server_id AND b.collection_seq = ends.last_seq
       AND a.digest = b.digest AND a.schema_name = b.schema_name"""
    return f"""ends AS (
  SELECT server_id, min(collection_seq) AS first_seq, max(collection_seq) AS last_seq
  FROM snapshots GROUP BY server_id),
period AS (SELECT * EXCLUDE (outcome) FROM ({_differenced(ends, counters)}) WHERE outcome = 'kept')"""


def topkeys(base: int = 0, n: int = 5) -> str:
    return f"""topkeys AS (
  SELECT CAST(row_number() OVER (ORDER BY sum_timer_wait DESC, query_key) AS INT) AS query_rank,
         digest, schema_name, query_key, sum_timer_wait
  FROM period WHERE server_id = {base}
  ORDER BY sum_timer_wait DESC, query_key LIMIT {n}),
top_texts AS (
  SELECT t.*, coalesce((SELECT min(k.digest_text) FROM all_texts k
                        WHERE k.digest = t.digest AND k.schema_name = t.schema_name), '') AS digest_text
  FROM topkeys t)"""


ALL_TEXTS = """all_texts AS (
  SELECT DISTINCT coalesce(md5(digest_text), '') AS digest, coalesce(schema_name, '') AS schema_name,
         coalesce(digest_text, '') AS digest_text
  FROM snapshots)"""

_METRIC_SQL = dict(
    zip(
        METRIC_NAMES,
        (
            "CAST(count_star AS DOUBLE)",
            "count_star / duration_s",
            "(sum_timer_wait // 1000) / 1e9 / count_star",
            *[f"CAST({c} AS DOUBLE)" for c in COUNTERS[2:]],
        ),
        strict=True,
    )
)

_METRIC_STRUCTS = ", ".join(
    f"{{'metric_ord': {i}, 'metric': '{m}', 'value': {v}}}"
    for i, (m, v) in enumerate(_METRIC_SQL.items(), start=1)
)

METRIC_LIST = ", ".join(f"({i}, '{m}')" for i, m in enumerate(METRIC_NAMES, start=1))


def metric_values(source: str, ids: str) -> str:
    """Long rows of a delta table."""
    return f"""metric_values AS (
  SELECT {ids}, sample_seq, m.metric_ord, m.metric, m.value
  FROM (SELECT {ids}, sample_seq, unnest([{_METRIC_STRUCTS}]) AS m FROM {source}))"""


def samples() -> str:
    return "samples AS (SELECT t.query_rank, d.* FROM deltas d JOIN topkeys t USING (digest, schema_name))"


def grid(server_ids) -> str:
    servers = ", ".join(f"({s})" for s in server_ids)
    return f"""grid AS (
  SELECT t.query_rank, t.query_key, s.server_id, m.metric_ord, m.metric
  FROM topkeys t, (VALUES {servers}) s(server_id), (VALUES {METRIC_LIST}) m(metric_ord, metric)),
metrics AS (
  SELECT g.query_rank, g.query_key, g.server_id, g.metric_ord, g.metric, count(v.value) AS n,
         coalesce(avg(v.value), 0) AS avg, coalesce(stddev_pop(v.value), 0) AS stddev,
         coalesce(min(v.value), 0) AS min, coalesce(max(v.value), 0) AS max
  FROM grid g LEFT JOIN metric_values v
    ON v.query_rank = g.query_rank AND v.server_id = g.server_id AND v.metric_ord = g.metric_ord
  GROUP BY ALL)"""


def wide(server_ids) -> str:
    cells = ", ".join(
        f"max(CASE WHEN server_id = {s} THEN {c} END) AS {c}_{s}" for s in server_ids for c in ("n", "avg", "stddev")
    )
    return f"""wide AS (
  SELECT query_rank, query_key, metric_ord, metric, {cells}
  FROM metrics GROUP BY query_rank, query_key, metric_ord, metric)"""


def compared(log: str, server_ids, where: str = "TRUE", n: int = 5) -> str:
    """All steps from the log to the side-by-side table."""
    base = server_ids[0]
    return ",\n".join(
        [
            log,
            keyed(where),
            deduped(),
            deltas(),
            period(),
            ALL_TEXTS,
            topkeys(base, n),
            samples(),
            metric_values("samples", "query_rank, server_id"),
            grid(server_ids),
            wide(server_ids),
        ]
    )


def float_number(x: str) -> str:
    return f"""CASE WHEN {x} = 0 THEN '0' WHEN {x} >= 1000 THEN printf('%.2f k', {x} / 1000)
      WHEN {x} >= 100 THEN printf('%.0f', {x}) WHEN {x} >= 10 THEN printf('%.1f', {x})
      WHEN {x} >= 1 THEN printf('%.2f', {x}) WHEN {x} >= 0.1 THEN printf('%.3f', {x})
      WHEN {x} >= 0.01 THEN printf('%.4f', {x}) ELSE printf('%f', {x}) END"""


def float_time(x: str) -> str:
    return f"""CASE WHEN {x} >= 1 THEN printf('%.0f s', {x})
      WHEN {x} >= 0.1::DOUBLE THEN printf('%.1f ms', {x} * 1000)
      WHEN {x} >= 0.01::DOUBLE THEN printf('%.2f ms', {x} * 1000)
      WHEN {x} >= 0.001::DOUBLE THEN printf('%.3f ms', {x} * 1000)
      WHEN {x} >= 0.0001::DOUBLE THEN printf('%.1f µs', {x} * 1000000)
      WHEN {x} >= 0.00001::DOUBLE THEN printf('%.2f µs', {x} * 1000000)
      WHEN {x} >= 0.000001::DOUBLE THEN printf('%.3f µs', {x} * 1000000)
      WHEN {x} >= 0.0000001::DOUBLE THEN printf('%.1f ns', {x} * 1000000000)
      WHEN {x} >= 0.00000001::DOUBLE THEN printf('%.2f ns', {x} * 1000000000)
      WHEN {x} >= 0.000000001::DOUBLE THEN printf('%.3f ns', {x} * 1000000000)
      ELSE printf('%f s', {x}) END"""


def picosecond_time(ps: str) -> str:
    def unit(size: int, name: str) -> str:
        whole = f"({ps} // {size})"
        two_digits = f"CASE WHEN {whole} >= 100 THEN round_even({whole}::DOUBLE / 10, 0) * 10 ELSE {whole} END"
        return f"WHEN {ps} >= {size} THEN printf('%.2f{name}', CAST({two_digits} AS DOUBLE))"

    s = f"({ps} // {10**12})"
    return f"""CASE WHEN {ps} >= {60 * 10**12}
      THEN printf('%02d:%02d:%02d', {s} // 3600, ({s} // 60) % 60, {s} % 60)
      {unit(10**12, " s")} {unit(10**9, " ms")} {unit(10**6, " µs")} {unit(10**3, " ns")}
      ELSE concat({ps}, ' ps') END"""


def metric_cell(avg: str, stddev: str) -> str:
    avg, stddev = steady(avg), steady(stddev)
    number = f"concat({float_number(avg)}, CASE WHEN metric = 'QPS' THEN ' qps' ELSE '' END, ', σ ', {float_number(stddev)})"
    time = f"concat({float_time(avg)}, ', σ ', {float_time(stddev)})"
    return f"CASE WHEN metric = 'Latency' THEN {time} ELSE {number} END"


def padded(text: str, width: int) -> str:
    return f"concat({text}, repeat(' ', greatest({width} - length({text}), 0)))"


def server_names(servers: str) -> str:
    """User, host, name and short name of a table of connection strings."""
    return f"""parts AS (
  SELECT *, CASE WHEN instr(dsn, ':') > 0 THEN split_part(dsn, ':', 1) ELSE '' END AS "user",
         regexp_replace(CASE WHEN instr(dsn, '(') > 0 THEN regexp_extract(dsn, '\\(([^)]*)\\)', 1)
                             WHEN instr(dsn, '@') > 0 THEN split_part(dsn, '@', -1) ELSE '' END,
                        '^(.+):3306$', '\\1') AS host
  FROM {servers}),
named AS (
  SELECT *, concat('''', "user", '''@''', host, '''') AS name FROM parts),
server_dim AS (
  SELECT *, CASE WHEN length(name) > 40 THEN concat(left(name, 18), '...', right(name, 19)) ELSE name END
    AS short_name
  FROM named)"""


EVENT_SERVERS = """servers AS (
  SELECT server_id, concat('user:password@tcp(metric', server_id + 1, '.example.com:3306)/performance_schema')
         AS dsn,
         CASE WHEN server_id = 0 THEN '8.0.31-log' ELSE '8.4.2-log' END AS version
  FROM (SELECT DISTINCT server_id FROM base))"""

CUSTOMER_SERVERS = """servers AS (
  SELECT c_custkey AS server_id,
         CASE c_custkey % 6
           WHEN 0 THEN concat('app', c_custkey, ':secret@tcp(db', c_custkey, '.example.com:3306)/performance_schema')
           WHEN 1 THEN concat('app', c_custkey, ':secret@tcp(db', c_custkey, '.example.com:3307)/performance_schema')
           WHEN 2 THEN concat('root:secret@host', c_custkey, ':3306')
           WHEN 3 THEN concat('admin@tcp(db', c_custkey, '.example.com)/performance_schema')
           WHEN 4 THEN concat('reporting_user_', c_custkey, ':secret@tcp(', lower(c_mktsegment),
                              '-replica.internal.example.com:3306)/x')
           ELSE concat('u', c_custkey) END AS dsn,
         concat('5.7.', c_custkey % 40) AS version, c_custkey * 37 % 86400 AS uptime_s
  FROM customer)"""


def with_(*steps: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n"


def steady(value: str, digits: int = 12) -> str:
    return f"CAST(printf('%.{digits - 1}e', {value}) AS DOUBLE)"


def rounded(value: str) -> str:
    return steady(steady(value), 10)
