"""Text reports, one line per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterscope.functions.text import metric_cell, padded, picosecond_time, steady
from counterscope.plans.report_sink import read_report, write_report  # noqa: F401  (part of this module's interface)
from counterscope.schema import COUNTERS
from counterscope.session import materialized

# Column widths and separators of the report.
_NAME_WIDTH = 40
_HEADING_WIDTH = 19
_CELL_WIDTH = 39
_SEPARATOR = " | "

_QUERY_LINE, _SERVER_LINE, _FIRST_METRIC_LINE = 1, 2, 3


def _headline(keys: DataFrame) -> DataFrame:
    count = F.count("*").cast("string")
    return keys.agg(count.alias("n")).select(
        F.lit(0).alias("query_rank"),
        F.lit(0).alias("line_no"),
        F.concat(F.lit("Looking at top "), F.col("n"), F.lit(" queries")).alias("line"),
    )


def _query_line(keys: DataFrame) -> DataFrame:
    return keys.select(
        "query_rank",
        F.lit(_QUERY_LINE).alias("line_no"),
        F.concat(F.lit("Query "), F.col("query_rank").cast("string"), F.lit(": "), F.col("digest_text")).alias("line"),
    )


def _joined(cells: DataFrame, ids: Sequence[str], width: int) -> DataFrame:
    """Cells (position, cell) of each line side by side in order of position."""
    in_order = F.array_sort(F.collect_list(F.struct("position", padded(F.col("cell"), width).alias("cell"))))
    return cells.groupBy(*ids).agg(F.array_join(F.transform(in_order, lambda c: c["cell"]), _SEPARATOR).alias("cells"))


def _server_line(keys: DataFrame, servers: DataFrame, server_ids: Sequence[int]) -> DataFrame:
    """The servers' names under each query: one row holding every name, repeated by way of its rank."""
    asked = keys.sparkSession.createDataFrame(list(enumerate(server_ids)), "position int, server_id int")
    names = F.coalesce("short_name", F.lit("")).alias("cell")
    named = asked.join(servers.select("server_id", "short_name"), "server_id", "left").select("position", names)
    row = _joined(named.withColumn("line_no", F.lit(_SERVER_LINE)), ["line_no"], _NAME_WIDTH)
    ranks = keys.select("query_rank", F.lit(_SERVER_LINE).alias("line_no"))
    line = F.concat(F.lit("Server:            "), F.col("cells")).alias("line")
    return ranks.join(F.broadcast(row), "line_no").select("query_rank", "line_no", line)


def _metric_line(metrics: DataFrame, server_ids: Sequence[int]) -> DataFrame:
    """Cells are formatted in the long form, by one expression for all servers."""
    place = F.array_position(F.array(*[F.lit(i) for i in server_ids]), F.col("server_id"))
    values = metrics.withColumns({v: steady(F.col(v)) for v in ("avg", "stddev")})
    cells = values.select(
        "query_rank", "metric_ord", "metric", place.alias("position"), metric_cell("avg", "stddev").alias("cell")
    )
    heading = padded(F.concat(F.lit("  Avg "), F.col("metric"), F.lit(":")), _HEADING_WIDTH)
    return _joined(cells, ["query_rank", "metric_ord", "metric"], _CELL_WIDTH).select(
        "query_rank",
        (F.col("metric_ord") + (_FIRST_METRIC_LINE - 1)).alias("line_no"),
        F.concat(heading, F.lit(" "), F.col("cells")).alias("line"),
    )


def report_lines(
    metrics: DataFrame, top_texts: DataFrame, servers: DataFrame, server_ids: Sequence[int]
) -> DataFrame:
    """The comparison in its long form as text, ordered by ``query_rank, line_no``."""
    return (
        _headline(top_texts)
        .unionByName(_query_line(top_texts))
        .unionByName(_server_line(top_texts, servers, server_ids))
        .unionByName(_metric_line(metrics, server_ids))
    )


def server_listing(metrics: DataFrame, servers: DataFrame, sample_counts: DataFrame) -> DataFrame:
    """Each server's own listing of the top queries, ordered by ``server_id, query_rank, line_no``.

    ``metrics`` has a row per top query, server and metric; it is computed once. A server without any keeps its header.
    """
    metrics = materialized(metrics)
    ranks = metrics.groupBy("server_id").agg(F.count_distinct("query_rank").cast("string").alias("n_keys"))
    about = servers.join(sample_counts, "server_id").join(ranks, "server_id", "left")
    header = about.select(
        "server_id",
        F.lit(0).alias("query_rank"),
        F.lit(0).alias("line_no"),
        F.concat(
            F.lit("Host: "),
            F.col("name"),
            F.lit(" / "),
            F.col("version"),
            F.lit(". Have "),
            F.col("n_samples").cast("string"),
            F.lit(" entries. Looking at top "),
            F.coalesce("n_keys", F.lit("0")),
            F.lit(" queries"),
        ).alias("line"),
    )
    cell = metric_cell("avg", "stddev")
    metric_line = F.concat(F.lit("  Avg "), F.col("metric"), F.lit(": "), cell)
    query_line = F.concat(F.lit("Query "), F.col("query_rank").cast("string"), F.lit(":"))
    # The first metric of a query brings the query's own line along.
    first = F.col("metric_ord") == 1
    own_line = F.struct(F.col("metric_ord").alias("line_no"), metric_line.alias("line"))
    head_line = F.struct(F.lit(0).alias("line_no"), query_line.alias("line"))
    both = F.when(first, F.array(head_line, own_line)).otherwise(F.array(own_line))
    values = metrics.withColumns({v: steady(F.col(v)) for v in ("avg", "stddev")})
    body = values.select("server_id", "query_rank", F.inline(both))
    return header.unionByName(body)


def topn_elapsed(top_texts: DataFrame) -> DataFrame:
    """The top queries with text and total elapsed time."""
    return top_texts.select(
        "query_rank",
        "query_key",
        "digest_text",
        "sum_timer_wait",
        picosecond_time("sum_timer_wait").alias("elapsed"),
    )


def _fields(pairs: Sequence[tuple[str, Column]]) -> Column:
    return F.concat_ws(", ", *[F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in pairs])


# The sample dump puts the timer first.
_SAMPLE_DUMP = (COUNTERS[1], COUNTERS[0], *COUNTERS[2:])


def dump_events(deduped: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Snapshot rows as ``NAME: value`` text."""
    pairs = [("MD5_DIGEST", F.col("digest")), ("SCHEMA", F.col("schema_name"))]
    pairs += [(c.upper(), F.col(c)) for c in counters]
    return deduped.select("server_id", "collection_seq", "query_key", _fields(pairs).alias("line"))


def dump_samples(samples: DataFrame) -> DataFrame:
    """Sample rows as ``NAME: value`` text. Rows of a sample have no order, so they are not numbered."""
    pairs = [("Key", F.col("query_key"))] + [(c.upper(), F.col(c)) for c in _SAMPLE_DUMP]
    return samples.select("server_id", "sample_seq", "query_key", _fields(pairs).alias("line"))


