"""Boilerplate lines by site-relative frequency.

Pages are grouped by host. A line's frequency is the number of pages of its host that contain it, divided by the
host's pages; lines above a ratio are boilerplate and are dropped. Lines are counted once a page and combined
before the shuffle, so neither a host nor a line with very many pages meets in one task. A host cannot have more
boilerplate lines than its mean number of lines a page over the ratio, hence its list fits in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterscope.llm.shared import staged

HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|"
    r"main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
BROADCAST_LINES = 100_000


def host_of(url: Column) -> Column:
    """Host in lower case, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """Visible lines: block tags end a line, other tags vanish, white space is joined, empty lines go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), r"<[^>]*>", "")
    pieces = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return F.filter(pieces, lambda x: x != "")


def _hashed(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("high"), F.xxhash64(F.lit(1), line).alias("low"))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.3, least_pages: int = 2) -> DataFrame:
    """Drop the boilerplate lines of pages (page_id, url, html).

    A line is boilerplate if more than ``ratio`` of its host's pages contain it, and at least ``least_pages`` do. Returns one row
    per page: page_id, host, n_lines, n_dropped, text (kept lines, joined by line breaks). Null html has no
    lines; pages whose url has no host keep all lines. Repeated rows are pages of their own. A line on exactly ``ratio`` of the pages stays.
    By default two pages are enough, as one alone cannot show a line to be shared. Lines are told apart by 128 bits of hash. Pages are read whole; an
    empty table gives no rows; columns other than page_id, url and html, whatever their names, are not read.
    """
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    hosted = read.filter("host is not null")
    once = hosted.select("host", F.explode(F.array_distinct(F.transform("lines", _hashed))).alias("line"))
    counts = once.groupBy("host", "line").agg(F.count("*").alias("having")).filter(F.col("having") >= least_pages)
    totals = hosted.groupBy("host").agg(F.count("*").alias("all"))
    often = counts.join(totals, "host").filter(F.col("having") > ratio * F.col("all"))
    lists = staged(often.groupBy("host").agg(F.collect_list("line").alias("drops")), "boilerplate")
    size = lists.agg(F.sum(F.size("drops"))).first()[0] or 0
    if size <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("drops"), _hashed(x)))
    )
    cleaned = read.join(lists, "host", "left").withColumn("kept", kept)
    return cleaned.select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
