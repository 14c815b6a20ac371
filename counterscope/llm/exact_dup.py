"""Exact deduplication by recipes of content-defined chunks, in DataFrame functions only.

A text is cut where its own letters say so, hence equal stretches of text give equal chunks. Chunks are
deduplicated over all texts: the store of distinct chunks, compared byte by byte, verifies that an
identifier stands for one chunk only; should two chunks share one, all are identified anew by another hash.
Texts are then equal exactly if their ordered lists of identifiers are. The text itself is shuffled once, as
distinct chunks combined before the shuffle; lists, some 16 bytes a kilobyte of text, do the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterscope.llm.shared import one_of_each, staged, text_key, without

SPACES = r"[\x20\x09-\x0D]+"
# At least 512 characters, then up to a space after one of these letters; 4,096 if there is none.
CHUNK = r"(?s).{512,4096}?[a-gA-G]\x20|.{1,4096}"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), SPACES, " ")


def _chunks(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(CHUNK), F.lit(0))


def _identifier(chunk: Column, attempt: int, bits: int) -> list[Column]:
    """Two numbers that identify a chunk; ``bits`` of each are used, twice as many at each attempt."""
    keep = min(64, bits << attempt)
    hashes = [F.xxhash64(F.lit(2 * attempt + i), chunk) for i in (0, 1)]
    return [F.shiftrightunsigned(h, 64 - keep) if keep < 64 else h for h in hashes]


def _verified_attempt(texts: DataFrame, bits: int) -> int:
    """The first hash family under which every identifier stands for one chunk over all texts."""
    attempt = 0
    while True:
        chunks = texts.select(F.explode(_chunks("normal")).alias("chunk"))
        high, low = _identifier(F.col("chunk"), attempt, bits)
        store = chunks.select(high.alias("high"), low.alias("low"), "chunk").distinct()
        shared = store.groupBy("high", "low").agg(F.count("*").alias("chunks")).filter("chunks > 1")
        if shared.isEmpty():
            return attempt
        attempt += 1


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Group rows (doc_id, text) whose texts are equal after every run of white space became one space.

    Returns one row per input row: doc_id, text_key, keep_id (least doc_id of the group), group_size, kept
    (doc_id is keep_id), stays (as kept, and the text as stored is the one to stay), text_sha256 of the normalised text.
    Null texts count as empty; empty texts are equal to each other. A null doc_id counts as the largest. Of equal texts
    with one doc_id the one stored with the least hash stays. Texts are read whole; a very long one is many chunks. An empty table gives no
    rows, and columns other than doc_id and text, whatever their names, are not read.
    ``bits`` of the hashes are used in the first attempt; fewer than 64 serve to test what follows a clash.
    """
    given = F.col("doc_id").cast("long")
    texts = docs.select(
        F.coalesce(given, F.lit(2**63 - 1)).alias("id"),
        given.isNull().alias("none"),  # tells a null id from the largest, and comes after it
        text_key().alias("text_key"),
        normalised().alias("normal"),
    )
    attempt = _verified_attempt(texts, bits)
    recipe = F.flatten(F.transform(_chunks("normal"), lambda c: F.array(*_identifier(c, attempt, bits))))
    rows = staged(
        texts.select("id", "none", "text_key", recipe.alias("recipe"), F.sha2(F.col("normal"), 256).alias("text_sha256")), "recipes"
    )
    groups = rows.groupBy("recipe").agg(F.min(F.struct("id", "none", "text_key")).alias("least"), F.count("*").alias("group_size"))
    groups = staged(groups.filter("group_size > 1"), "copies")
    own = F.struct("id", "none", "text_key")
    stay = F.coalesce(F.col("least"), own)
    return rows.join(groups, "recipe", "left").select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "text_key",
        F.when(~stay["none"], stay["id"]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        ((F.col("id") == stay["id"]) & (F.col("none") == stay["none"])).alias("kept"),
        (own == stay).alias("stays"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one row of every group of equal texts; all columns stay, whatever their names.

    The row with the least doc_id stays, null last; of rows equal in doc_id and text any one. An empty table stays empty.
    """
    rows = staged(exact_duplicates(docs), "exact-rows").filter("group_size > 1")
    key = [F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key")]
    dropped = rows.filter(~F.col("stays")).select(key).distinct()
    twice = rows.filter("stays").select(key).groupBy("drop_id", "drop_key").count().filter("count > 1").drop("count")
    kept = without(docs, staged(dropped, "dropped"))
    return one_of_each(kept, staged(twice, "repeated"))
