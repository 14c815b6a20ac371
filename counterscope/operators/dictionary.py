"""Query text by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterscope.functions.keys import query_key, text_or_empty
from counterscope.operators.clean import filter_text
from counterscope.sources.snapshots import scan_keys


def _texts(rows: DataFrame) -> DataFrame:
    return scan_keys(rows).select(
        "digest",
        "schema_name",
        query_key().alias("query_key"),
        text_or_empty("digest_text").alias("digest_text"),
    )


def query_dictionary(snapshots: DataFrame, query_filter: str = "") -> DataFrame:
    """Key to text over all servers and snapshots, after the text filter but before the schema filter."""
    # Distinct raw values first: they combine on the map side, and MD5 then runs once per statement.
    raw = filter_text(snapshots, query_filter).select("schema_name", "digest_text").distinct()
    texts = _texts(raw)
    return texts.groupBy("query_key").agg(F.min("digest_text").alias("digest_text"))


def dictionary_conflicts(keyed_texts: DataFrame, strict: bool = False) -> DataFrame:
    """Keys that stand for more than one text.

    Takes ``(query_key, digest_text)``. With ``strict`` the job fails on the first conflict.
    """
    texts = keyed_texts.select("query_key", text_or_empty("digest_text").alias("digest_text")).distinct()
    clashes = (
        texts.groupBy("query_key")
        .agg(
            F.count("*").alias("n_texts"),
            F.min("digest_text").alias("first_text"),
            F.max("digest_text").alias("last_text"),
        )
        .where(F.col("n_texts") > 1)
    )
    if not strict:
        return clashes
    message = F.concat(F.lit("one key, several texts: "), F.col("query_key"))
    return clashes.withColumn("query_key", F.raise_error(message).cast("string"))


def texts_of(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``digest_text`` to a few keys, ``''`` when ``rows`` does not have it.

    The keys are broadcast by the caller if their number allows; they filter the rows before anything is
    shuffled.
    """
    found = (
        _texts(rows)
        .join(keys.select("digest", "schema_name"), ["digest", "schema_name"], "left_semi")
        .select("query_key", "digest_text")
        .distinct()
        .groupBy("query_key")
        .agg(F.min("digest_text").alias("digest_text"))
    )
    return keys.join(found, "query_key", "left").withColumn("digest_text", text_or_empty("digest_text"))
