"""Helpers the operators share: staged tables, row keys, joins with small tables, connected components."""

from __future__ import annotations

import itertools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import counterscope
from counterscope.session import shared_folder

# A broadcast side is counted and measured first.
BROADCAST_LIMIT = 200_000
BROADCAST_BYTES = 64 << 20
# A key filter has at most this many bits, 64 MB, however many keys there are.
FILTER_BITS = 1 << 29
_WORD_BITS = 1 << 15  # of one bitmap, as bitmap_construct_agg builds it


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(counterscope.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "counterscope-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with a function of this package, for columns of any name."""
    ship(df.sparkSession)
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.rename_columns(names) for batch in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, schema)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder, to be deleted when the session ends, and read it back.

    Everything after it restarts from these files, whichever executors are lost.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(column: str = "text") -> Column:
    """Second part of a row's key beside doc_id, for tables in which a doc_id occurs with several texts."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def _width(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        return 8 + 8 * F.greatest(F.size(column), F.lit(0))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 8 + F.coalesce(F.octet_length(column), F.lit(0))
    return F.lit(8)


def _measured(df: DataFrame) -> tuple[int, int]:
    """Rows of a staged table and about how many bytes they take, in one pass."""
    width = sum((_width(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields), F.lit(0))
    rows, size = df.agg(F.count("*"), F.sum(width)).first()
    return rows, size or 0


def counted_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark a staged table for broadcast if it has at most ``limit`` rows and BROADCAST_BYTES; else Spark shuffles, and splits hot keys."""
    rows, size = _measured(df)
    return F.broadcast(df) if rows <= (BROADCAST_LIMIT if limit is None else limit) and size <= BROADCAST_BYTES else df


def positioned(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns c0, c1, ..., which no helper column can clash with, and the new name of each."""
    renamed = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*renamed.values()), renamed


def likely(rows: DataFrame, own: Column, keys: DataFrame, key: Column) -> DataFrame:
    """Rows with ``listed``: whether their hash ``own`` may be one of the hashes ``key`` of a staged table; no row moves.

    True for every row whose hash is there, and for one in 32 others or fewer up to 16 million keys; from there on in proportion
    to the keys, as the filter is a bitmap of at most FILTER_BITS, which is broadcast. Of the keys, eight bytes each are shuffled.
    """
    bits = min(FILTER_BITS, max(_WORD_BITS, 1 << (32 * keys.count()).bit_length()))
    spots = keys.select(F.pmod(key, F.lit(bits)).alias("spot"))
    spots = spots.select(F.floor(F.col("spot") / _WORD_BITS).alias("word"), (F.col("spot") % _WORD_BITS).alias("bit"))
    # brought together first: a bitmap is 4 KB, however few of its keys a task has
    words = spots.repartition("word").groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    words = staged(words, "key-filter")
    held = rows.withColumn("spot", F.pmod(own, F.lit(bits)))
    held = held.join(F.broadcast(words), F.floor(F.col("spot") / _WORD_BITS) == F.col("word"), "left")
    bit = F.col("spot") % _WORD_BITS
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    listed = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
    return held.withColumn("listed", listed).drop("spot", "word", "bitmap")


def _hits(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame | None, Callable[[str], DataFrame]]:
    """Positioned rows with their ``row_key`` in two parts: those that no entry (drop_id, drop_key) of ``keys`` can meet, or None
    if ``keys`` is small enough to be broadcast, and the others, as a function that joins them with ``keys``."""
    rows, renamed = positioned(docs)
    keyed = rows.withColumn("row_key", text_key(renamed["text"]))
    side, apart = counted_broadcast(keys.select("drop_id", "drop_key")), None
    if keys.count() > BROADCAST_LIMIT:
        # else whole texts would be shuffled for a join that concerns few of them
        own = F.xxhash64(F.col(renamed["doc_id"]).cast("long"), F.col("row_key"))
        told = likely(keyed, own, keys, F.xxhash64(F.col("drop_id").cast("long"), F.col("drop_key")))
        apart, keyed = told.filter(~F.col("listed")).drop("listed"), told.filter("listed").drop("listed")
    hit = F.col(renamed["doc_id"]).eqNullSafe(F.col("drop_id")) & (F.col("row_key") == F.col("drop_key"))
    return apart, lambda how: keyed.join(side, hit, how)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents whose (doc_id, text) is not in the staged table ``dropped`` (drop_id, drop_key); null ids match null ids."""
    apart, joined = _hits(docs, dropped)
    kept = joined("left_anti")
    return (kept if apart is None else kept.unionByName(apart)).drop("row_key").toDF(*docs.columns)


def one_of_each(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Keep one of the rows that share (doc_id, text) with an entry of the staged table ``repeated`` (drop_id, drop_key)."""
    if repeated.isEmpty():
        return docs
    apart, joined = _hits(docs, repeated)
    again = joined("left_semi").dropDuplicates([f"c{docs.columns.index('doc_id')}", "row_key"])
    kept = joined("left_anti").unionByName(again)
    return (kept if apart is None else kept.unionByName(apart)).drop("row_key").toDF(*docs.columns)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): every linked node with its component, the least node of it.

    Labels spread to the least neighbour and then jump to the label of their label, so a chain of n links
    needs about log n rounds. Each round is staged.
    """
    there = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(there.distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    for turn in itertools.count():
        least = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("least"))
        )
        old = F.col("component").alias("old")
        step = staged(labels.join(least, "node").select("node", old, F.least("component", "least").alias("component")), "labels")
        if step.filter(F.col("old") != F.col("component")).isEmpty():
            return step.select("node", "component")
        if turn < 2:  # most components are stars, and done by now
            labels = step.select("node", "component")
            continue
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        further = F.least("component", "further").alias("component")
        labels = staged(step.join(jump, "component").select("node", further), "labels")
