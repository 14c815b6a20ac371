"""Fingerprints by order MinHash, in DataFrame functions only.

A text's k-mers, here runs of k words, are numbered by occurrence, so that a repeated k-mer is several different ones. Each of a fixed
number of slots selects its few least k-mers under a hash order of its own, puts them back into the order they have in the text
and hashes that tuple of k-mers. Two texts agree in a slot if they select the same k-mers in the same order, which few
edits leave alone and a change of order does not: the share of equal slots falls with the edit distance.

The slots' orders are rotations of one hash circle: slot j counts from the j-th of equal arcs on. So one hash a k-mer serves all
slots, and after sorting them only the first few of each arc are looked at. An arc with too few goes on into the next one.
Sorting happens on single integers that hold the hash above and the place in the text below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterscope.llm.shared import staged, text_key

WORD = r"[^\x20\x09-\x0D]+"


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def fingerprinted(df: DataFrame, text: str, name: str, k: int = 2, least: int = 2, slots: int = 64) -> DataFrame:
    """Add column ``name``: the fingerprint of column ``text`` as ``slots`` (a power of two) 32-bit numbers.

    A text with fewer than ``k`` words has one k-mer, all its words; one without words, null included, has the fingerprint of
    nothing, equal to that of every other such text. Texts are read whole, whatever their length.
    """
    power = slots.bit_length() - 1
    if slots != 1 << power or not 0 < power < 16:
        raise ValueError("slots must be a power of two")
    words, kmers, low, once, order, twice, ring, arcs, starts = (f"__{name}_{i}" for i in range(9))
    size = F.size(F.col(words))
    starts_of_kmers = F.slice(F.col(words), F.lit(1), F.greatest(size - (k - 1), F.least(size, F.lit(1))))
    place = F.col(low)  # the bits a place in the text takes

    def upper(x: Column) -> Column:
        return x.bitwiseAND(F.bitwise_not(place))

    def kmer(x: Column) -> Column:
        return _at(kmers, x.bitwiseAND(place).cast("int"))

    def occurrence(x: Column, i: Column) -> Column:
        def is_at(back: Column) -> Column:
            return upper(x) == upper(_at(once, i - back))

        steps = F.transform(F.sequence(F.length(F.bin(F.size(F.col(once)))), F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))
        far = F.aggregate(steps, F.lit(0), lambda found, step: F.when(is_at(found + step), found + step).otherwise(found))
        return F.when(is_at(F.lit(1)), F.when(is_at(F.lit(2)), far).otherwise(1)).otherwise(0)

    def arc(x: Column) -> Column:
        return F.shiftright(x, 64 - power)

    def first_of(acc: Column, j: Column) -> Column:
        found = F.array_position(F.col(arcs), j)
        return F.concat(F.array(F.when(found > 0, found.cast("int")).otherwise(F.get(acc, F.lit(0)))), acc)

    n = F.size(F.col(ring))
    half = slots // 2
    full = F.sequence(F.lit(1), F.lit(slots * least), F.lit(least))
    walked = F.aggregate(F.sequence(F.lit(half - 1).cast("long"), F.lit(-half).cast("long"), F.lit(-1).cast("long")), F.array(n + 1), first_of)
    around = F.concat(F.col(ring), F.slice(F.col(ring), 1, least))

    def slot(start: Column) -> Column:
        chosen = F.sort_array(F.transform(F.slice(F.col(twice), start, F.least(n, F.lit(least))), lambda x: x.bitwiseAND(place)))
        return F.shiftright(F.xxhash64(F.transform(chosen, kmer)), 32).cast("int")

    columns = df.columns
    return (
        df.withColumn(words, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))
        .withColumn(kmers, F.transform(starts_of_kmers, lambda w, i: F.xxhash64(w, *[_at(words, i + j) for j in range(1, k)])))
        .withColumn(low, F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(F.col(kmers))))) - 1)
        .withColumn(once, F.sort_array(F.transform(F.col(kmers), lambda h, i: upper(h).bitwiseOR(i.cast("long")))))
        .withColumn(
            order,
            F.sort_array(F.transform(F.col(once), lambda x, i: upper(F.xxhash64(kmer(x), occurrence(x, i))).bitwiseOR(x.bitwiseAND(place)))),
        )
        .withColumn(ring, F.filter(F.col(order), lambda x, i: ~arc(x).eqNullSafe(arc(_at(order, i - least)))))
        .withColumn(arcs, F.transform(F.col(ring), arc))
        .withColumn(twice, around)
        .withColumn(starts, F.when(n == slots * least, full).otherwise(F.slice(walked, 1, slots)))
        .withColumn(name, F.transform(F.col(starts), slot))
        .select(*[F.col(f"`{c}`") for c in columns if c != name], name)
    )


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots of two fingerprints."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda hit: hit))
    return equal.cast("double") / F.size(a)


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as eight hexadecimal digits a slot."""
    digits = F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.array_join(digits, "")


KEY = ["none", "id", "key"]  # no doc_id, the doc_id or 0, and the text's hash: never null, so that plain joins and groupings share a shuffle


def _predecessors(rows: DataFrame) -> DataFrame:
    """Each distinct KEY with the one before it, ``lower``, in ascending order; the last one is before the first.

    Rows are dealt out by ranges of ids and look back there; the last row of each range, a row per range, closes the
    gaps.
    """
    distinct = rows.groupBy(*KEY).agg(F.max("n").alias("n"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(distinct.repartitionByRange(ranges, *KEY).withColumn("range", F.spark_partition_id()), "order")
    row = F.struct(*KEY, "n")
    across = Window.orderBy("range")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ranged.groupBy("range").agg(F.max(row).alias("end"))
    ends = ends.select("range", F.coalesce(F.lag("end").over(across), F.last("end").over(whole)).alias("end"))
    back = ranged.select("range", *KEY, F.lag(row).over(Window.partitionBy("range").orderBy(*KEY)).alias("back"))
    return back.join(F.broadcast(ends), "range").select(*KEY, F.coalesce("back", "end").alias("lower"))


def edited_by_next(docs: DataFrame, share: int = 4, k: int = 2, least: int = 2, slots: int = 64) -> DataFrame:
    """Fingerprint every text of documents (doc_id, text), an edited form of it, and compare both, and it with the next text.

    The edited text has its last n / ``share`` code points (rounded down) replaced by the first as many, or all, of the next document's, in
    ascending order of doc_id, null last, and of texts by their hash where a doc_id has several; after the last document comes the first.
    Returns one row per input row: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. Rows that repeat doc_id and text count as one document and have equal results. A table of one
    document has itself as the next; an empty one gives no rows. Texts are read whole; each crosses the network
    once, and its first part, at most 1 / ``share`` of the text before it, once more. Other columns, whatever their names, are not read.
    """
    given = F.col("doc_id").cast("long")
    own = docs.select(
        given.isNull().alias("none"), F.coalesce(given, F.lit(0)).alias("id"), text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")
    )
    sides = staged(_predecessors(own.select(*KEY, F.char_length("text").alias("n"))), "sides")
    # read twice below, computed and shuffled once: both joins ask for the same columns by the same keys
    texts = fingerprinted(own, "text", "prints", k, least, slots)
    taken = F.floor(F.col("lower.n") / share).cast("int")
    heads = texts.join(sides.hint("merge"), KEY).select(
        *[F.col("lower")[c].alias(c) for c in KEY], F.struct(F.left("text", taken).alias("text"), F.col("prints")).alias("head")
    )
    heads = heads.groupBy(*KEY).agg(F.first("head").alias("head"))
    n = F.char_length("text")
    kept = (n - F.floor(n / share)).cast("int")
    met = texts.join(heads.hint("merge"), KEY).select(
        F.when(~F.col("none"), F.col("id")).alias("id"),
        n.cast("long").alias("n"),
        F.concat(F.left("text", kept), F.col("head.text")).alias("edited"),
        "prints",
        F.col("head.prints").alias("next"),
    )
    both = fingerprinted(met, "edited", "edited_prints", k, least, slots)
    return both.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited",
        F.col("prints").alias("fingerprint"),
        F.col("edited_prints").alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next")).alias("near_next"),
    )
