"""Mixing sources to target weights by hash thresholds.

A source's target is met by whole passes over it plus one partial pass, which takes the documents whose hash
lies below a threshold. The threshold comes from nested histograms: words are summed by source and hash
bucket, the running sum finds the bucket in which the budget ends, and only the documents of that bucket are
summed again by the next bits of the hash. Nothing is sorted by document, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterscope.llm.shared import counted_broadcast, positioned, staged

WEIGHTS = (5.0, 2.0, 1.0)
HASH_BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits that depend on id and text, the same in every engine that has MD5."""
    known = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(known), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked_sources(totals: DataFrame) -> DataFrame:
    """Number sources from 0 by code point, null last, on any number of partitions.

    Sorted partitions number their own rows; only the partitions' sizes are added up in one place.
    """
    place = F.monotonically_increasing_id()
    sorted_rows = staged(totals.sort(F.col("source").asc_nulls_last()).withColumn("place", place), "sources")
    block = F.shiftright("place", 33)
    sizes = sorted_rows.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("block", before.alias("start"))
    return (
        sorted_rows.withColumn("block", block)
        .join(starts, "block")
        .withColumn("rank", F.col("start") + F.expr("place & 8589934591"))
        .drop("block", "start", "place")
    )


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = 3) -> DataFrame:
    """Targets (source, source_size, target): shares of all words by weight, none above ``most`` times its source.

    What a full source leaves over is shared again among the others by weight, until no source is above.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked_sources(totals).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = staged(ranked.drop("rank"), "ranked-sources")
    limit = F.col("source_size") * most
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else limit <= F.col("weight") * level
        left = ranked.agg(
            F.sum(F.when(full, limit).otherwise(0)).alias("words"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if not left["weight"]:
            break
        raised = (whole - left["words"]) / left["weight"]
        if raised == level:
            break
        level = raised
    share = F.lit(0.0) if level is None else F.col("weight") * level
    target = F.least(limit.cast("double"), share)
    return ranked.select("source", "source_size", target.alias("target"))


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, below, top): take ``passes`` of each document, one more if its hash < below.

    Level by level the budget's bucket is found; at the last one, or when a single hash is left in the bucket, that hash is
    taken if this brings the source nearer to its target.
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    open_ = targets.withColumn("passes", passes.cast("long"))
    open_ = staged(
        open_.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("low", F.lit(0).cast("long")),
        "budgets",
    )
    done, rows, bits = None, sized.select("source", "size", "hash"), HASH_BITS
    while True:
        bits -= LEVEL_BITS
        inside = counted_broadcast(open_.select(F.col("source").alias("of"), "low", "budget"))
        bucket = F.shiftright("hash", bits)
        near = rows.join(inside, rows["source"].eqNullSafe(inside["of"])).filter(
            F.shiftright("hash", bits + LEVEL_BITS) == F.shiftright("low", bits + LEVEL_BITS)
        )
        sums = near.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last"), F.first("budget").alias("budget")
        )
        order = Window.partitionBy("source").orderBy("bucket")
        running = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ends = (
            sums.withColumn("upto", running)
            .filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")) & (F.col("words") > 0))
            .withColumn("left", F.col("budget") - (F.col("upto") - F.col("words")))
            .select(F.col("source").alias("of"), "bucket", "words", "first", "last", "left")
        )
        step = open_.join(ends, open_["source"].eqNullSafe(ends["of"]), "left")
        single = (F.col("first") == F.col("last")) | F.lit(bits == 0)
        low = F.shiftleft("bucket", bits)
        nearer = F.col("left") * 2 > F.col("words")
        step = staged(
            step.select(
                "source",
                "source_size",
                "target",
                "passes",
                F.coalesce("left", F.lit(0.0)).alias("budget"),
                F.coalesce(low, F.lit(0)).alias("low"),
                F.when(F.col("of").isNull(), F.lit(1 << HASH_BITS))
                .when(single, F.when(nearer, F.col("last") + 1).otherwise(F.col("first")))
                .alias("below"),
            ),
            "thresholds",
        )
        ended = step.filter("below is not null").drop("budget", "low")
        done = ended if done is None else done.unionByName(ended)
        open_ = step.filter("below is null").drop("below")
        if open_.isEmpty():
            return staged(done, "thresholds")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = 3) -> DataFrame:
    """How many words of every document (doc_id, text, source) a mix of the given source weights takes.

    Weights go to the sources in turn, in code point order, null last; targets share the words of all
    documents and stop at ``most`` times a source. Size is the number of words; null and wordless texts have 0 and are
    taken whole-pass only in name, with 0 words. A document is taken 0 to ``most`` times, whole each time. Equal rows (same doc_id and text) are
    taken alike. Returns one row per input row: doc_id, hash, size, source, source_size, target, times, taken.
    Documents whose hashes are equal are on the same side of a threshold. Texts are read whole, an empty table gives no rows,
    and columns other than doc_id, text and source, whatever their names, are not read.
    """
    sized = staged(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            document_hash().alias("hash"),
        ),
        "sizes",
    )
    targets = staged(source_targets(sized, weights, most), "targets")
    cut = _thresholds(sized, targets).withColumnRenamed("source", "of")
    times = F.least(F.col("passes") + (F.col("hash") < F.col("below")).cast("long"), F.lit(most).cast("long"))
    joined = sized.join(counted_broadcast(cut), sized["source"].eqNullSafe(F.col("of")))
    return joined.select(
        "doc_id", "hash", "size", "source", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken")
    )


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = 3) -> DataFrame:
    """The documents of the mix, all columns, whatever their names, each as often as it is taken.

    Documents without words, null texts among them, are left out. A null source is a source. Rows with equal doc_id and text are taken alike;
    documents whose hashes tie at a threshold too. Texts are read whole; an empty table stays empty.
    """
    rows = mix(docs, weights, most)
    ranges = rows.filter("size > 0").groupBy("source", "times").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    cut = counted_broadcast(staged(ranges.withColumnRenamed("source", "of"), "ranges"))
    plain, renamed = positioned(docs)
    keyed = plain.withColumn("hash", document_hash(renamed["doc_id"], renamed["text"]))
    keyed = keyed.withColumn("words", F.regexp_count(renamed["text"], F.lit(WORD)))
    same = F.col(renamed["source"]).eqNullSafe(F.col("of")) & F.col("hash").between(F.col("low"), F.col("high"))
    taken = keyed.join(cut, same).filter("words > 0 AND times > 0")
    again = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("pass")
    return taken.select(*plain.columns, again).drop("pass").toDF(*docs.columns)
