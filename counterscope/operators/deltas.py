"""Differences between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterscope.functions.keys import IS_EMPTY, with_text
from counterscope.operators.clean import merged
from counterscope.schema import COUNTERS, KEY
from counterscope.session import counted_side

# Snapshots per window group. It bounds the rows one task must sort for a single key, at the price of
# sending every 64th snapshot twice.
SPAN = 64

# These decide whether a pair is valid; other counters may fall without it being rejected.
_CHECKED = ("count_star", "sum_timer_wait")


def _before(counter: str) -> str:
    return f"before_{counter}"


def classified(
    pairs: DataFrame, counters: Sequence[str], key: Sequence[str] = KEY, wrap_unsigned: bool = False
) -> DataFrame:
    """Difference both sides of each pair and name what becomes of it.

    Expects the later values under the counter names, the earlier ones under ``before_*``, and
    ``start_time``/``end_time``. ``wrap_unsigned`` reads a fallen counter as an overflow of 64 bits instead
    of a negative difference.
    """
    micros = "(unix_micros(end_time) - unix_micros(start_time))"
    fell = " or ".join(f"{c} < {_before(c)}" for c in _CHECKED)
    rose = " and ".join(f"{c} > {_before(c)}" for c in _CHECKED)
    others = " or ".join(f"{c} < {_before(c)}" for c in counters if c not in _CHECKED) or "false"
    outcome = f"""
        case when {IS_EMPTY} then 'empty'
             when {micros} = 0 then 'zero_duration'
             when {fell} then 'reset'
             when {rose} then 'kept'
             else 'no_progress' end"""
    gap = "{c} - {b}"
    if wrap_unsigned:
        gap = f"cast(pmod(cast({gap} as decimal(21,0)), cast('{2**64}' as decimal(21,0))) as decimal(20,0))"
    return pairs.select(
        "server_id",
        "sample_seq",
        "start_time",
        F.expr(f"{micros} / 1e6D").alias("duration_s"),
        *with_text(key),
        *[F.expr(gap.format(c=c, b=_before(c))).alias(c) for c in counters],
        F.expr(others).alias("negative_counter"),
        F.expr(outcome).alias("outcome"),
    )


def adjacent_pairs(
    deduped: DataFrame,
    counters: Sequence[str] = COUNTERS,
    key: Sequence[str] = KEY,
    wrap_unsigned: bool = False,
    span: int = SPAN,
) -> DataFrame:
    """Every key seen in snapshots ``i`` and ``i + 1`` of a server, with its ``outcome``.

    ``lag`` alone would bridge a snapshot the key is missing from, hence the test of the numbers. A key
    with a long history must not end up in one task, so history is cut into spans; the first snapshot of
    a span is also sent to the span before it, which makes every adjacent pair meet exactly once.
    """
    own = f"cast(floor(collection_seq / {span}) as int)"
    spans = f"if(collection_seq % {span} = 0, array({own}, {own} - 1), array({own}))"
    spread = deduped.withColumn("span", F.explode(F.expr(spans)))
    # The key leads because the sort compares a prefix of the first column.
    history = Window.partitionBy(*key, "server_id", "span").orderBy("collection_seq")
    lagged = spread.select(
        "server_id",
        *key,
        "collection_seq",
        F.lag("collection_seq").over(history).alias("sample_seq"),
        F.lag("collected_time").over(history).alias("start_time"),
        F.col("collected_time").alias("end_time"),
        *counters,
        *[F.lag(c).over(history).alias(_before(c)) for c in counters],
    )
    neighbours = lagged.where("sample_seq = collection_seq - 1")
    return classified(neighbours, counters, key, wrap_unsigned)


def kept(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("outcome") == "kept").drop("outcome")


def deltas(
    deduped: DataFrame,
    counters: Sequence[str] = COUNTERS,
    key: Sequence[str] = KEY,
    wrap_unsigned: bool = False,
    span: int = SPAN,
) -> DataFrame:
    """Samples: activity of each key between neighbouring snapshots."""
    return kept(adjacent_pairs(deduped, counters, key, wrap_unsigned, span))


def delta_rejects(pairs: DataFrame) -> DataFrame:
    """Pairs that could not be differenced, with the reason."""
    return pairs.where(F.col("outcome").isin("zero_duration", "reset")).withColumnRenamed("outcome", "reason")


def delta_of(
    earlier: DataFrame,
    later: DataFrame,
    counters: Sequence[str] = COUNTERS,
    on: Sequence[str] = ("server_id", *KEY),
    wrap_unsigned: bool = False,
) -> DataFrame:
    """Difference any two merged snapshots by joining on the key; keys in only one of them drop out."""
    old = earlier.select(
        *on,
        F.col("collection_seq").alias("sample_seq"),
        F.col("collected_time").alias("start_time"),
        *[F.col(c).alias(_before(c)) for c in counters],
    )
    new = later.select(*on, F.col("collected_time").alias("end_time"), *counters)
    return classified(old.join(new, list(on)), counters, wrap_unsigned=wrap_unsigned)


def deltas_join(deduped: DataFrame, counters: Sequence[str] = COUNTERS, wrap_unsigned: bool = False) -> DataFrame:
    """The samples of ``deltas`` by a self-join on key and snapshot number; a cross-check of the window."""
    step = ("server_id", *KEY, "pair_seq")
    earlier = deduped.withColumn("pair_seq", F.col("collection_seq") + 1)
    later = deduped.withColumn("pair_seq", F.col("collection_seq"))
    return kept(delta_of(earlier, later, counters, step, wrap_unsigned))


def at_ends(cleaned: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows of the first and of the last snapshot of each server, marked ``is_first`` and ``is_last``.

    ``snapshots`` is the log that ``cleaned`` was filtered from: its ends count even if the filter emptied
    them. The end numbers, two per server, are found first so that they can be broadcast; were there too
    many servers for that, the join on server and number would still have no hot key.
    """
    ends = snapshots.groupBy("server_id").agg(
        F.min("collection_seq").alias("first_seq"), F.max("collection_seq").alias("last_seq")
    )
    numbers = counted_side(ends).select(
        "server_id",
        "first_seq",
        "last_seq",
        F.explode(F.array_distinct(F.array("first_seq", "last_seq"))).alias("collection_seq"),
    )
    marked = cleaned.join(numbers, ["server_id", "collection_seq"])
    return marked.withColumns(
        {
            "is_first": F.expr("collection_seq = first_seq"),
            "is_last": F.expr("collection_seq = last_seq"),
        }
    ).drop("first_seq", "last_seq")


def at_ends_of_one(cleaned: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``at_ends`` for the log of a single server.

    The end numbers are scalar subqueries, which reach the file scan as literals: in a log ordered by
    snapshot the row groups in between are skipped.
    """
    seq = F.col("collection_seq")
    first = snapshots.agg(F.min("collection_seq")).scalar()
    last = snapshots.agg(F.max("collection_seq")).scalar()
    return cleaned.where((seq == first) | (seq == last)).withColumns(
        {"is_first": seq == first, "is_last": seq == last}
    )


def first_last(ends: DataFrame, counters: Sequence[str] = COUNTERS, wrap_unsigned: bool = False) -> DataFrame:
    """Activity of each key over the whole period: last snapshot minus first.

    Takes the rows of ``at_ends``. Merging duplicates and pairing both ends happen in one aggregation.
    """
    pairs = ends.groupBy("server_id", *KEY).agg(
        F.expr("min(if(is_first, collection_seq, null))").alias("sample_seq"),
        F.expr("max(if(is_first, collected_time, null))").alias("start_time"),
        F.expr("max(if(is_last, collected_time, null))").alias("end_time"),
        *[merged(c, "is_last").alias(c) for c in counters],
        *[merged(c, "is_first").alias(_before(c)) for c in counters],
    )
    met = pairs.where("start_time is not null and end_time is not null")
    return kept(classified(met, counters, wrap_unsigned=wrap_unsigned))
