"""Events joined with the intervals they fall into, by equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterscope.schema import KEY


def _slot(at: Column, level: Column) -> Column:
    """Number of the slot of 2^level microseconds that an instant lies in."""
    return F.call_function("shiftright", F.unix_micros(at), level)


def join_intervals(events: DataFrame, intervals: DataFrame, on: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Each event with every interval of its key that it lies in: ``start`` <= ``at`` < ``end``. Other columns must differ in name.

    Time is cut into slots of a power of two microseconds. An interval uses the smallest slots that are no shorter than itself, so it
    touches two at most, however unequal intervals are; an event is looked up once per slot size that occurs, of which there can be
    no more than 63. The join is on key, slot size and slot, so a busy key is spread over its slots. Rows with a NULL in the key, an
    instant or a limit match nothing.
    """
    length = F.unix_micros(F.col(end)) - F.unix_micros(F.col(start))
    sized = intervals.where(length > 0).withColumn("_level", F.length(F.bin(length - 1)))
    first, last = _slot(F.col(start), F.col("_level")), F.call_function("shiftright", F.unix_micros(F.col(end)) - 1, F.col("_level"))
    placed = sized.withColumn("_slot", F.explode(F.array_distinct(F.array(first, last))))
    levels = sized.agg(F.collect_set("_level").alias("levels"))
    asked = events.where(F.col(at).isNotNull()).withColumn("_level", F.explode(levels.scalar()))
    asked = asked.withColumn("_slot", _slot(F.col(at), F.col("_level")))
    met = asked.join(placed, [*on, "_level", "_slot"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_slot")


def error_detail_by_sample(statements: DataFrame, samples: DataFrame) -> DataFrame:
    """Errors and warnings of every sample by error number, from a statement history.

    ``statements`` has ``server_id, digest, schema_name, executed_at, errno, errors, warnings``. A statement belongs to the sample of its query
    that was running when it was executed. A sample without errors or warnings has no row.
    """
    ends = F.timestamp_micros(F.unix_micros("start_time") + F.round(F.col("duration_s") * 1e6).cast("long"))
    intervals = samples.select("server_id", *KEY, "sample_seq", "start_time", ends.alias("end_time"))
    found = statements.where((F.col("errors") > 0) | (F.col("warnings") > 0))
    found = found.select("server_id", *KEY, "executed_at", "errno", "errors", "warnings")
    met = join_intervals(found, intervals, ["server_id", *KEY], "executed_at", "start_time", "end_time")
    return met.groupBy("server_id", "sample_seq", *KEY, "errno").agg(
        F.count("*").alias("n_statements"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings")
    )
