"""The dictionary of query texts, kept up to date from a stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from counterscope.functions.keys import query_key, text_or_empty
from counterscope.operators import dictionary as di
from counterscope.operators.clean import filter_text
from counterscope.schema import snapshot_schema
from counterscope.sources.snapshots import scan_keys


@dataclass(frozen=True)
class DictionaryStream:
    """Appends each text of a key to ``output`` when it is first seen.

    What has been seen is remembered for ``remember`` of arrival time, not for ever: a text that comes back after that is appended again, which
    the readers do not notice. Arrival is the clock because a text counts however old its snapshot is.
    """

    source: str
    output: str
    checkpoint: str
    remember: str = "1 day"
    query_filter: str = ""

    def start(self, spark: SparkSession, max_files: int | None = None, **trigger) -> StreamingQuery:
        reader = spark.readStream.schema(snapshot_schema())
        log = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(self.source)
        texts = scan_keys(filter_text(log, self.query_filter)).select(
            query_key().alias("query_key"), text_or_empty("digest_text").alias("digest_text"), F.current_timestamp().alias("arrived")
        )
        new = texts.withWatermark("arrived", self.remember).dropDuplicatesWithinWatermark(["query_key", "digest_text"])
        writer = new.select("query_key", "digest_text").writeStream.format("parquet").option("checkpointLocation", self.checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start(self.output)

    def entries(self, spark: SparkSession) -> DataFrame:
        """Each text of each key."""
        return spark.read.schema("query_key string, digest_text string").parquet(self.output).distinct()

    def results(self, spark: SparkSession) -> DataFrame:
        """One text per key, as ``query_dictionary`` gives it."""
        return self.entries(spark).groupBy("query_key").agg(F.min("digest_text").alias("digest_text"))

    def conflicts(self, spark: SparkSession, strict: bool = False) -> DataFrame:
        """Keys that have come with several texts so far."""
        return di.dictionary_conflicts(self.entries(spark), strict)
