"""Run status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idle_status(
    period: DataFrame, snapshots: DataFrame, base_server: int, server_ids: Sequence[int] | None = None
) -> DataFrame:
    """One row: does the base server show any activity, and is there any sample of the compared servers?

    ``server_ids`` are the servers compared, all of the log if not given.
    Both counts are aggregates without grouping, so the row exists for empty inputs too.
    """
    active = period.where(F.col("server_id") == base_server).agg(
        F.count("*").alias("active_keys"), F.lit(0).cast("bigint").alias("n_samples")
    )
    compared = snapshots if server_ids is None else snapshots.where(F.col("server_id").isin(*server_ids))
    numbered = compared.groupBy("server_id", "collection_seq").agg(F.lit(1).alias("one"))
    per_server = numbered.groupBy("server_id").agg((F.count("*") - 1).alias("n"))
    sampled = per_server.agg(
        F.lit(0).cast("bigint").alias("active_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples")
    )
    both = active.unionByName(sampled).agg(
        F.sum("active_keys").alias("active_keys"), F.sum("n_samples").alias("n_samples")
    )
    return both.select(
        F.lit(base_server).alias("server_id"),
        "active_keys",
        "n_samples",
        (F.col("active_keys") == 0).alias("idle"),
        (F.col("n_samples") == 0).alias("no_data"),
    )
