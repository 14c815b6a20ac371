"""Server dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterscope.functions.names import dsn_host, dsn_user, server_name, short_name


def server_dim(servers: DataFrame) -> DataFrame:
    """User, host and display name of each server; the connection string itself is dropped."""
    named = servers.select(
        "server_id",
        dsn_user().alias("user"),
        dsn_host().alias("host"),
        "version",
        *(["uptime_s"] if "uptime_s" in servers.columns else []),
    )
    name = server_name(F.col("user"), F.col("host"))
    return named.withColumns({"name": name, "short_name": short_name(name)})
