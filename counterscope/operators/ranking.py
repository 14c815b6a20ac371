"""Busiest queries of a server."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterscope.schema import DEFAULT_TOP_N, KEY


def order_by_time() -> list:
    return [F.col("sum_timer_wait").desc(), F.col("query_key").asc()]


def topn(period: DataFrame, n: int = DEFAULT_TOP_N) -> DataFrame:
    """The ``n`` keys with most elapsed time, numbered from 1; fewer if there are fewer.

    Each task keeps its own best ``n`` rows, so numbering sees ``n`` rows only.
    """
    best = period.orderBy(*order_by_time()).limit(n)
    rank = F.row_number().over(Window.orderBy(*order_by_time()))
    return best.select(rank.alias("query_rank"), *KEY, "query_key", "sum_timer_wait")
