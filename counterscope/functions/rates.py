"""Per-sample rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latency() -> Column:
    """Mean seconds per statement. Picoseconds are cut to whole nanoseconds before dividing."""
    return F.expr("if(count_star != 0, (sum_timer_wait div 1000) / 1e9D / count_star, 0D)")


def per_second() -> Column:
    return F.expr("cast(count_star as double) / duration_s")
