"""Profile and compare query workloads from snapshots of cumulative counters, on Spark."""

from counterscope.plans.compare import Comparison, compare_pct, compare_servers, profile_server
from counterscope.plans.report_sink import read_report, write_report
from counterscope.sources.collections import read_collections, stream_collections, write_collections
from counterscope.sources.snapshots import read_snapshot_log, write_snapshot_log
from counterscope.streaming.incremental import SampleStream
from counterscope.streaming.keyed import StateStream

__all__ = [
    "Comparison",
    "SampleStream",
    "StateStream",
    "compare_pct",
    "compare_servers",
    "profile_server",
    "read_collections",
    "read_report",
    "read_snapshot_log",
    "stream_collections",
    "write_collections",
    "write_report",
    "write_snapshot_log",
]
