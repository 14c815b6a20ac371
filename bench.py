"""Time the headline queries and print one JSON line.

``*_log`` queries read a snapshot log written beforehand, which is how the library is used. Of the others, those that read
their log several times derive and store it once a session, in a run that is not counted; ``dedup``, ``deltas``, ``metric_stats``,
``lineitem_deltas`` and ``lineitem_metric_stats`` derive it from the raw tables in every run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from counterscope.operators.clean import collect_clean  # noqa: E402
from counterscope.operators.deltas import deltas  # noqa: E402
from counterscope.plans.compare import all_key_stats, compare_servers  # noqa: E402
from counterscope.registry import derived  # noqa: E402
from counterscope.registry.queries import REGISTRY  # noqa: E402
from counterscope.session import local_session, shared_folder  # noqa: E402
from counterscope.sources.snapshots import read_snapshot_log, write_snapshot_log  # noqa: E402

HEADLINE = (
    "dedup",
    "deltas",
    "first_last",
    "topn",
    "metric_stats",
    "compare_servers",
    "report_lines",
    "lineitem_deltas",
    "lineitem_metric_stats",
    "lineitem_topn",
    "lineitem_compare",
)


def timed(build, runs: int) -> float:
    """Median of warm runs; the first one is not counted."""
    seconds = []
    for _ in range(runs + 1):
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - started)
    return round(statistics.median(seconds[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:]
    spark = local_session("counterscope-bench", cores, partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")

    path = shared_folder(spark, "bench-log")
    write_snapshot_log(derived.lineitem_snapshots(spark, sf_dir), path)
    log = read_snapshot_log(spark, path)
    servers = derived.LINEITEM_SERVERS
    jobs = {name: (lambda name=name: REGISTRY[name].run(spark, sf_dir)) for name in HEADLINE}
    jobs |= {
        "deltas_log": lambda: deltas(collect_clean(log)),
        "metric_stats_log": lambda: all_key_stats(log),
        "compare_log": lambda: compare_servers(log, servers),
    }
    queries = {name: timed(job, runs) for name, job in jobs.items() if not chosen or name in chosen}
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median warm runs",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "log_rows": log.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
