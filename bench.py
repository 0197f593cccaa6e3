"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm the JVM; the better of two more runs counts, planning included. Results go to
the no-op sink, so every output row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from logweir.plans import all_queries
from logweir.session import build_session
from logweir.sources import views

HEADLINE = [
    "rules_apply", "rules_stats", "filter_engine", "parse_logs", "detect_format", "mine_patterns", "pattern_stats", "anomalies", "clusters",
    "report", "top_lines", "top_patterns", "alerts_eval", "query_logs", "search", "aggregate_by_interval", "sem_http", "entities_error",
    "keywords", "latency_stats", "detect_error_spike", "rate_limit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = views.table(spark, folder, "events").count()
    seconds: dict[str, float] = {}
    for name in names:
        job = all_queries()[name].job
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            job(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - start, 3))
        seconds[name] = min(runs[1:])
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "log_rows": rows,
                "rows_per_second": {n: round(rows / s) for n, s in seconds.items()},
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
