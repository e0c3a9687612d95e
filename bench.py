"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver): one warm-up run, then the
median of $BENCH_RUNS timed runs.  With $BENCH_EVENT_LOG_DIR set, Spark's
event log (stage and task times) is written there for later reading.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "word_count_per_group",
    "timeline_relative",
    "tfidf_exact",
    "tfidf_hashed",
    "top_terms_per_group",
    "page_extract",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE

    from textlake.plans.queries import QUERIES
    from textlake.session import get_session

    event_dir = os.environ.get("BENCH_EVENT_LOG_DIR")
    conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir} if event_dir else {}
    conf["textlake.scan.partitions"] = str(cpus)  # the bench tables are one row group each
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="textlake-bench",
                        conf=conf)
    times: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "settings": {
            "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            "spark.sql.adaptive.enabled": spark.conf.get("spark.sql.adaptive.enabled"),
        },
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
