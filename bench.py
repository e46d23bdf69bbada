"""Time the headline queries and print one JSON line.

Every query runs once to warm up and then BENCH_RUNS times; the median counts. The full job
(``ranked_records``) recomputes everything each time. The reports read the ranked table the job has
written, so the time to make that table is given apart as ``scored_table``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries as registered  # noqa: E402

HEADLINES = [
    "engagement_features",
    "entity_features",
    "readiness",
    "ranked_records",
    "what_if_ranks",
    "duplicate_emails",
    "lead_dq_flags",
    "contact_dq_flags",
    "dq_findings",
    "cleaning_stats",
    "engagement_history",
    "top_callable",
    "fairness",
    "score_summary",
    "custom_scorer",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("callrank-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(query, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}

    start = time.perf_counter()
    registered.ranked(spark, sf_dir)
    seconds["scored_table_cold"] = time.perf_counter() - start
    for name in HEADLINES:
        query = registered.ALL[name]
        run(query, spark, sf_dir)
        seconds[name] = statistics.median(run(query, spark, sf_dir) for _ in range(runs))
    seconds = {name: round(value, 3) for name, value in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "callrank headline queries, sum of medians",
                "value": round(sum(seconds[name] for name in HEADLINES), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
