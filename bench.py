"""Headline queries timed on local cores; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of threads.
Every query runs over its whole input and its whole result is produced.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postloom.plans.registry import all_queries  # noqa: E402
from postloom.session import build_session, steps_cleared  # noqa: E402

HEADLINES = [
    "agg_board_status", "agg_api_stats", "jobs_browse", "topk_matches_all_users", "match_score",
    "salary_doda", "fingerprint", "fp_backfill", "expire_stale", "page_cap", "profile_classes",
    "profile_tags", "cards_doda", "cards_green", "ingest_dedup", "ingest", "criteria_upsert",
    "j_score_cross", "best_jobs_all_users", "agg_match_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = wanted.split(",") if wanted else HEADLINES
    spark.read.parquet(f"{folder}/orders.parquet").count()
    seconds = {}
    for name in names:
        with steps_cleared(spark):
            start = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
