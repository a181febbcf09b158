"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data folder, BENCH_CPUS (default 8) the local cores.
BENCH_QUERIES may list other query names, separated by commas; "all" runs every registered query.
"""

from __future__ import annotations

import json
import os
import time

from meterloom.plans import catalog
from meterloom.session import build_session

HEADLINE = (
    "agg_daily_by_model", "agg_totals", "agg_by_model", "agg_projects", "agg_heatmap", "agg_cycle", "agg_machine",
    "agg_sessions", "agg_session_stats", "win_context", "joi_compaction_asof", "agg_admin", "prc_value", "blk_blocks",
    "blk_ceiling", "alt_fired", "mrg_transcript", "mrg_counts", "mrg_meta", "mrg_email_gate", "prs_usage", "prs_limits",
    "otl_metrics", "str_dedup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    asked = os.environ.get("BENCH_QUERIES")
    names = list(queries) if asked == "all" else asked.split(",") if asked else list(HEADLINE)
    queries["agg_daily_by_model"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
