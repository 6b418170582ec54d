"""Time the headline queries: python bench.py prints one JSON line.

Every query is planned afresh and its whole result is produced (``noop`` sink). The session is warmed up with one
query that is not counted; each query then runs three times and the middle time counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from rowtide.plans.catalogue import QUERIES
from rowtide.session import build_session

HEADLINE = [
    "y9_reconcile_days", "y11_reconcile_rows", "y3_window_replace", "y4_window_upsert", "y10_repair_days", "y14_compact_latest",
    "x3_apply_changes", "x3_apply_changes_stream", "w2_last_change_per_key", "w3_runs", "w4_counter_delta", "d1_job_config",
    "d4_latest_per_key_semi", "d9_lock_waits", "e7_duplicate_keys", "e8_statement_stats", "e11_ops_by_interval", "l1_top_statements",
    "m2_breaches", "m3_alert_state", "m3_alert_state_stream", "m3_alert_state_batches", "q1_parse_slow_blocks", "q2_parse_digest_dump", "q4_slow_summary", "b8_add_surrogate_key", "a7_key_ranges", "r1_run_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run("e1_row_count")
    times = {name: round(statistics.median(run(name) for _ in range(3)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
