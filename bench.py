"""Wall time of the headline queries. Prints one JSON line.

BENCH_SF_DIR: table folder (default sf0.1); BENCH_CPUS: local cores (default 8); BENCH_QUERIES: comma-separated names.
Each query runs once to warm up and once for the time. Results are written to the no-op sink, so every
row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowsieve.plans import registry  # noqa: E402
from flowsieve.session import build_session  # noqa: E402

HEADLINE = [
    "a03_verdict_breakdown", "a07_pairs", "a08_attackers", "a11_hourly", "a13_tactic_counts", "a15_kpis", "a18_campaigns", "a19_ack_state", "f02_search",
    "f03_cidr", "j01_rows", "j04_interval_correlate", "j05_suppress", "j12_label_by_window", "m01_stratified_split", "m08_hierarchical", "m12_auc",
    "o01_page_severity", "o04_hard_cap", "p02_to_features", "p16_normalize_alerts", "p17_format_predictions", "st1_flows_idle", "st1_flows_idle_active",
    "u02_dedup", "w02_campaign_view", "w07_event_gaps", "w09_rate_rule", "w10_iat_stats",
    "st2_stream_correlate", "st3_live_job", "st6_stream_counters", "st7_microbatches", "j05_networks", "w05_quota_sample",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
                                      "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.time()
            registry.runner(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - start
        times[name] = round(took, 3)
        print(f"{name} {took:.3f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
