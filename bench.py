"""Timings of the headline queries: one JSON line.

Each query runs once to warm up and then three times; the median counts. A
result is written to Spark's ``noop`` sink, so every row is computed in full.
BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (names, comma separated) choose the
data, the cores and the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from netvigil.plans.registered import QUERIES
from netvigil.session import local_session

HEADLINE = (
    "a1_active_threats", "a3_suspicious_ips", "a5_action_breakdown", "a6_protocol_share",
    "a7_traffic_5m", "a8_top_malicious", "a9_top_blocked", "a10_threat_score",
    "a11_active_alerts", "a_kpi_cards", "w1_hourly_delta", "w3_cumulative_share", "n1_spikes",
    "e1_ip_profile", "u1_timeline", "j1_geo_enrich", "j2_geo_enrich_ranges",
    "j3_reputation_enrich", "j4_match_hashes", "j4_match_hosts", "j5_never_blocked",
    "f3_filter_packets", "f6_search", "f7_lookup", "l1_latest", "p4_parse_size",
    "s3_ingest_good", "t1_stream_traffic", "t3_stream_actions",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(
        "bench",
        cpus,
        **{
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="netvigil-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
