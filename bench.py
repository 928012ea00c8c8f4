"""Wall times of the headline queries. Prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and threads; BENCH_QUERIES=all runs every registered query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pyspark.sql import SparkSession  # noqa: E402
from riskframe.plans import load_all  # noqa: E402

HEADLINE = [
    "flagship_value_leaks", "d00_scan_rules", "d02_redirect_leads", "d13_transport_headers", "d27_text_leaks", "d28_taint_flows", "p04_mask_comments", "normalize_reports", "n10_norm_sarif",
    "a01_dedupe_findings", "a02_merge_scan_modes", "a04_summarize", "a06_calibrate", "a12_clusters", "a14_input_digest", "j01_unique_match", "j04_in_hunk", "j05_suppress", "j06_acknowledge", "j07_enrich_exploitability",
    "j10_blast_radius", "j11_baseline_diff", "j15_truth_match", "j16_grade_reports", "t09_attack_surface", "t10_contract_diff", "a25_gate_verdict", "s02_classify_read", "s15_write_sarif", "w04_top_findings", "m04_lifecycle_stream", "ledger_end_to_end",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("riskframe-bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    qs = load_all()[0]
    names = list(qs) if os.environ.get("BENCH_QUERIES") == "all" else [n for n in HEADLINE if n in qs]
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
