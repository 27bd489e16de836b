"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import checks  # noqa: E402
from perkwise.session import local_session  # noqa: E402

HEADLINES = [
    "fea8_customer_features", "ing1_validate_transactions", "ing2_insert_ignore", "ing4_upsert_customers",
    "fst4_write_version", "fst5_latest_features", "mod5_stratified_split", "mod9_roc_auc",
    "mod10_average_precision", "ret6_nearest_cosine", "ret9_retrieve_eligible", "ret11_retrieve_or_all",
    "ret16_latency_summary", "gen2_render_template", "gen5_instruct_prompts", "gen6_parse_copy",
    "gen12_recommendations", "evl3_sentence_bleu", "evl4_rouge_l", "cal2_latency_histogram",
    "drf5_drift_status", "drf6_feature_breakdown", "fbk1_windowed_stats", "fbk2_version_means",
    "fbk6_preference_pairs", "fbk10_customer_signals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    checks.load()
    # Start the JVM's and the Python workers' code paths outside the measurement.
    for name in ("fea8_customer_features", "ret6_nearest_cosine"):
        checks.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINES:
        started = time.perf_counter()
        checks.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
