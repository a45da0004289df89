"""Time the headline queries: one JSON line with seconds per query (warm, results computed in full)."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from secondlook.plans.queries import QUERIES  # noqa: E402
from secondlook.session import local_session  # noqa: E402

HEADLINE = (
    "audit_run",
    "review_batch",
    "review_batch_scored",
    "detect_injection",
    "injection_matches",
    "pii_summary",
    "pii_flags",
    "parse_response",
    "validate_output",
    "prompt_hash",
    "miss_prompts_distinct",
    "cache_lookup",
    "cache_upsert",
    "cache_touch",
    "cache_stats",
    "inject_label_noise",
    "inject_label_noise_dynamic",
    "generate_samples",
    "text_variations",
    "labeled_dataset",
    "verdict_metrics",
    "label_distribution",
    "sink_results_json",
    "run_summary",
    "stream_audit",
)


def seconds(spark, name: str, sf_dir: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        seconds(spark, name, sf_dir)
        times[name] = round(seconds(spark, name, sf_dir), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
