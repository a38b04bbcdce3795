"""Time the headline queries; prints one JSON line.

Each query is planned, run and fully consumed twice in one session: ``queries`` holds the
warm time, ``cold`` the first one.
"""

from __future__ import annotations

import importlib
import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINES = (
    "normalize_text",
    "token_f1",
    "rouge_l",
    "rigorous_conversations",
    "rigorous_questions",
    "ablation_conversations",
    "judge_score",
    "parse_judge_questions",
    "conversation_records",
    "sample_records",
    "sample_per_type",
    "vector_topk",
    "lexical_topk",
    "multi_channel",
    "usage_totals",
    "timing_report",
    "latest_run",
    "resume_plan",
    "verify_manifest",
    "metrics_table",
    "check_transitions",
    "rate",
    "stall_alerts",
    "histogram",
)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    entry = importlib.import_module("__spark_entry__")
    session = importlib.import_module("recollect.session")
    spark = session.local_session(cores, "bench")
    known = entry.queries()
    cold, warm = {}, {}
    for name in HEADLINES:
        for times in (cold, warm):
            start = time.perf_counter()
            with session.staging(spark, "bench"):
                consume(known[name](spark, sf_dir))
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total warm time of the headline queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": Path(sf_dir).name,
            }
        )
    )


if __name__ == "__main__":
    main()
