"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query
computes its whole result (written to the ``noop`` sink). Before the timed run each
query is run once, untimed, on the smallest table folder beside the given one, so the
figures leave out the start of the JVM and of the Python workers.
"""

from __future__ import annotations

import json
import os
import time

from convoscope.plans.registry import all_queries
from convoscope.session import local_session

HEADLINE = (
    "reply_time_stats",
    "latency_periods",
    "turn_taking",
    "question_uptake",
    "session_shape",
    "burst_profile",
    "participant_totals",
    "message_features",
    "normalized_text",
    "imported_messages",
    "upsert_messages",
    "vocabulary",
    "lexical_diversity",
    "style_matching",
    "responsiveness_report",
    "chat_summary",
    "participant_profile",
    "chat_profile",
    "custom_questions",
    "full_assessment",
    "assessment_report",
    "session_windows",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("convoscope-bench", cpus)
    plans = all_queries()
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in HEADLINE:
            run(plans[name].plan(spark, small))

    timings = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(plans[name].plan(spark, folder))
        timings[name] = round(time.perf_counter() - started, 3)

    documents = spark.read.parquet(f"{folder}/documents.parquet")
    messages = documents.count()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "import_messages_per_sec": round(messages / timings["imported_messages"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
