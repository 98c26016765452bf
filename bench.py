"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``: one JSON line of seconds per query."""

from __future__ import annotations

import json
import os
import time

from fieldnote.plans import registry
from fieldnote.session import local_session

HEADLINE = [
    "normalised_text", "personal_data_scrubbed", "language_tags", "relevance_gate", "exact_duplicates", "near_duplicates", "similar_texts",
    "echo_pairs", "record_funnel", "story_funnel", "coverage", "crosstab", "derived_measures", "reliability", "opportunities",
    "weight_sensitivity", "sample_spread", "merged_spans", "verified_quotes", "derived_spine", "ranked_texts", "answer_audit", "thread_records", "ingest_tally",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    jobs = registry.load()
    # One small job first, so that no query pays for the start of the session.
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        jobs[name].job(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
