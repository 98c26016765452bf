"""Column contracts of the evidence tables, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import types as T

POSTS = "array<struct<author_key:string,start:int,end:int>>"

TABLES: dict[str, str] = {
    "records": (
        "record_id string, source string, collect_method string, source_url string, native_id string, "
        "author_key string, created_at string, text_raw string, text_clean string, text_en string, "
        "lang string, rating int, engagement bigint, thread_context string, platform_hint string, "
        "region_hint string, collect_query string, collected_at string, ingest_run_id string, "
        f"posts {POSTS}"
    ),
    "exclusions": (
        "record_id string, story_id string, source string, stage string, reason string, detail string, "
        "run_id string"
    ),
    "stories": (
        "story_id string, record_id string, ordinal int, text string, char_start int, char_end int, "
        "author_key string, bucket string, bucket_reason string, bucket_conf double, "
        "reaches_stage int, run_id string"
    ),
    "story_spine": (
        "story_id string, photo_class string, media_type string, photo_subtype string, "
        "primary_stage string, failure_owner string, metric_node string, outcome string, "
        "mode_used string, severity int, urgency string, workaround boolean, workaround_text string, "
        "coding_conf double, why string, run_id string"
    ),
    "story_codes": (
        "story_id string, question string, value string, accuracy string, seq int, inferred boolean, "
        "confidence double, run_id string"
    ),
    "evidence": "story_id string, field string, span string, verified boolean, run_id string",
    "queries": (
        "story_id string, query_text string, shape string, attempt_no int, worked boolean, run_id string"
    ),
    "story_themes": "story_id string, theme string, span string, run_id string",
    "double_coding": (
        "story_id string, field string, coder string, value array<string>, run_id string"
    ),
    "runs": (
        "run_id string, stage string, started_at string, finished_at string, status string, "
        "model string, batch boolean, input_tokens bigint, cached_tokens bigint, output_tokens bigint, "
        "estimate_usd double, cost_usd double, params string"
    ),
    "dim_question": (
        "question string, stage string, block string, select string, text string, plain string, "
        "metric_node string, inferred boolean"
    ),
    "dim_value": "question string, value string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
