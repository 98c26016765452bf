"""External answers come back as JSON lines; malformed ones become a reason, never a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = (
    "custom_id string, response struct<body:struct<output:array<struct<type:string,content:array<struct<type:string,text:string>>>>,"
    "usage:struct<input_tokens:bigint,output_tokens:bigint,input_tokens_details:struct<cached_tokens:bigint>>>>"
)


def parse_responses(lines: DataFrame, answer: str, column: str = "value") -> DataFrame:
    """``custom_id, answer, failure, input_tokens, output_tokens, cached_tokens`` per response line.

    ``answer`` is the type of the expected document. The first content part decides: a refusal is
    ``model_refusal``; text that is no such document, or no text, is ``coding_failed``.
    """
    r = lines.select(F.from_json(F.col(column), RESPONSE).alias("r"))
    body = F.col("r.response.body")
    parts = F.flatten(
        F.transform(
            F.filter(F.coalesce(body["output"], F.array().cast("array<struct<type:string,content:array<struct<type:string,text:string>>>>")), lambda o: (o["type"] == "message") & o["content"].isNotNull()),
            lambda o: o["content"],
        )
    )
    deciding = F.get(F.filter(parts, lambda c: c["type"].isin("refusal", "output_text")), 0)
    usage = body["usage"]
    rows = r.select(
        F.col("r.custom_id").alias("custom_id"),
        deciding["type"].alias("kind"),
        deciding["text"].alias("text"),
        F.coalesce(usage["input_tokens"], F.lit(0)).alias("input_tokens"),
        F.coalesce(usage["output_tokens"], F.lit(0)).alias("output_tokens"),
        F.coalesce(usage["input_tokens_details"]["cached_tokens"], F.lit(0)).alias("cached_tokens"),
    )
    whole = F.try_parse_json("text").isNotNull()
    return rows.select(
        "custom_id",
        F.when((F.col("kind") == "output_text") & whole, F.from_json("text", answer)).alias("answer"),
        F.when(F.col("kind") == "refusal", "model_refusal")
        .when((F.col("kind") == "output_text") & whole, None)
        .otherwise("coding_failed").alias("failure"),
        "input_tokens", "output_tokens", "cached_tokens",
    )


def answers_for(requested: DataFrame, parsed: DataFrame, key: str = "custom_id") -> DataFrame:
    """Every requested id with its answer or failure; an id without a response has ``missing``."""
    return requested.select(key).join(parsed, key, "left").withColumn(
        "failure",
        F.when(F.col("answer").isNull() & F.col("failure").isNull(), "missing").otherwise(F.col("failure")),
    )
