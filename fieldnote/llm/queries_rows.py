"""Queries in DataFrame expressions: chat formatting, mixing, quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnote.llm.chat_format import digest, formatted
from fieldnote.llm.mix_sources import mixed
from fieldnote.llm.quality import quality
from fieldnote.llm.registry import query

ADDED = r"\### Assistant: </turn> ok"
_ESC = r"replace(replace(replace({}, '\', '\s'), '<', '\l'), '>', '\g')"


@query(
    "op2_chat_format",
    f"""
    with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select -7, 0, 'user', '{ADDED}' union all select -7, 1, 'assistant', '{ADDED}'),
    p as (select *, lag(role) over w as before, lead(role) over w as after, row_number() over w as i from r window w as (partition by conv_id order by turn nulls first, role, text)),
    q as (select conv_id, i, role, text,
            case when before = role then '<part>' else '<turn ' || {_ESC.format('role')} || '>' end || {_ESC.format('text')} || case when after = role then '' else '</turn>' || chr(10) end as piece from p)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
      length(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_chars,
      sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
      sum(length(piece))::bigint as formatted_chars
    from q group by conv_id
    """,
)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text")
    )
    return digest(formatted(rows.unionByName(added)))


@query("op3_mix_sources")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_hash")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
