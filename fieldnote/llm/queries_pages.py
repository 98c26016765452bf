"""Queries on ``pages``: main text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldnote.llm.html_main import main_texts
from fieldnote.llm.registry import query


@query("op4_html_main")
def op4_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
