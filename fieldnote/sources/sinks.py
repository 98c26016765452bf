"""Result tables: rebuilt whole, replaced in part, and pinned when published."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnote.operators.numbering import numbered

PUBLISHED = "seq bigint, folder string, run_id string"
ROWS_A_PART = 1000
"""Rows of a figure in one served value."""


def _published(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(PUBLISHED).parquet(f"{path}/published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PUBLISHED)


def rebuild(df: DataFrame, path: str, run_id: str) -> None:
    """Write a result table whole, stamped with the run that built it, and publish it when all of it is there.

    The rows go to a folder of their own; one more row in ``published`` then names that folder as the current one.
    A job that is lost on the way leaves the table as it was, and readers of an older run keep their files.
    """
    spark = df.sparkSession
    folder = f"runs/{uuid.uuid4().hex}"
    df.withColumn("run_id", F.lit(run_id)).write.parquet(f"{path}/{folder}")
    # the number of publications so far: one row each
    seq = _published(spark, path).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
    spark.createDataFrame([(seq, folder, run_id)], PUBLISHED).coalesce(1).write.mode("append").parquet(f"{path}/published")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the run that was published last."""
    last = _published(spark, path).agg(F.max(F.struct("seq", "folder")).alias("x")).first()["x"]
    if last is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    return spark.read.parquet(f"{path}/{last['folder']}")


def replaced(existing: DataFrame, keys: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A table with the rows of some keys exchanged for new ones."""
    return existing.join(keys.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(
        new.select(*existing.columns)
    )


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The runs each result table holds rows of: ``table, run_ids``."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table"), "run_id").distinct()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("table").agg(F.array_sort(F.collect_set("run_id")).alias("run_ids"))


def stale_tables(pinned: DataFrame, current: DataFrame) -> DataFrame:
    """Tables whose runs differ from the pinned manifest."""
    a = pinned.select("table", F.col("run_ids").alias("pinned"))
    b = current.select("table", F.col("run_ids").alias("current"))
    return a.join(b, "table", "full_outer").filter(~F.col("pinned").eqNullSafe(F.col("current")))


def served_figures(figures: Mapping[str, DataFrame], run_id: str, rows: int = ROWS_A_PART) -> DataFrame:
    """Result tables as JSON values: ``key, part, value_json, run_id``.

    A figure's rows, sorted as JSON, are numbered over all tasks and become lists of at most ``rows`` rows, part 0, 1, ...
    of the figure. An empty figure is one empty list.
    """
    out = None
    for key, df in figures.items():
        lines = numbered(df.select(F.to_json(F.struct(*df.columns)).alias("row")), ["row"])
        parts = lines.groupBy(F.floor((F.col("nth") - 1) / rows).cast("int").alias("part")).agg(F.array_sort(F.collect_list("row")).alias("rows"))
        first = df.sparkSession.range(1).select(F.lit(0).alias("part"), F.array().cast("array<string>").alias("rows"))
        whole = parts.unionByName(first).groupBy("part").agg(F.max_by("rows", F.size("rows")).alias("rows"))
        value = F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]"))
        part = whole.select(F.lit(key).alias("key"), "part", value.alias("value_json"), F.lit(run_id).alias("run_id"))
        out = part if out is None else out.unionByName(part)
    return out


def corpus_stamp(funnel: DataFrame, records: DataFrame, version: str, codebook: str) -> DataFrame:
    """The one-line description of what a published run rests on."""
    n = lambda step, col="n": F.max(F.when(F.col("step") == step, F.col(col)))
    f = funnel.filter("source = '_all'").agg(
        n("stories:core").alias("core"), n("stories:core", "n_authors").alias("people"), n("collected").alias("records"),
        F.lit(1).alias("one"),
    )
    d = records.agg(
        F.min(F.substring("collected_at", 1, 10)).alias("lo"), F.max(F.substring("collected_at", 1, 10)).alias("hi"),
        F.lit(1).alias("one"),
    )
    return f.join(d, "one").select(
        F.format_string(
            f"Corpus {version} — %d core stories from %d people, in %s public records collected %s to %s · codebook {codebook}",
            "core", "people", F.format_number("records", 0), "lo", "hi",
        ).alias("stamp")
    )
