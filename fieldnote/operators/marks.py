"""Marks: rows are set aside by an exclusions table, never deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK_COLUMNS = ["record_id", "story_id", "source", "stage", "reason", "detail", "run_id"]


def record_marks(exclusions: DataFrame) -> DataFrame:
    return exclusions.filter(F.col("story_id").isNull())


def story_marks(exclusions: DataFrame) -> DataFrame:
    return exclusions.filter(F.col("story_id").isNotNull())


def live_records(records: DataFrame, exclusions: DataFrame, before_stage: str | None = None) -> DataFrame:
    """Records with no record-level mark. ``before_stage`` ignores the marks of that one stage."""
    marks = record_marks(exclusions)
    if before_stage is not None:
        marks = marks.filter(F.col("stage") != before_stage)
    return records.join(marks.select("record_id"), "record_id", "left_anti")


def live_stories(stories: DataFrame, exclusions: DataFrame) -> DataFrame:
    return stories.join(story_marks(exclusions).select("story_id"), "story_id", "left_anti")


def mark(
    rows: DataFrame, stage: str, reason: str | Column, detail: str | Column, run_id: str, story: bool = False
) -> DataFrame:
    """One mark per row, in the shape of the exclusions table."""

    def col(x: str | Column) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    return rows.select(
        "record_id",
        (F.col("story_id") if story else F.lit(None).cast("string")).alias("story_id"),
        "source",
        F.lit(stage).alias("stage"),
        col(reason).alias("reason"),
        col(detail).alias("detail"),
        F.lit(run_id).alias("run_id"),
    )


def add_marks(exclusions: DataFrame, new: DataFrame) -> DataFrame:
    """Append marks; a (record, story, stage) that is marked already keeps its first mark."""
    key = ["record_id", "__story", "stage"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(*MARK_COLUMNS, F.coalesce("story_id", F.lit("")).alias("__story"))

    payload = F.struct("reason", "detail", "run_id", "source", "story_id")
    fresh = (
        keyed(new)
        .join(keyed(exclusions).select(*key), key, "left_anti")
        .groupBy(*key)
        .agg(F.min(payload).alias("p"))
        .select("record_id", "p.story_id", "p.source", "stage", "p.reason", "p.detail", "p.run_id")
    )
    return exclusions.select(*MARK_COLUMNS).unionByName(fresh)


def replace_stage_marks(exclusions: DataFrame, stage: str, new: DataFrame) -> DataFrame:
    """A gate's marks are its current judgement: earlier marks of the stage give way to the new ones."""
    return add_marks(exclusions.filter(F.col("stage") != stage), new)
