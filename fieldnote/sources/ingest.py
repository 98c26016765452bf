"""Writing collected records once: new ids only, with every fetched item accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.schemas import schema


def _first_arrivals(incoming: DataFrame) -> DataFrame:
    """The arrival number of the first row of each id. ``arrival`` is unique, so the way back is a join
    on unique keys and an id that came a million times is no heavier than any other."""
    return (
        incoming.filter(F.col("record_id").isNotNull())
        .groupBy("record_id")
        .agg(F.min("arrival").alias("arrival"))
    )


def new_records(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows to append: first of their id in this batch, and not stored yet. First write wins. Reads ``incoming`` once."""
    row = F.struct(*incoming.columns)
    first = incoming.filter(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.min_by(row, "arrival").alias("r"))
    return first.join(existing.select("record_id"), "record_id", "left_anti").select("r.*")


def tally(incoming: DataFrame, existing: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """One row: fetched, written_new, already_present, all_deleted, duplicate_in_batch, deleted_posts.

    ``existing`` are the ids stored before, ``written`` the rows that were really stored from this batch (as read back
    from the sink; without it those of ``new_records``). Each outcome is counted on its own side: written rows among what was written, the
    others among what came in. The job fails when they do not add up to what was fetched.
    """
    written = new_records(incoming, existing) if written is None else written
    per_id = incoming.filter(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.count("*").alias("n"))
    stored = existing.select("record_id", F.lit(1).alias("stored")).dropDuplicates(["record_id"])
    per = per_id.join(stored, "record_id", "left").agg(
        F.count("stored").alias("already_present"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_in_batch"), F.lit(1).alias("one")
    )
    new = written.agg(F.count("record_id").alias("written_new"), F.lit(1).alias("one"))
    totals = incoming.agg(
        F.count("*").alias("fetched"),
        F.count_if(F.col("record_id").isNull()).alias("all_deleted"),
        F.coalesce(F.sum("n_deleted"), F.lit(0)).alias("deleted_posts"),
        F.lit(1).alias("one"),
    )
    out = totals.join(per, "one").join(new, "one").select("fetched", "written_new", "already_present", "all_deleted", "duplicate_in_batch", "deleted_posts")
    sum_ = F.col("written_new") + F.col("already_present") + F.col("all_deleted") + F.col("duplicate_in_batch")
    return out.withColumn(
        "fetched",
        F.when(F.col("fetched") == sum_, F.col("fetched")).otherwise(
            F.raise_error(F.lit("fetched items are not all accounted for")).cast("bigint")
        ),
    )


def yields(incoming: DataFrame, existing: DataFrame, queries: DataFrame) -> DataFrame:
    """New records per search term. The first term that surfaced a record has the credit; a term that
    found nothing new is a row of zero."""
    got = new_records(incoming, existing).groupBy("collect_query").agg(F.count("*").alias("n"))
    return queries.select("collect_query").distinct().join(got, "collect_query", "left").select(
        "collect_query", F.coalesce("n", F.lit(0)).alias("new_records")
    )


def append_new(incoming: DataFrame, path: str, source: str | None = None) -> None:
    """Append the new records of a batch to a stored table, partitioned by source.

    The batch is read once. With ``source``, the one all its rows have, only that partition's ids are read.
    """
    spark = incoming.sparkSession
    columns = schema("records").fieldNames()
    try:
        existing = spark.read.schema(schema("records")).parquet(path)
        existing = existing.select("record_id") if source is None else existing.filter(F.col("source") == source).select("record_id")
        existing.schema  # noqa: B018 - resolves the path
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = spark.createDataFrame([], "record_id string")
    new_records(incoming, existing).select(*columns).write.mode("append").partitionBy("source").parquet(path)
