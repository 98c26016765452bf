"""The cost ledger: usage times rates, and where a pass went over its estimate or the ceiling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldnote import vocab
from fieldnote.operators.spans import chunk_threads
from fieldnote.session import checkpointed


def usage_cost(
    model: Column, input_tokens: Column, cached_tokens: Column, output_tokens: Column, batch: Column,
    rates: Mapping[str, tuple[float, float, float]] = vocab.MODEL_RATES,
) -> Column:
    """USD of one run. A model without a rate fails the job instead of costing nothing."""
    usd = None
    fresh = F.greatest(input_tokens - cached_tokens, F.lit(0))
    for name, (inp, cached, out) in rates.items():
        c = (fresh * inp + cached_tokens * cached + output_tokens * out) / 1e6
        usd = F.when(model == name, c) if usd is None else usd.when(model == name, c)
    unknown = F.raise_error(F.concat(F.lit("no rate for model "), model)).cast("double")
    usd = F.when(model.isNull(), 0.0).otherwise(usd.otherwise(unknown))
    return usd * F.when(batch, vocab.BATCH_DISCOUNT).otherwise(1.0)


def with_cost(runs: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = usage_cost(
        F.col("model"), zero("input_tokens"), zero("cached_tokens"), zero("output_tokens"), F.coalesce("batch", F.lit(False))
    )
    return runs.withColumn("cost_usd", F.round(cost, 6))


def stage_costs(runs: DataFrame) -> DataFrame:
    """Tokens and USD per stage and in all."""
    return (
        with_cost(runs)
        .groupingSets([["stage"], []], "stage")
        .agg(
            F.grouping("stage").alias("g"),
            F.count("*").alias("runs"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("cached_tokens").alias("cached_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("cost_usd").alias("cost_usd"),
        )
        .withColumn("stage", F.when(F.col("g") == 1, "_all").otherwise(F.col("stage")))
        .drop("g")
    )


def running_total(rows: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Add ``before``: the sum of ``value`` over all earlier rows.

    Rows are range-partitioned by the order columns, each block is summed, and a row's total is its
    block's start plus the sum inside the block. The one window over everything has a row per block.
    """
    placed = checkpointed(rows.repartitionByRange(*order).withColumn("__block", F.spark_partition_id()))
    blocks = placed.groupBy("__block").agg(F.sum(value).alias("__sum"))
    earlier = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)).alias("__start"))
    inside = W.partitionBy("__block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0.0)))
        .join(F.broadcast(starts), "__block")
        .withColumn("before", F.col("__start") + F.col("__inside"))
        .drop("__block", "__start", "__inside")
    )


def budget_status(runs: DataFrame, ceiling: float = vocab.CEILING_USD, halt_at: float = vocab.HALT_MULTIPLE) -> DataFrame:
    """Per run: what was committed before it, whether it may start, and whether it must halt."""
    rows = runs.select(
        "run_id", "stage", "started_at", F.coalesce("estimate_usd", F.lit(0.0)).alias("estimate_usd"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
    )
    return (
        running_total(rows, "cost_usd", ["started_at", "run_id"])
        .withColumnRenamed("before", "committed_usd")
        .withColumns(
            {
                "over_ceiling": F.col("committed_usd") + F.col("estimate_usd") > ceiling,
                "over_estimate": (F.col("estimate_usd") > 0) & (F.col("cost_usd") > halt_at * F.col("estimate_usd")),
            }
        )
        .withColumn("status", F.when(F.col("over_ceiling") | F.col("over_estimate"), "halted_budget").otherwise("ok"))
    )


def unaccounted_runs(runs: DataFrame, halt_at: float = vocab.HALT_MULTIPLE) -> DataFrame:
    """Paid runs without an estimate or a cost, or past the halt line without having halted."""
    past = (F.col("estimate_usd") > 0) & (F.col("cost_usd") > halt_at * F.col("estimate_usd")) & (F.col("status") != "halted_budget")
    return runs.filter(
        F.col("model").isNotNull() & (F.col("estimate_usd").isNull() | F.col("cost_usd").isNull() | past)
    ).select("run_id")


def projected_cost(records: DataFrame, model: str, prompt_tokens: float, out_per_record: float, batch: bool = True) -> DataFrame:
    """What reading all threads would cost before it is bought.

    One request per part of a thread; tokens are characters over four plus the prompt of each request.
    """
    parts = chunk_threads(records)
    totals = parts.agg(
        F.count_distinct("record_id").alias("records"),
        F.count("*").alias("requests"),
        F.sum("chars").alias("chars"),
    )
    inp = F.floor(F.col("requests") * prompt_tokens + F.col("chars") / 4)
    out = F.floor(F.col("records") * out_per_record)
    return totals.withColumns({"input_tokens": inp, "output_tokens": out}).withColumn(
        "usd",
        F.bround(usage_cost(F.lit(model), F.col("input_tokens"), F.lit(0), F.col("output_tokens"), F.lit(batch)), 3),
    )
