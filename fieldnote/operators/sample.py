"""Reproducible samples. The order of a sample is a hash of the row's id and a seed, so it does not
depend on partitions, and every rank is cut at the sample size, which Spark applies before it shuffles:
a stratum of any size sends at most that many rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_of(id_column: str, seed: int | str) -> Column:
    return F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed))))


def _first(df: DataFrame, by: Sequence[str], order: Sequence, most: int, name: str = "r") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= most)


def simple(df: DataFrame, k: int, seed: int, id_column: str = "story_id") -> DataFrame:
    """``k`` rows."""
    return df.withColumn("__o", order_of(id_column, seed)).orderBy("__o", id_column).limit(k).drop("__o")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their rank ``r``."""
    return _first(df, group, order, k)


def proportional(df: DataFrame, strata: Sequence[str], n: int, seed: int, id_column: str = "story_id") -> DataFrame:
    """Each stratum in proportion to its size, at least one row each, ``n`` rows at most."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"), F.lit(1).alias("one"))
    quota = sizes.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select(
        *strata, F.greatest(F.lit(1), F.bround(n * F.col("size") / F.col("total"), 0).cast("int")).alias("k")
    )
    rows = _first(df.withColumn("__o", order_of(id_column, seed)), strata, ["__o", id_column], n)
    # ``n`` rows are left per stratum, so the join and the last sort are small.
    return (
        rows.join(quota, list(strata))
        .filter(F.col("r") <= F.col("k"))
        .orderBy(*strata, "r")
        .limit(n)
        .drop("__o", "r", "k")
    )


def spread_within(
    df: DataFrame, strata: Sequence[str], spread: str, n: int, seed: int, id_column: str = "story_id"
) -> DataFrame:
    """Proportional over strata; inside a stratum one row of each ``spread`` value before a second one."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"), F.lit(1).alias("one"))
    quota = sizes.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select(
        *strata, F.greatest(F.lit(1), F.bround(n * F.col("size") / F.col("total"), 0).cast("int")).alias("k")
    )
    rows = _first(
        df.withColumn("__o", order_of(id_column, seed)), [*strata, spread], ["__o", id_column], n, "__turn"
    )
    rows = _first(rows, strata, ["__turn", spread], n)
    return (
        rows.join(quota, list(strata))
        .filter(F.col("r") <= F.col("k"))
        .orderBy("__o", id_column)
        .limit(n)
        .drop("__o", "__turn", "r", "k")
    )


def equal_per_group(df: DataFrame, group: str, n: int, seed: int, id_column: str = "record_id") -> DataFrame:
    """``n // groups`` rows of every group, topped up to ``n`` from the rest."""
    groups = df.select(group).distinct().agg(F.count("*").alias("groups"), F.lit(1).alias("one"))
    rows = _first(df.withColumn("__o", order_of(id_column, seed)), [group], ["__o", id_column], n)
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("groups")))
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(groups), "one").withColumn("__extra", F.col("r") > quota)
    # Rows inside the quota come first; the top-up follows in hash order.
    return rows.orderBy("__extra", "__o", id_column).limit(n).drop("__o", "r", "one", "groups", "__extra")


def confident_round_robin(
    df: DataFrame, confidence: str, spread: str, n: int, seed: int, id_column: str = "story_id"
) -> DataFrame:
    """The ``2n`` most confident rows, then one of each ``spread`` value in turn until ``n``."""
    pool = df.orderBy(F.desc(confidence), id_column).limit(2 * n).withColumn("__o", order_of(id_column, seed))
    turn = F.row_number().over(W.partitionBy(spread).orderBy("__o", id_column))
    return pool.withColumn("__turn", turn).orderBy("__turn", spread).limit(n).drop("__o", "__turn")
