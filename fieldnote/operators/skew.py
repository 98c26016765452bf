"""Joins that stay spread out when one key holds a large part of the rows.

Every grouping in this package aggregates before it shuffles, so a hot key costs one partial row per
map task. What is left is carrying a per-key result back to the rows of that key. ``keyed_join`` does
that: the largest keys are salted on the row side and their single result row is copied once per salt,
so no task receives a whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 200_000
"""A key with fewer rows than this fits one task and is never salted; so at most one key in 200,000 rows is."""

SALTS = 64


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """The keys of a per-key count table that one task should not hold: every one of them is salted."""
    return (
        counts.filter(F.col(n) >= HOT_ROWS)
        .select(*keys, n)
        .distinct()
        .select(*[F.col(k).alias(f"__hot_{k}") for k in keys])
    )


def keyed_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    salt_by: Sequence[str | Column],
    n: str = "n",
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` with ``per_key`` (few rows per key, carrying the row count ``n`` of the key).

    ``salt_by`` names columns that differ between the rows of one key. Hot keys are split over
    ``SALTS`` tasks; all other keys join once. The result is the plain equi-join.
    """
    hot = hot_keys(per_key, keys, n)
    is_hot = F.col(f"__hot_{keys[0]}").isNotNull()
    match = [F.col(k) == F.col(f"__hot_{k}") for k in keys]
    drop = [f"__hot_{k}" for k in keys]

    def mark(df: DataFrame) -> DataFrame:
        cond = match[0]
        for m in match[1:]:
            cond = cond & m
        return df.join(F.broadcast(hot), cond, "left")

    left = mark(rows).withColumn(
        "__salt", F.when(is_hot, F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    ).drop(*drop)
    right = mark(per_key).withColumn(
        "__salt",
        F.explode(
            F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        ),
    ).drop(*drop)
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
