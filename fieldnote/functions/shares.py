"""Shares, intervals and tests on counts, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote import vocab


def wilson(n: Column, denom: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper Wilson score bounds; (0, 0) for an empty cell."""
    n, d = n.cast("double"), denom.cast("double")
    p = n / F.when(d > 0, d)
    scale = 1 + z * z / d
    centre = (p + z * z / (2 * d)) / scale
    half = (z / scale) * F.sqrt(p * (1 - p) / d + z * z / (4 * d * d))
    low = F.when(denom > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(denom > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0)
    return low, high


def tier(denom: Column) -> Column:
    return (
        F.when(denom < vocab.FLOOR, "insufficient")
        .when(denom < vocab.COMPARABLE, "directional")
        .otherwise("comparable")
    )


def percent(x: Column) -> Column:
    """A whole percentage, halves rounded to even."""
    return F.concat(F.bround(100 * x, 0).cast("int").cast("string"), F.lit("%"))


def with_share(df: DataFrame, n: str, denom: str) -> DataFrame:
    """Add ``tier, pct, lo, hi, share``. Under the floor there is a count and no percentage."""
    cn, cd = F.col(n), F.col(denom)
    lo, hi = wilson(cn, cd)
    counts = F.concat(cn.cast("string"), F.lit(" of "), cd.cast("string"))
    shown = cd >= vocab.FLOOR
    pct = F.when(shown, cn / F.when(cd > 0, cd))
    text = (
        F.when(~shown, counts)
        .when(
            cd < vocab.COMPARABLE,
            F.concat(
                percent(pct), F.lit(" ("), counts, F.lit(") · rough guide, likely "), percent(lo), F.lit("–"), percent(hi)
            ),
        )
        .otherwise(F.concat(percent(pct), F.lit(" ("), counts, F.lit(")")))
    )
    return df.withColumns(
        {"tier": tier(cd), "pct": pct, "lo": F.when(shown, lo), "hi": F.when(shown, hi), "share": text}
    )


def log_factorial(x: Column) -> Column:
    """ln(x!) of a whole number: exact logs of small factorials, Stirling's series beyond."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)])
    v = F.greatest(x, F.lit(1.0))
    series = (
        v * F.log(v) - v + 0.5 * F.log(2 * math.pi * v) + 1 / (12 * v) - 1 / (360 * F.pow(v, 3)) + 1 / (1260 * F.pow(v, 5))
    )
    return F.when(x <= 20, F.get(small, x.cast("int"))).otherwise(series)


def fisher_p(na: Column, da: Column, nb: Column, db: Column) -> Column:
    """Two-sided Fisher exact p of ``[[na, da-na], [nb, db-nb]]``.

    Only tables within 12 standard deviations of the mean are listed: all others together weigh less
    than a double can show.
    """
    row, col, total = da.cast("double"), (na + nb).cast("double"), (da + db).cast("double")
    mean = row * col / total
    sd = F.sqrt(mean * (1 - col / total) * (total - row) / F.greatest(total - 1, F.lit(1.0)))
    reach = 12 * sd + 12
    lo = F.greatest(F.lit(0.0), row + col - total, F.floor(mean - reach).cast("double"))
    hi = F.least(row, col, F.ceil(mean + reach).cast("double"))
    seen = na.cast("double")

    def log_weight(x: Column) -> Column:
        return -(
            log_factorial(x)
            + log_factorial(col - x)
            + log_factorial(row - x)
            + log_factorial(total - col - row + x)
        )

    logs = F.transform(F.sequence(lo.cast("bigint"), hi.cast("bigint")), lambda v: log_weight(v.cast("double")))

    def finish(weights: Column) -> Column:
        at = F.get(weights, (seen - lo).cast("int"))
        top = F.array_max(weights)
        all_of = F.aggregate(weights, F.lit(0.0), lambda s, w: s + F.exp(w - top))
        tail = F.aggregate(
            weights, F.lit(0.0), lambda s, w: s + F.when(w <= at + 1e-9, F.exp(w - top)).otherwise(0.0)
        )
        return F.least(F.lit(1.0), tail / all_of)

    p = F.get(F.transform(F.array(logs), finish), 0)
    return F.when((seen < lo) | (seen > hi), F.lit(0.0)).otherwise(p)


def differs(na: Column, da: Column, nb: Column, db: Column) -> Column:
    """May a difference be claimed: both cells comparable, and intervals apart or p below 0.05."""
    lo_a, hi_a = wilson(na, da)
    lo_b, hi_b = wilson(nb, db)
    apart = (hi_a < lo_b) | (hi_b < lo_a)
    enough = (da >= vocab.COMPARABLE) & (db >= vocab.COMPARABLE)
    return F.when(~enough, False).when(apart, True).otherwise(fisher_p(na, da, nb, db) < 0.05)


def in_words(n: Column, denom: Column) -> Column:
    """A share as the nearest plain fraction; NULL under the floor or when none is near."""
    v = n / F.when(denom > 0, denom)
    options = F.array(
        *[
            F.struct(F.abs(v - share).alias("gap"), F.lit(i).alias("i"), F.lit(phrase).alias("phrase"))
            for i, (share, phrase) in enumerate(vocab.PROPORTIONS)
        ]
    )
    best = F.array_min(options)
    return (
        F.when(denom.isNull() | (denom < vocab.FLOOR), F.lit(None).cast("string"))
        .when(v < 0.03, "only a handful")
        .when(best["gap"] <= vocab.PROPORTION_TOLERANCE, F.concat(F.lit("about "), best["phrase"]))
    )
