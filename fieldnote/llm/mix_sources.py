"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Each source gets a target; each of its documents is due ``target / source size`` copies, a whole number plus a
fraction. Fractions become whole by pairing documents: of two fractional ones, words move from one to the other
until one is taken or left, in a random direction that keeps every document's chance, and the words of the pair
stay as they were. One document of a group is left fractional; these residuals meet again in groups of the next
level, a reduction tree with up to ``WIDE`` branches. Groups hold documents of one source and like size (within a
factor of two), so a source ends with one residual per size class; those few are rounded from the longest down, each
taking over the words that the one before was short or over. A source misses its target by less than the smallest
of them, as a rule. Coins are hashes of document, level and seed: reruns agree, on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldnote.llm.store import stored

WIDE = 48
"""Documents of a group, on average; a group is folded within one row."""
WORD = r"[^\x20\x09-\x0D]+"
TINY = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): ``sizes`` has source and size; weights repeat over the sources in code-point order, null last.

    Sources share ``share`` times all words by weight, none above ``most`` times its own; what is above is shared
    again by weight. With sources in order of ``most * size / weight`` the ones at their limit come first, so one
    pass finds the common level of the rest. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = per.withColumn("weight", w).withColumn("limit", most * F.col("source_size")).withColumn("fill", F.col("limit") / F.col("weight"))
    t = t.withColumn("before", F.sum("limit").over(level.rowsBetween(Window.unboundedPreceding, -1))).withColumn("rest", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("at", (share * F.sum("source_size").over(everything) - F.coalesce("before", F.lit(0.0))) / F.col("rest"))
    common = F.min(F.when(F.col("at") <= F.col("fill"), F.struct("fill", "at"))).over(everything)["at"]
    return t.select("source", "source_size", F.least(F.col("limit"), F.coalesce(common, F.lit(float("inf"))) * F.col("weight")).cast("double").alias("target"))


def _coin(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def _folded(group: Column, level: int, seed: int) -> Column:
    """The documents of a group after pairing: at most one keeps a fractional ``p``."""

    def pair(acc: Column, x: Column) -> Column:
        a = acc["open"]
        up = F.least(1 - a["p"], x["p"] * x["size"] / a["size"])
        down = F.least(a["p"], (1 - x["p"]) * x["size"] / a["size"])
        step = F.when(_coin(a["h"], x["h"], F.lit(level), F.lit(seed)) * (up + down) < down, up).otherwise(-down)
        p = _snapped(a["p"] + step)
        q = _snapped(x["p"] - step * a["size"] / x["size"])
        first, second = _with_p(a, p), _with_p(x, q)
        whole = (p == 0) | (p == 1)
        return F.struct(F.when(whole, second).otherwise(first).alias("open"), F.concat(acc["done"], F.array(F.when(whole, first).otherwise(second))).alias("done"))

    start = F.struct(F.element_at(group, 1).alias("open"), F.slice(group, 1, 0).alias("done"))
    return F.aggregate(F.slice(group, 2, F.size(group)), start, pair, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def _snapped(p: Column) -> Column:
    return F.when(p < TINY, 0.0).when(p > 1 - TINY, 1.0).otherwise(p)


def _with_p(x: Column, p: Column) -> Column:
    return F.struct(x["h"].alias("h"), x["id"].alias("id"), x["size"].alias("size"), p.alias("p"))


def _spread_over(residuals: Column) -> Column:
    """Round the last residuals of a source, longest first, carrying the words that are short or over."""

    def one(acc: Column, x: Column) -> Column:
        due = x["size"] * x["p"] + acc["carry"]
        p = F.when(due * 2 >= x["size"], 1.0).otherwise(0.0)
        return F.struct((due - p * x["size"]).alias("carry"), F.concat(acc["done"], F.array(_with_p(x, p))).alias("done"))

    return F.aggregate(residuals, F.struct(F.lit(0.0).alias("carry"), F.slice(residuals, 1, 0).alias("done")), one, lambda acc: acc["done"])


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (words), ``source_size``, ``target`` of its source, ``copies``, ``taken`` (words), ``row_hash`` (of id and text).

    A null text has no words; documents without words are taken 0 times their 0 words. A null source is a source of
    its own, last in order. Repeated rows are documents of their own. Copies of a document never exceed the next
    whole number above ``target / source_size``.
    """
    sized = stored(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(id_col, text_col).alias("h")), "sizes"
    )
    targets = stored(source_targets(sized, weights, share, most), "targets")
    same = sized["source"].eqNullSafe(F.col("s"))
    due = sized.join(targets.withColumnRenamed("source", "s"), same).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = due.withColumn("base", F.floor(rate + TINY)).withColumn("p", _snapped(F.greatest(rate - F.col("base"), F.lit(0.0))))
    fixed = ["source", "source_size", "target", "base"]
    open_ = due.withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1))))).select(*fixed, "class", F.struct("h", "id", F.col("size").cast("double").alias("size"), "p").alias("x"))
    settled = open_.filter("x.size = 0 or x.p = 0").select(*fixed, "x")
    open_ = open_.filter("x.size > 0 and x.p > 0")
    level = 0
    while True:
        level += 1
        counts = stored(open_.groupBy("source", "class").agg(F.count("*").alias("n")), "counts")
        if counts.filter("n > 1").isEmpty():
            break
        groups = counts.select(F.col("source").alias("s"), F.col("class").alias("c"), F.ceil(F.col("n") / WIDE).alias("groups"))
        cell = F.pmod(F.xxhash64("x.h", "x.id", F.lit(level), F.lit(seed)), F.col("groups"))
        dealt = open_.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).withColumn("cell", cell)
        folded = dealt.groupBy(*fixed, "class", "cell").agg(F.sort_array(F.collect_list("x")).alias("g")).select(*fixed, "class", F.explode(_folded(F.col("g"), level, seed)).alias("x"))
        folded = stored(folded, "folded")
        settled = settled.unionByName(folded.filter("x.p = 0 or x.p = 1").select(*fixed, "x"))
        open_ = folded.filter("x.p > 0 and x.p < 1")
    last = open_.groupBy(*fixed).agg(F.sort_array(F.collect_list(F.struct(F.col("x.size").alias("size"), F.col("x.h").alias("h"), F.col("x.id").alias("id"), F.col("x.p").alias("p"))), asc=False).alias("g"))
    last = last.withColumn("g", F.transform("g", lambda x: _with_p(x, x["p"]))).select(*fixed, F.explode(_spread_over(F.col("g"))).alias("x"))
    copies = (F.col("base") + F.col("x.p")).cast("long")
    size = F.col("x.size").cast("long")
    return settled.unionByName(last).select(F.col("x.id").alias(id_col), size.alias("size"), "source_size", "target", copies.alias("copies"), (copies * size).alias("taken"), F.col("x.h").alias("row_hash"))
