"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.llm.store import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for every id in ``links``; equal labels are reachable, the label is the smallest id.

    Each round hooks every node to its smallest neighbour, follows those hooks twice more and contracts the links
    to what is left between different labels, so stars vanish in one round and a chain of length n in about log n.
    Grouping aggregates before it shuffles; joins may be split where one node has many links. Null ends and self
    links are left out.
    """
    ends = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = stored(ends.distinct(), "links")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.select(F.col("u").alias("id"), F.least("u", "v").alias("near")).union(edges.select(F.col("v").alias("id"), F.least("u", "v").alias("near")))
        hooks = stored(both.groupBy("id").agg(F.min("near").alias("to")), "hooks")
        for _ in range(2):
            on = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(on, "to").select("id", F.col("next").alias("to"))
        hooks = stored(hooks, "hooks")
        left = edges.join(hooks.select(F.col("id").alias("u"), F.col("to").alias("x")), "u").join(hooks.select(F.col("id").alias("v"), F.col("to").alias("y")), "v")
        edges = stored(left.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
        if labels is None:
            labels = hooks.select("id", F.col("to").alias("label"))
        else:
            up = hooks.select(F.col("id").alias("label"), "to")
            labels = labels.join(up, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        labels = stored(labels, "labels")
    return labels
