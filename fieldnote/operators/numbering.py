"""Numbers for all rows of a table in one order, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.functions import text as tx
from fieldnote.session import checkpointed


def numbered(df: DataFrame, order: list[str], name: str = "nth") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of the columns ``order``.

    Rows are dealt to tasks by ranges and sorted there; a row's place is its place in its range plus the rows of the
    ranges before, and only one count per range meets in one row. Rows equal in ``order`` stand in any order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the upper bits of the id are the range, the lower 33 the place in it
    ranged = checkpointed(ranged.withColumn("__id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__range", F.shiftright("__id", 33))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("__range", "n"))).alias("all"))
    sums = counts.withColumn("to", tx.running_sums(F.transform("all", lambda x: x["n"])))
    before = sums.select(F.explode(F.transform("all", lambda x, i: F.struct(x["__range"].alias("__range"), (F.get("to", i) - x["n"]).alias("__before")))).alias("x")).select("x.*")
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(before, "__range").withColumn(name, place).drop("__id", "__range", "__before")
