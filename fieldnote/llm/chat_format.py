"""Conversations as marked text with a loss mask, and back, in Spark expressions only.

A conversation is ``<turn role>text</turn>`` and a line feed per message; adjacent turns of one role are one message
whose texts are parted by ``<part>``. Inside roles and texts ``\\``, ``<`` and ``>`` become ``\\s``, ``\\l`` and
``\\g``, so control strings of the template, or of any other that starts with these, never occur in a text and every
text comes back as it was. The loss mask is a list of spans (start, length in code points of the formatted text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation; ``loss`` spans cover the texts of role ``trained``.

    Turns stand in the order of their number, ties by role and text; all repeated rows are kept. A null text or
    role is empty, a null number comes first, rows with a null conversation are one conversation.
    """
    d = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    body = escaped(F.col("text"))
    parts = d.select(
        "conv_id",
        "role",
        F.row_number().over(order).alias("i"),
        body.alias("body"),
        F.when(F.lag("role").over(order) == F.col("role"), "<part>").otherwise(F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">"))).alias("before"),
        F.when(F.lead("role").over(order) == F.col("role"), "").otherwise("</turn>\n").alias("after"),
    )
    whole = F.length("before") + F.length("body") + F.length("after")
    placed = parts.withColumn("at", F.sum(whole).over(Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.length("after") - F.length("body"))
    rows = placed.select("conv_id", F.struct("i", F.concat("before", "body", "after").alias("piece"), "role", "at", F.length("body").cast("long").alias("n")).alias("t"))
    kept = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return kept.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == trained), lambda x: F.struct(x["at"].alias("start"), x["n"].alias("length"))).alias("loss"),
    )


def turns_of(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    messages = F.filter(F.split(text, "</turn>\n"), lambda m: m != "")

    def one(m: Column) -> Column:
        mark = F.substring_index(m, ">", 1)
        role = unescaped(F.substr(mark, F.lit(7)))
        return F.transform(F.split(F.substr(m, F.length(mark) + 2), "<part>"), lambda p: F.struct(role.alias("role"), unescaped(p).alias("text")))

    return F.flatten(F.transform(messages, one))


def loss_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(chats: DataFrame) -> DataFrame:
    """Read back from the formatted text and the mask: number of turns and digests."""
    read = chats.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("trained"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
