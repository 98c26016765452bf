"""Cleaning passes over the records table: what is set aside, what is counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote import vocab
from fieldnote.functions import text as tx
from fieldnote.operators import marks as mk


def scrub_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace personal data by typed placeholders; ``<column>_kinds`` lists what was found."""
    out = df
    for c in columns:
        out = out.withColumn("__s", tx.scrubbed(F.col(c)))
        out = out.withColumns({f"{c}_kinds": F.col("__s.kinds"), c: F.col("__s.text")}).drop("__s")
    return out


def leak_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that still show personal data, per column and kind: ``column, kind, rows``."""
    per_row = F.flatten(F.array(*[_labelled(c) for c in columns]))
    return (
        df.select(F.explode(per_row).alias("hit"))
        .groupBy(F.col("hit.column").alias("column"), F.col("hit.kind").alias("kind"))
        .agg(F.count("*").alias("rows"))
    )


def _labelled(column: str):
    return F.transform(tx.leaks(F.col(column)), lambda k: F.struct(F.lit(column).alias("column"), k.alias("kind")))


def tag_language(records: DataFrame) -> DataFrame:
    """Fill ``lang`` where it is NULL; rows that are tagged keep their tag."""
    return records.withColumn("lang", F.coalesce("lang", tx.detect_language(F.col("text_clean"))))


def language_counts(records: DataFrame) -> DataFrame:
    """How many of the untagged rows got each tag."""
    return (
        records.filter(F.col("lang").isNull())
        .groupBy(tx.detect_language(F.col("text_clean")).alias("lang"))
        .agg(F.count("*").alias("n"))
    )


def short_marks(records: DataFrame, run_id: str, floor: int = vocab.MIN_CHARS) -> DataFrame:
    short = records.filter(tx.too_short(F.col("text_clean"), floor))
    return mk.mark(short, "clean", "too_short", f"< {floor} letters or digits", run_id)


def all_terms() -> list[str]:
    return [t for group in vocab.LEXICON.values() for t in group]


def with_gate(df: DataFrame, text: str = "text_clean", terms: Sequence[str] | None = None) -> DataFrame:
    """Add ``passes`` and ``why``: the first rule that admits the text."""
    patterns = tx.lexicon_patterns(list(terms) if terms is not None else all_terms())
    return df.withColumn("why", tx.gate_reason(F.col(text), patterns)).withColumns(
        {"passes": F.col("why").isNotNull(), "why": F.coalesce("why", F.lit("no photo-like thing"))}
    )


def gate_marks(
    records: DataFrame, exclusions: DataFrame, run_id: str, terms: Sequence[str] | None = None
) -> DataFrame:
    """Marks of the relevance gate over the records no other stage has set aside."""
    others = exclusions.filter(F.col("stage") != "prefilter")
    judged = with_gate(mk.live_records(records, others), terms=terms)
    return mk.mark(judged.filter(~F.col("passes")), "prefilter", "lexicon_rejected", F.col("why"), run_id)


def browse(records: DataFrame, sources: Sequence[str], needle: str, newest: int = 60) -> tuple[DataFrame, DataFrame]:
    """(totals, newest rows) of the records of some sources that hold a string, case ignored."""
    hit = records.filter(F.col("source").isin(list(sources)) & F.ilike("text_clean", F.lit(f"%{needle}%")))
    totals = hit.agg(F.count("*").alias("n"), F.count_distinct("author_key").alias("n_authors"))
    rows = hit.orderBy(F.desc_nulls_last("created_at"), "record_id").limit(newest)
    return totals, rows


def excluded_sample(records: DataFrame, exclusions: DataFrame, reason: str, size: int = 30) -> DataFrame:
    marked = mk.record_marks(exclusions).filter(F.col("reason") == reason)
    return (
        marked.select("record_id", "detail")
        .join(records.select("record_id", "source", "text_clean"), "record_id")
        .orderBy("record_id")
        .limit(size)
    )
