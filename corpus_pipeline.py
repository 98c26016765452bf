"""A training corpus from ``documents``: each stage works on all that the one before kept.

Toxic documents go; of each group of near copies (five-word shingles, similarity 0.8) the one with the smallest id
stays; passages of 50 words and more that an earlier document holds are cut; sources are mixed to their weights, a
document standing once per copy; the mix is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnote.llm.jaccard_join import near_copies
from fieldnote.llm.mix_sources import mixed
from fieldnote.llm.packing import packed
from fieldnote.llm.store import stored
from fieldnote.llm.substring_dedup import without_repeats
from fieldnote.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, carry=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of repeated rows one. Rows without an id are kept."""
    first = near_copies(docs, k=5, percent=80).filter("component_id = doc_id or component_id is null or doc_id is null").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document of which nothing is left goes."""
    changed = without_repeats(docs).filter("kept is not null").select(F.col("doc_id").alias("id"), F.col("row_hash").alias("h"), "kept").dropDuplicates(["id", "h"])
    out = docs.join(changed, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("h")), "left").filter("kept is null or kept <> ''")
    return out.select("doc_id", F.coalesce("kept", "text").alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = mixed(docs).filter("copies > 0").select(F.col("row_hash").alias("h"), "copies").dropDuplicates(["h"])
    out = docs.join(copies, F.xxhash64("doc_id", "text") == F.col("h"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1,024 tokens."""
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL: str | None = None
"""SQL cannot express scores, coins of the mix and tokens; tests compare each stage with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
