"""Token ids in ORC files, in ascending order of document id.

ORC stores the ids as runs and bit-packed integers, in stripes that tasks read in parallel; row indexes and Bloom
filters on the document id let a reader of a few documents skip stripes and row groups. Rows are dealt to files by
ranges of (id, text hash), so a file holds a range of ids in order and needs to know only where its documents
start within it: starts over all files follow from one total per file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldnote.llm.tokens import crc32s, encoded, encoder

STRIPE_BYTES = 16 * 2**20
ROW_GROUP = 1000


def _ids(path: str, keep_space: bool, end: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b, ids, n in encoded(it, encoder(path, keep_space, end)):
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), lists], names=["id", "part", "start", "n_tokens", "ids"]
            )

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_space: bool = False, end: int = 2) -> None:
    """Encode ``docs`` and write one ORC row per document to ``path``.

    A null text is empty: its only id is ``end``. Rows with one id stand together, ordered by a hash of the text;
    null ids come first. Texts are read whole.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = d.schema["id"].dataType.simpleString()
    ordered = d.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    out = ordered.mapInArrow(_ids(tokenizer, keep_space, end), f"id {kind}, part int, start long, n_tokens long, ids array<int>")
    (
        out.write.format("orc")
        .option("compression", "zstd")
        .option("orc.bloom.filter.columns", "id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .save(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, part, start, n_tokens, ids): the files as written; filters on ``id`` reach stripes and row groups."""
    return spark.read.orc(path)


def _crc(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        lists = b.column(b.schema.get_field_index("ids"))
        ids = lists.flatten().to_numpy().view(np.uint32)
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n), pa.array(crc32s(ids, n))], names=["id", "part", "start", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """Read the files back: id, ``start`` over all files, ``n_tokens`` and ``ids_crc32`` of each document."""
    stored = read_tokens(spark, path)
    kind = stored.schema["id"].dataType.simpleString()
    rows = stored.select("id", "part", "start", "ids").mapInArrow(_crc, f"id {kind}, part int, start long, n_tokens long, ids_crc32 long")
    # one row per file: a small table whatever the number of documents
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(before, "part").select(F.col("id").alias(id_name), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
