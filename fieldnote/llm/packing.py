"""Best-fit packing of token pieces into sequences, by patterns of lengths.

Only the histogram of lengths reaches the driver: one count per length, at most ``size`` of them whatever the
number of documents. Patterns of up to four lengths that fill a sequence exactly are enumerated, repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and what is left is packed by best fit
over counts, longest first. The result is a table of slots (length, range of ranks, first sequence, offset): the
i-th piece of a length finds its sequence by its rank, without any shuffle of documents by sequence. Ranks come
from one count per (task, length).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldnote.llm.store import stored
from fieldnote.llm.tokens import crc32s, encoded, encoder

SWEEPS = 30
"""Rounds of coordinate descent of the least-squares fit."""


def _pieces(path: str, size: int, end: int):
    """(id, piece, start, length, ids_crc32, part, rank): pieces with their rank among the task's of that length."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b, ids, n in encoded(it, encoder(path, True, end)):
            count = -(-n // size)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * size
            length = np.where(piece == 0, head[row], size)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
            order = np.argsort(length, kind="stable")
            own = length[order]
            rank = np.empty(len(own), np.int64)
            rank[order] = seen[own] + np.arange(len(own)) - np.searchsorted(own, own)
            seen += np.bincount(own, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(piece), pa.array(start), pa.array(length), pa.array(crc32s(ids, length)), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)],
                names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return run


def full_patterns(present: np.ndarray, size: int, each: int = 16) -> list[tuple[int, ...]]:
    """Patterns of two to four of the lengths ``present`` that add up to ``size``; up to ``each`` of each kind per longest length."""
    here = np.zeros(size + 1, bool)
    here[present] = True
    out: set[tuple[int, ...]] = set()
    for a in present[::-1].tolist():
        left = size - a
        if 0 < left <= a and here[left]:
            out.add((a, left))
        b = present[(present <= min(a, left - 1)) & (present * 2 >= left)]
        b = b[here[left - b]]
        for x in b[np.unique(np.linspace(0, len(b) - 1, each).astype(int))].tolist() if len(b) else []:
            out.add((a, x, left - x))
        for x in present[(present <= min(a, left - 2)) & (present * 3 >= left)].tolist()[:: max(1, len(present) // each)]:
            rest = left - x
            c = present[(present <= min(x, rest - 1)) & (present * 2 >= rest)]
            c = c[here[rest - c]]
            if len(c):
                y = int(c[(a * 31 + x * 17) % len(c)])
                out.add((a, x, y, rest - y))
    return sorted(out, reverse=True)


def fitted_counts(patterns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative repeat counts that fit ``counts`` per length by least squares (coordinate descent)."""
    left = counts.astype(float).tolist()
    columns = [(list(Counter(p).items()), float(sum(k * k for k in Counter(p).values()))) for p in patterns]
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        for j, (column, norm) in enumerate(columns):
            step = sum(left[l] * k for l, k in column) / norm
            new = max(0.0, x[j] + step)
            if new != x[j]:
                for l, k in column:
                    left[l] -= k * (new - x[j])
                x[j] = new
    return np.array(x)


def packed_patterns(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every length exactly ``counts[length]`` times, each pattern within ``size``."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    patterns = full_patterns(np.flatnonzero(left), size)
    fit = fitted_counts(patterns, left) if patterns else np.zeros(0)
    for j in np.argsort(-fit, kind="stable"):
        need = Counter(patterns[j])
        n = min(int(fit[j] + 1e-6), *[int(left[l]) // k for l, k in need.items()])
        if n > 0:
            out.append((patterns[j], n))
            for l, k in need.items():
                left[l] -= k * n
    # the rest by best fit over counts: open sequences are kept by the room they have left
    rooms: dict[int, Counter[tuple[int, ...]]] = {}
    for l in np.flatnonzero(left)[::-1].tolist():
        n = int(left[l])
        while n:
            room = min((r for r in rooms if r >= l), default=None)
            if room is None:
                fits = size // l
                whole, rest = divmod(n, fits)
                for k, times in ((fits, whole), (rest, 1)):
                    if k and times:
                        rooms.setdefault(size - k * l, Counter())[(l,) * k] += times
                break
            open_ = rooms[room]
            pattern = next(iter(open_))
            fits = room // l
            times = min(open_[pattern], n // fits)
            k = fits
            if times == 0:
                times, k = 1, n
            open_[pattern] -= times
            if not open_[pattern]:
                del open_[pattern]
            if not open_:
                del rooms[room]
            rooms.setdefault(room - k * l, Counter())[pattern + (l,) * k] += times
            n -= times * k
    out += [(p, n) for by in rooms.values() for p, n in by.items()]
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) of every place of every pattern."""
    used: Counter[int] = Counter()
    out, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for l in pattern:
            out.append((l, used[l], used[l] + n, sequence, offset))
            used[l] += n
            offset += l
        sequence += n
    return out


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document longer than ``size`` ids is cut into full pieces after a first piece that takes the remainder; no
    other is cut. A null or empty text is its end id alone. Repeated rows are packed each. An empty table gives none.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    pieces = stored(d.mapInArrow(_pieces(tokenizer, size, end), f"id {kind}, piece long, start long, length long, ids_crc32 long, part int, rank long"), "pieces")
    by_task = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(size + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    names = ["l", "first", "last", "sequence", "offset"]
    table = pd.DataFrame(slots(packed_patterns(counts, size)), columns=names, dtype="int64")
    plan = spark.createDataFrame(table, ", ".join(f"{c} long" for c in names))
    before = by_task.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the plan has a bounded number of slots: a few per pattern, patterns a bounded number per length
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )
