"""Periodic runs of words, found with a dictionary of basic factors.

The basic factors of a text are its stretches of 1, 2, 4, 8, ... words. The dictionary names them: equal stretches of
one document have equal names, and the name of a stretch is made from the names of its two halves, so it is exact.
Per length L, successor occurrences at most 2 L words apart form arithmetic progressions, and each progression
proposes its difference as a period. A proposal is extended word by word to both sides; proposals of one stretch are
one. Places whose stretch does not recur within the longest period that the text has room for leave the dictionary, so
it shrinks fast from length to length.

Why none is missed: let a run have the smallest period q and at least ``least`` and three times q words. For the
shortest length L >= q of 8 or more, its first stretch of L words occurs again q words later, still inside the run, and
not in between (a word sequence with smallest period q meets itself only at multiples of q). All stretches of the run
recur q words before or after, so its places stay in the dictionary on the way to L.

Rows are independent: texts are read whole, in chunks of a few megabytes, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.llm.quality import words_of
from fieldnote.llm.wordhash import Texts, Words, batches, runs, words

FIRST_LENGTH = 8
"""Shortest length that proposes periods; before it no place leaves the dictionary."""
STEP = 512
"""Words compared at once when a proposal is extended."""


def word_codes(t: Texts, w: Words) -> np.ndarray:
    """One number per word of some texts; equal words, byte by byte, have equal numbers."""
    size = w.ends - w.starts
    inside = np.repeat(w.starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(t.data[inside])])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    key = left * (int(right.max(initial=0)) + 1) + right
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.zeros(len(key), np.int64)
    new[1:] = np.cumsum(ordered[1:] != ordered[:-1])
    out = np.empty(len(key), np.int64)
    out[order] = new
    return out


def _gaps(name: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per place, the distance to the next occurrence of its name in its document, 0 for none; and to the one before."""
    order = np.argsort(name, kind="stable")  # places stand in ascending order, so they do within a name
    n, a, d = name[order], at[order], doc[order]
    gap = np.where((n[1:] == n[:-1]) & (d[1:] == d[:-1]), a[1:] - a[:-1], 0)
    out = np.zeros((2, len(name)), np.int64)
    out[0, order[:-1]] = gap
    out[1, order[1:]] = gap
    return out


def proposals(code: np.ndarray, rows: np.ndarray, times: int) -> np.ndarray:
    """(row, start, end, period): stretches of words ``[start, end)`` that equal those ``period`` words later.

    ``code`` are the words of some texts, ``rows[r]:rows[r+1]`` those of row r; starts count over all texts.
    """
    n = len(code)
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    ends, most = rows[1:][doc], (np.diff(rows) // times)[doc]
    at, name, length = np.arange(n), code, 1
    found = []
    while length < FIRST_LENGTH:
        keep = np.flatnonzero(at + 2 * length <= ends[at])
        # all places with room for a stretch of this length are still there
        place = np.full(n, -1)
        place[at] = np.arange(len(at))
        name = _named(name[keep], name[place[at[keep] + length]])
        at, length = at[keep], 2 * length
    while len(at):
        after, before = _gaps(name, at, doc[at])
        near = np.flatnonzero((after > 0) & (after <= np.minimum(2 * length, most[at])))
        if len(near):
            # progressions: neighbours of one difference whose stretches touch are one proposal
            period, start = after[near], at[near]
            order = np.lexsort((start, period, doc[start]))
            period, start = period[order], start[order]
            fresh = np.ones(len(start), bool)
            fresh[1:] = (period[1:] != period[:-1]) | (doc[start[1:]] != doc[start[:-1]]) | (start[1:] > start[:-1] + length)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(start)) - 1
            found.append(np.stack([doc[start[first]], start[first], start[last] + length, period[first]], 1))
        alive = ((after > 0) & (after <= most[at])) | ((before > 0) & (before <= most[at]))
        at, name = at[alive], name[alive]
        place = np.full(n, -1)
        place[at] = np.arange(len(at))
        room = at + 2 * length <= ends[at]
        half = np.where(room, place[np.minimum(at + length, n - 1)], -1)
        keep = np.flatnonzero(half >= 0)
        name, at, length = _named(name[keep], name[half[keep]]), at[keep], 2 * length
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def _extended(code: np.ndarray, low: int, high: int, start: int, end: int, period: int) -> tuple[int, int]:
    """The longest stretch of equal words ``period`` apart around ``[start, end)``, between words ``low`` and ``high``."""
    high -= period
    while end < high:
        to = min(end + STEP, high)
        differ = np.flatnonzero(code[end:to] != code[end + period : to + period])
        if len(differ):
            end += int(differ[0])
            break
        end = to
    while start > low:
        to = max(start - STEP, low)
        differ = np.flatnonzero(code[to:start] != code[to + period : start + period])
        if len(differ):
            start = to + int(differ[-1]) + 1
            break
        start = to
    return start, end


def runs_of(code: np.ndarray, rows: np.ndarray, least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Per row the runs (start, length, period) with at least ``least`` words and ``times`` periods, by start and period."""
    best: dict[tuple[int, int, int], int] = {}
    seen: dict[tuple[int, int], int] = {}
    table = proposals(code, rows, times)
    for r, start, end, period in table[np.lexsort((table[:, 1], table[:, 3], table[:, 0]))].tolist():
        if end <= seen.get((r, period), -1):
            continue  # inside the last stretch of this period
        a, e = _extended(code, int(rows[r]), int(rows[r + 1]), start, end, period)
        seen[r, period] = e
        size = e - a + period
        if size >= max(least, times * period):
            # the stretch has this period; its smallest one divides it and is proposed too
            key = (r, a, size)
            best[key] = min(best.get(key, period), period)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(rows) - 1)]
    for (r, a, size), period in best.items():
        out[r].append((a - int(rows[r]), size, period))
    for own in out:
        own.sort(key=lambda x: (x[0], x[2]))
    return out


def _rows(least: int, times: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in batches(it, "text"):
            w = words(t)
            found = runs_of(word_codes(t, w), w.rows, least, times)
            raw = t.data.tobytes()
            texts = []
            for r, own in enumerate(found):
                parts = raw[t.offsets[r] : t.offsets[r + 1]].split()
                if own:
                    edge = np.zeros(len(parts) + 1, np.int64)
                    for start, length, period in own:
                        edge[start + period] += 1
                        edge[start + length] -= 1
                    parts = [x for x, cut in zip(parts, np.cumsum(edge), strict=False) if not cut]
                texts.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(w.counts()),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found], kind),
                    pa.array([x.decode("utf-8") if own else None for x, own in zip(texts, found, strict=True)], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                ],
                names=["id", "n_words", "runs", "collapsed", "collapsed_sha256"],
            )

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``runs``, ``collapsed``, ``collapsed_sha256``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a longest stretch of words with smallest period p, at least ``least`` and
    ``times`` p words long (``times`` is 3 or more, ``least`` 16 or more: what the dictionary proves). ``runs`` are ordered by start, then period; each has
    ``start`` (from 0), ``length`` and ``period``. ``collapsed`` is the text without the words of each run after its
    first p, joined by one space, and null where there is no run; its digest is always there. Null and empty texts
    have no words and no runs. Repeated rows and null ids are rows like others; an empty table gives none.
    """
    if times < 3 or least < 2 * FIRST_LENGTH:
        raise ValueError("times must be 3 or more and least 16 or more")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    out = d.mapInArrow(_rows(least, times), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string, collapsed_sha256 string")
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``periodic_runs``: number of runs, the run of greatest exact exponent, and digests of runs and text."""
    top = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        # ordered by start and period, so only a greater exponent takes the place; products of two lengths fit 64 bits
        lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a),
    )
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    d = found.withColumn("top", top)
    return d.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every tenth text, by crc32 of the id, with its words from a place on replaced by repeats of the first of them."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    d = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.floor(h / 10).cast("long").alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("chosen"))
    d = d.withColumn("w", F.when(F.col("chosen"), words_of(F.coalesce("text", F.lit(""))))).withColumn("n", F.coalesce(F.size("w"), F.lit(-1)).cast("long"))
    d = d.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    body = F.expr("slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))")
    return d.select(id_col, F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, int(a))"), body), " ")).otherwise(F.col("text")).alias("text"))
