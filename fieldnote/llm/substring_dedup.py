"""Removal of long passages that an earlier document already holds, over a compacted de Bruijn graph of words.

Nodes are anchors: runs of ``ANCHOR`` words that are the least by hash among all runs of a window of ``window``
words, the leftmost on ties. Which run is least depends on the words of the window alone, so equal windows have
the same anchor at the same place, and about one word in eighteen starts an anchor.

A document's path runs from anchor to anchor. The stretch around an anchor, all words of all windows that may
have it as their anchor, is its *context*. Where documents agree the context is the same: those paths do not
branch there, and the whole run of windows is settled by one row, the context's first document. Only where an
anchor has several contexts does the graph branch; there the first document of each context sends the hash of
each of its windows, and the first document per window is found. A passage is thus compacted to one row per
anchor however many documents hold it. Joins carry the place (document and word) of the earlier copy along;
anchor, context and window hashes of 64 bits each are compared together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.llm.store import stored
from fieldnote.llm.wordhash import Q, batches, mix, powers, runs, window_hashes, word_hashes, words

ANCHOR = 16


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` neighbours the index of its smallest value, the leftmost on ties."""
    n = len(h) - w + 1
    best, at, width = h.copy(), np.arange(len(h)), 1
    while width < w:
        step = min(width, w - width)
        m = len(best) - step
        right = best[step:] < best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        width += step
    return at[:n]


def _span_hash(sums: np.ndarray, down: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((sums[e] - sums[a]) * down[a] + (e - a).astype(np.uint64))


def anchors_of(h: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of one text's word hashes: per anchor its word, anchor hash, context hash, and its windows' first and last start."""
    least = _least(window_hashes(h, ANCHOR), window - ANCHOR + 1)
    first, end = runs(least)
    at = least[first]
    last = end - 1
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(Q, len(h)), out=sums[1:])
    down = powers(np.uint64(pow(int(Q), -1, 2**64)), len(h) + 1)
    anchor = _span_hash(sums, down, at, at + ANCHOR)
    context = mix(_span_hash(sums, down, first, last + window) + (at - first).astype(np.uint64) * Q)
    return at, anchor, context, first, last


def _anchors(window: int):
    """(id, row, n_words, sha, anchors): one row per text; an anchor is (anchor, context, first window, last window)."""
    kind = pa.struct([("anchor", pa.int64()), ("context", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in batches(it, "text"):
            w = words(t)
            h = word_hashes(t, w)
            parts, sizes, sha = [], [], []
            raw = t.data.tobytes()
            for r, (a, e) in enumerate(zip(w.rows[:-1], w.rows[1:], strict=True)):
                sha.append(hashlib.sha256(b" ".join(_word_bytes(raw, t.offsets[r], t.offsets[r + 1]))).hexdigest())
                if e - a < window:
                    sizes.append(0)
                    continue
                _, anchor, context, first, last = anchors_of(h[a:e], window)
                parts.append((anchor, context, first, last))
                sizes.append(len(anchor))
            cols = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (zip(*parts, strict=True) if parts else [()] * 4)]
            items = pa.StructArray.from_arrays(
                [pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], fields=list(kind)
            )
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w.counts().astype(np.int64)), pa.array(sha), lists], names=["id", "row", "n_words", "sha", "anchors"])

    return run


def _word_bytes(raw: bytes, a: int, e: int) -> list[bytes]:
    return raw[a:e].split()


def _branch_windows(window: int):
    """(anchor, id, row, at, window hash) of the windows of the named anchors of each text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in batches(it, "text"):
            w = words(t)
            h = word_hashes(t, w)
            wanted = b.column(3)
            ids, out = [], []
            for r in range(len(t)):
                own = h[w.rows[r] : w.rows[r + 1]]
                hashes = window_hashes(own, window)
                for s in wanted[r].as_py():
                    at = np.arange(s["first"], s["last"] + 1)
                    out.append((np.full(len(at), s["anchor"], np.int64), at, hashes[at].view(np.int64)))
                    ids.append(np.full(len(at), r))
            if out:
                anchor, at, hashed = (np.concatenate(x) for x in zip(*out, strict=True))
                row = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), b.column(0).take(row), b.column(1).take(row), pa.array(at.astype(np.int32)), pa.array(hashed)], names=["anchor", "id", "row", "at", "hash"])

    return run


def _cut(window: int):
    """(id, row, n_words, n_removed, sha, kept) of texts with the windows [first, last] to remove."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in batches(it, "text"):
            raw = t.data.tobytes()
            n, gone, sha, kept = [], [], [], []
            for r, spans in enumerate(b.column(3).to_pylist()):
                w = _word_bytes(raw, t.offsets[r], t.offsets[r + 1])
                edge = np.zeros(len(w) + 1, np.int64)
                for s in spans:
                    edge[s["first"]] += 1
                    edge[min(s["last"] + window, len(w))] -= 1
                keep = np.cumsum(edge)[: len(w)] == 0
                left = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
                n.append(len(w))
                gone.append(int((~keep).sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["id", "row", "n_words", "n_removed", "sha", "kept"])

    return run


def repeated_windows(d: DataFrame, table: DataFrame, window: int) -> DataFrame:
    """(id, row, first, last, src_id): runs of windows of a text that also start in a text with a smaller id."""
    kind = d.schema["id"].dataType.simpleString()
    rows = table.filter("id is not null").select("id", "row", F.explode("anchors").alias("a")).select("id", "row", "a.*")
    contexts = stored(rows.groupBy("anchor", "context").agg(F.min("id").alias("src_id"), F.max("id").alias("most")), "contexts")
    anchors = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.min("src_id").alias("least"), F.max("most").alias("most")).filter("least < most")
    # contexts that matter: of anchors that two or more texts hold
    live = stored(contexts.join(anchors.select("anchor", "n"), "anchor").drop("most"), "contexts")
    held = stored(rows.join(live, ["anchor", "context"]), "held")
    whole = held.filter("src_id < id").select("id", "row", "first", "last", "src_id")
    # branches: the first text of each context against the first texts of the other contexts of the anchor
    heads = held.filter("n > 1 and src_id = id").groupBy("id", "row").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("wanted"))
    asked = d.join(heads, ["id", "row"]).select("id", "row", "text", "wanted")
    windows = stored(asked.mapInArrow(_branch_windows(window), f"anchor long, id {kind}, row long, at int, hash long"), "windows")
    firsts = windows.groupBy("anchor", "hash").agg(F.min("id").alias("src_id"), F.max("id").alias("most")).filter("src_id < most").drop("most")
    single = windows.join(firsts, ["anchor", "hash"]).filter("src_id < id").select("id", "row", F.col("at").alias("first"), F.col("at").alias("last"), "src_id")
    return whole.union(single)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept``, ``sources``, ``row_hash`` (of the text).

    A word goes if a window of ``window`` words that covers it also starts in a row with a smaller id, judged on
    the input. Null and empty texts have no words. Repeats inside one id stay, also over several rows of that id.
    Rows with a null id are kept whole and are no source. ``kept_sha256`` is of the kept words joined by one space;
    ``kept`` is that text, and null where nothing was removed; ``sources`` are the ids of the earlier copies.
    """
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    key = ["id", "row"]
    table = stored(
        d.mapInArrow(_anchors(window), f"id {kind}, row long, n_words long, sha string, anchors array<struct<anchor: long, context: long, first: int, last: int>>"), "anchors"
    )
    spans = repeated_windows(d, table, window)
    per_row = stored(
        spans.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"), F.array_sort(F.collect_set("src_id")).alias("sources")), "spans"
    )
    cut = d.join(per_row.select(*key, "spans"), key).select(*key, "text", "spans").mapInArrow(_cut(window), f"id {kind}, row long, n_words long, n_removed long, sha string, kept string")
    cut = cut.join(per_row.select(*key, "sources"), key)
    rest = table.join(per_row.select(*key), key, "left_anti").select(
        *key, "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", F.lit(None).cast("string").alias("kept"), F.lit(None).cast(f"array<{kind}>").alias("sources")
    )
    return cut.unionByName(rest).select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("sha").alias("kept_sha256"), "kept", "sources", F.col("row").alias("row_hash"))
