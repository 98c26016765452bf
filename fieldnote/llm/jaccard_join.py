"""Exact Jaccard join of texts as a metric-space join over word shingles.

``d(A, B) = 1 - |A and B| / |A or B|`` is a metric on shingle sets. Almost all texts are at distance 1 from any
given text, so text pivots alone cannot split a corpus: every window would hold everything. The join therefore
has two levels of pivots.

1. *Shingle pivots.* All shingles are put in one order, rarest first. For a shingle e, the number of shingles
   of A before e is the size of the difference between A cut at e and the empty set, itself a metric, so by the
   triangle inequality it differs by at most ``|A minus B|`` between A and B. Two texts within the threshold
   have ``|A minus B| <= (1 - t) |A|``. Let e be their first common shingle: everything of A before e is in
   ``A minus B``, so e stands within the first ``(1 - t) |A| + 1`` shingles of A, and likewise of B. A text's
   home region is that of its first pivot, and it is replicated to the regions of the other pivots in this
   window. A pair within the threshold shares a region; texts with enough shingles that nobody else has share
   no pivot with anyone and leave at once.
2. *Text pivots.* Each region takes one of its texts as pivot and measures its texts against it: the one with the
   fewest shingles that nobody else has, which is the middle of a family of copies, while edited copies have some
   of their own. Texts within the threshold of the pivot are linked with it, so they are one component and need no
   comparison with each other, however many they are. A region with texts outside the ball is taken again with a
   pivot among those, as long as a round settles a tenth of what is open; then what is still open is compared,
   if the triangle inequality allows it: ``|d(x, p) - d(y, p)| <= 1 - t``, and the windows' places and sizes
   leave room for the overlap.

Shingles are counted by hash range: a map task sends each range one packed row per block of texts, and a range
task counts its shingles and sends back to each text's own task those that two or more different sets hold.
Each shingle crosses the network once in eight bytes. Equal sets are one set with a 64-bit fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.llm.components import components
from fieldnote.llm.store import stored
from fieldnote.llm.wordhash import Q, Texts, batches, distinct, mix, powers, runs, window_hashes, word_hashes, words

SKETCH_BITS = 1024
AT_ONCE = 1_000_000
"""Text bytes that are shingled together."""
BYTES_A_PART = 8_000_000
"""Text bytes whose shingles one range task counts."""


def shingle_sets(t: Texts, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lowered; a text shorter than ``k`` words is one shingle."""
    w = words(t)
    h = word_hashes(t, w, lower=True)
    grams = window_hashes(h, k)
    out = []
    for a, e in zip(w.rows[:-1], w.rows[1:], strict=True):
        if e - a >= k:
            out.append(distinct(grams[a : e - k + 1]))
        elif e > a:
            out.append(mix((h[a:e] * powers(Q, e - a)).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> np.uint64:
    """Of a set of hashes; equal sets have equal fingerprints."""
    return mix(mix(s).sum(dtype=np.uint64, keepdims=True) * Q + np.uint64(len(s)))[0]


def window_size(n: int, percent: int) -> int:
    """How many first shingles of a set of ``n`` must hold one of any set with that similarity in percent."""
    return n - (percent * n + 99) // 100 + 1


def _sizes(id_col: str, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in batches(it, "text", AT_ONCE):
            sets = shingle_sets(t, k)
            n = np.array([len(s) for s in sets], np.int64)
            fp = np.array([fingerprint(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(fp, mask=n == 0)], names=[id_col, "n", "fp"])

    return run


def _pack(sets: np.ndarray, counts: np.ndarray, *columns: np.ndarray) -> bytes:
    return b"".join([np.uint32(len(sets)).tobytes(), sets.tobytes(), counts.astype(np.uint32).tobytes(), *[c.tobytes() for c in columns]])


def _sent(k: int, parts: int):
    """Packed rows (part, blob): fingerprints and sizes of the sets, then their shingles of that hash range."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in batches(it, "text", AT_ONCE):
            sets = [s for s in shingle_sets(t, k) if len(s)]
            if not sets:
                continue
            n = np.array([len(s) for s in sets], np.uint32)
            fp = np.array([fingerprint(s) for s in sets], np.uint64)
            flat = np.concatenate(sets)
            part = ((flat >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            flat, part, row = flat[order], part[order], np.repeat(np.arange(len(sets)), n)[order]
            (at, to), blobs = runs(part), []
            for a, e in zip(at, to, strict=True):
                first, last = runs(row[a:e])
                own = row[a:e][first]
                blobs.append(_pack(fp[own], last - first, n[own], flat[a:e]))
            yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return run


def _read(it: Iterator[pa.RecordBatch], with_df: bool) -> list[np.ndarray]:
    """(fingerprint, size, shingle[, df]) columns of all packed rows of a task."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for b in it:
        for blob in b.column(1):
            raw = blob.as_buffer()
            k = int(np.frombuffer(raw, np.uint32, 1)[0])
            fp = np.frombuffer(raw, np.uint64, k, 4)
            counts = np.frombuffer(raw, np.uint32, k, 4 + 8 * k)
            n = np.frombuffer(raw, np.uint32, k, 4 + 12 * k)
            total = int(counts.sum())
            out[0].append(np.repeat(fp, counts))
            out[1].append(np.repeat(n, counts))
            out[2].append(np.frombuffer(raw, np.uint64, total, 4 + 16 * k))
            if with_df:
                out[3].append(np.frombuffer(raw, np.uint32, total, 4 + 16 * k + 8 * total))
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out[: 3 + with_df]]


def _counted(parts: int):
    """A range task: the shingles that two or more sets hold go to their sets' tasks, with the number of sets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, n, h = _read(it, False)
        order = np.argsort(h)
        sorted_h = h[order]
        same = np.zeros(len(h) + 1, dtype=bool)
        same[1:-1] = sorted_h[1:] == sorted_h[:-1]
        order = order[same[:-1] | same[1:]]
        fp, n, h = fp[order], n[order], h[order]
        order = np.lexsort((fp, h))
        fp, n, h = fp[order], n[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
        fp, n, h = fp[new], n[new], h[new]
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        df = count[inverse].astype(np.uint32) if len(h) else np.zeros(0, np.uint32)
        fp, n, h, df = fp[df > 1], n[df > 1], h[df > 1], df[df > 1]
        part = fp % np.uint64(parts)
        order = np.lexsort((fp, part))
        fp, n, h, df, part = fp[order], n[order], h[order], df[order], part[order]
        (at, to), blobs = runs(part), []
        for a, e in zip(at, to, strict=True):
            first, last = runs(fp[a:e])
            blobs.append(_pack(fp[a:e][first], last - first, n[a:e][first], h[a:e], df[a:e]))
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return run


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Per bucket of the hashes whether it holds an odd number, packed; sketches differ in at most as many bits as the sets."""
    odd = np.bincount((h % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _windowed(percent: int):
    """A set task: sets with fewer unshared shingles than their window, their shared shingles and their pivots."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, n, h, df = _read(it, True)
        order = np.lexsort((h, df, fp)) if len(fp) else np.zeros(0, np.int64)
        fp, n, h = fp[order], n[order], h[order]
        rows: list[tuple] = []
        for a, e in zip(*runs(fp), strict=True):
            size = int(n[a])
            alone = size - (e - a)
            room = window_size(size, percent) - alone
            if room > 0:
                shared = h[a:e].view(np.int64)
                rows.append((int(fp[a : a + 1].view(np.int64)[0]), size, int(alone), shared, shared[:room], parity_sketch(h[a:e])))
            if len(rows) == 256:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        x, n, alone, shared, pivots, sketch = zip(*rows, strict=True)
        many = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()), pa.array(n, pa.int64()), pa.array(alone, pa.int64()), pa.array(shared, many), pa.array(pivots, many), pa.array(sketch, many)],
            names=["x", "n", "alone", "shared", "pivots", "sketch"],
        )

    return run


def window_table(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(x, n, alone, shared, pivots, sketch) of the distinct sets that may have a partner; ``docs`` has a column text."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BYTES_A_PART))
    sent = docs.select("text").mapInArrow(_sent(k, parts), "part int, blob binary")
    counted = sent.repartition(parts, "part").mapInArrow(_counted(parts), "part int, blob binary")
    return counted.repartition(parts, "part").mapInArrow(
        _windowed(percent), "x long, n long, alone long, shared array<long>, pivots array<long>, sketch array<long>"
    )


def _may_link(percent: int):
    """Sizes and places of two texts in one region leave room for the overlap that the threshold asks for."""
    both = f"{percent} * (n + m)"
    return F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m) and {100 + percent} * least(n - i, m - j) >= {both}")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, n, m, common) with the exact size of the overlap: common shingles are shared ones, and those are all kept."""
    left = pairs.join(sets.select("x", "n", F.col("shared").alias("sx")), "x")
    both = left.join(sets.select(F.col("x").alias("y"), F.col("n").alias("m"), F.col("shared").alias("sy")), "y")
    return both.select("x", "y", "n", "m", F.size(F.array_intersect("sx", "sy")).cast("long").alias("common"))


def merged_labels(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (x, label) after some more links (x, y): only links between different labels so far are looked at again."""
    if label is None:
        return stored(components(links, "x", "y").withColumnRenamed("id", "x"), "labels")
    of_x, of_y = label.select("x", F.col("label").alias("a")), label.select(F.col("x").alias("y"), F.col("label").alias("b"))
    between = links.join(of_x, "x", "left").join(of_y, "y", "left").select(F.coalesce("a", "x").alias("a"), F.coalesce("b", "y").alias("b")).filter("a <> b").distinct()
    more = components(between).select("id", F.col("label").alias("to"))
    known = label.join(more.withColumnRenamed("id", "label"), "label", "left").select("x", F.coalesce("to", "label").alias("label"))
    new = more.join(label.select(F.col("x").alias("id")), "id", "left_anti").select(F.col("id").alias("x"), F.col("to").alias("label"))
    return stored(known.unionByName(new), "labels")


def linked_labels(sets: DataFrame, percent: int) -> DataFrame:
    """(x, label) of the sets of ``window_table`` that have a partner: the components that all pairs within the threshold make."""
    rows = stored(sets.select("x", "n", F.posexplode("pivots").alias("i", "e"), "alone").select("e", "x", "n", (F.col("i") + F.col("alone")).alias("i"), "alone"), "regions")
    sizes = rows.groupBy("e").agg(F.count("*").alias("texts")).filter("texts > 1")
    rows = stored(rows.join(sizes.select("e"), "e"), "regions")
    close = F.expr(f"100 * common >= {percent} * (n + m - common)")
    label = None
    outside = rows.withColumn("label", F.col("x"))
    inside, open_, before = outside, rows.count(), None
    while open_ and (before is None or 10 * open_ <= 9 * before):
        before = open_
        pivots = outside.groupBy("e").agg(F.min(F.struct("alone", "x", "n", "i")).alias("p")).select("e", F.col("p.x").alias("y"), F.col("p.n").alias("m"), F.col("p.i").alias("j"))
        pairs = inside.join(pivots, "e").filter("x <> y").filter(_may_link(percent)).select("x", "y").distinct()
        found = stored(measured(pairs, sets), "distances")
        label = merged_labels(label, found.filter(close).select("x", "y"))
        # a pivot's distances are settled; texts of its component need no more comparison with each other
        named = rows.join(label, "x", "left").withColumn("label", F.coalesce("label", "x"))
        settled = pivots.select("e", F.col("y").alias("p")).join(label.withColumnRenamed("x", "p"), "p", "left").select("e", "p", F.coalesce("label", "p").alias("ball"))
        known = found.select("x", F.col("y").alias("p"), (1 - F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("d"))
        named = named.join(settled, "e").filter("x <> p").join(known, ["x", "p"], "left").drop("p")
        inside = stored(named, "inside")
        rows = inside.select("e", "x", "n", "i", "alone")
        outside = inside.filter("label <> ball")
        open_ = outside.count()
        alive = outside.select("e").distinct()
        inside = inside.join(alive, "e", "left_semi")
    sketches = sets.select("x", "sketch")
    if label is None:
        return sets.select("x", F.col("x").alias("label")).limit(0)
    a = outside.join(sketches, "x").select("e", "x", "n", "i", "label", "d", "alone", "sketch")
    b = inside.join(sketches, "x").select(
        "e", F.col("x").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("label").alias("other"), F.col("d").alias("c"), F.col("alone").alias("lone"), F.col("sketch").alias("sk")
    )
    slack = (100 - percent) / 100 + 1e-9
    apart = " + ".join(f"bit_count(sketch[{w}] ^ sk[{w}])" for w in range(SKETCH_BITS // 64))
    near = F.expr(f"{100 + percent} * (alone + lone + {apart}) <= {100 - percent} * (n + m)")
    open_pairs = (
        a.join(b, (a["e"] == b["e"]) & (F.col("label") != F.col("other")) & F.expr(f"coalesce(abs(d - c) <= {slack}, true)") & _may_link(percent) & near)
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
    )
    return merged_labels(label, stored(measured(open_pairs, sets).filter(close).select("x", "y"), "links"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    Two texts link when ``100 * |A and B| >= percent * |A or B|``. A null, empty or wordless text has no shingle,
    links with nothing and is its own component. Repeated rows stay; rows with one id and several texts each get
    their own component. A null id is kept and never names a component that has another id.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = stored(d.mapInArrow(_sizes("id", k), f"id {d.schema['id'].dataType.simpleString()}, n long, fp long"), "sizes")
    sets = stored(window_table(d, k, percent), "sets")
    label = linked_labels(sets, percent).withColumnRenamed("x", "fp")
    first = sizes.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("first")).join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    first = stored(first, "first")
    names = first.groupBy("label").agg(F.min("first").alias("component_id"))
    by_set = first.join(names, "label").select("fp", "component_id")
    return sizes.join(by_set, "fp", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
