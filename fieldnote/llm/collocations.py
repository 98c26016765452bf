"""Phrase collocations from a weighted de Bruijn graph of words, per language.

Edges are the longest phrases, of ``LONGEST`` words; an edge leads from the node of its first words to the node of
its last, and its weight is the number of its occurrences. Each place of a piece of text has one window: an edge, or
near the end of the piece a shorter tail. Windows go to Spark one by one, which adds them up before and after its
shuffle, so their number follows the text and no task holds a table of its own in Python. The count of a shorter phrase is the
flow out of its node plus its tails: ``f(g) = sum of f(g x) over words x + tails ending with g``, one small grouping
per length. A node whose whole flow passes along one edge, in or out, is unary: it is compacted into that edge,
which is the rule that a phrase goes if a longer one holds it with the same count (if any longer one does, one with a
single word more does). As no phrase is longer than an edge, paths need not be walked further.

Windows end early where the next phrase is surely rare, so that few of them differ. A first pass
counts phrases of one to three words in tables of ``SLOTS`` hashed counters, which never count too little; a window is
only as long as all such phrases within it may reach ``least``. A phrase that reaches it is never cut, so counts of
candidates and of their parts are exact. The tables have a fixed size, of which one bit per slot is broadcast. With more
text than they can tell apart they cut less: then more different windows are shuffled, at most one per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldnote.llm.store import stored
from fieldnote.llm.wordhash import LOWER, Texts, Words, batches, mix, runs, window_hashes, word_hashes, words

LONGEST = 5
SLOTS = 1 << 23
"""Counters per length; one bit of each is broadcast, 3 MB in all."""
COUNTED = 3
PAGE = 1 << 16
TOGETHER = 1 << 20
"""Hashes that are gathered before they are counted."""
ROWS = 1 << 16
"""Windows that are handed to Spark together."""

ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False


def _places(t: Texts, lang: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of some texts; per word its piece (ascending over all texts) and a hash of the language."""
    w = words(t, INSIDE)
    ends = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(ENDS[t.data], out=ends[1:])
    row = w.row_of()
    return w, ends[w.starts] + row, lang[row]


def _slots(h: np.ndarray, piece: np.ndarray, lang: np.ndarray, k: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each phrase of ``k`` words, by its first word, and whether it lies within one piece."""
    g = window_hashes(h, k)
    return (mix(g ^ lang[: len(g)]) & np.uint64(slots - 1)).astype(np.int64), piece[k - 1 :] == piece[: len(g)]


def _lang_hashes(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    names = np.array([int.from_bytes(str(x).encode()[:8].ljust(8, b"\0"), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    return mix(names)[coded.indices.to_numpy()] if len(column) else np.zeros(0, np.uint64)


def _counters(least: int, slots: int):
    """(length, page, data): counters of a partition's phrases, none above ``least``; empty pages are left out."""
    kind = np.min_scalar_type(least)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((COUNTED, slots), kind)
        waiting: list[list[np.ndarray]] = [[] for _ in range(COUNTED)]

        def count(k: int) -> None:
            if waiting[k]:
                slot = np.sort(np.concatenate(waiting[k]))
                at, end = runs(slot)
                table[k, slot[at]] = np.minimum(table[k, slot[at]] + (end - at), least).astype(kind)
                waiting[k].clear()

        held = 0
        for b, t in batches(it, "text"):
            w, piece, lang = _places(t, _lang_hashes(b.column(1)))
            h = word_hashes(t, w, lower=True)
            for k in range(COUNTED):
                slot, whole = _slots(h, piece, lang, k + 1, slots)
                waiting[k].append(slot[whole])
            held += len(h)
            if held >= TOGETHER:
                for k in range(COUNTED):
                    count(k)
                held = 0
        for k in range(COUNTED):
            count(k)
            pages = table[k].reshape(-1, min(PAGE, slots))
            for page in np.flatnonzero(pages.any(axis=1)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([page], pa.int32()), pa.array([pages[page].tobytes()])], names=["length", "page", "data"])

    return run


def _reached(least: int):
    """(length, page, bits): which counters of a page reach ``least``, summed over all partitions."""
    kind = np.min_scalar_type(least)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}  # at most one entry per page there is
        for b in it:
            for length, page, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = np.frombuffer(data.as_buffer(), kind).astype(np.int64)
                key = (length, page)
                sums[key] = np.minimum(sums[key] + own, least) if key in sums else own
        for (length, page), own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([page], pa.int32()), pa.array([np.packbits(own >= least).tobytes()])], names=["length", "page", "bits"])

    return run


def _window_sizes(h: np.ndarray, piece: np.ndarray, lang: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Words of the window that each place sends; 0 if its own word is surely rare."""
    n = len(h)
    size = np.zeros(n, np.int64)
    for k in range(1, LONGEST + 1):
        # a window of k words: within a piece, both windows of k - 1 words are there, and its hash is frequent
        m = max(0, n - k + 1)
        if k <= COUNTED:
            slot, whole = _slots(h, piece, lang, k, 8 * frequent.shape[1])
            whole &= (frequent[k - 1][slot >> 3] << (slot & 7).astype(np.uint8)) & 128 > 0
        else:
            whole = piece[k - 1 :] == piece[:m]
        size[np.flatnonzero(whole & (size[:m] == k - 1) & (size[min(1, k - 1) :][:m] >= k - 1))] = k
    return size


def _windows(shared):
    """(lang, phrase, k, n): the window of each place, one row a place; k = 0 is the number of words of a language."""

    def batch(langs: pa.Array, phrases: pa.Array, k: int, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([langs, phrases, pa.array(np.full(len(n), k, np.int32)), pa.array(n)], names=["lang", "phrase", "k", "n"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in batches(it, "text"):
            coded = b.column(1).dictionary_encode()
            langs, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            w, piece, hashed = _places(t, _lang_hashes(b.column(1)))
            size = _window_sizes(word_hashes(t, w, lower=True), piece, hashed, shared.value)
            lang = codes[w.row_of()]
            # every second stretch of the text is a word, the others lie between words
            edges = np.append(np.stack([w.starts, w.ends], axis=1).ravel(), len(t.data))
            stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(LOWER[t.data])])
            for k in range(1, LONGEST + 1):
                at = np.flatnonzero(size == k)
                for own in np.array_split(at, -(-len(at) // ROWS)) if len(at) else ():
                    parts = [stretches.take(pa.array(2 * (own + j))) for j in range(k)]
                    phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
                    yield batch(langs.take(pa.array(lang[own])), phrases, k, np.ones(len(own), np.int64))
            yield batch(langs, pa.array([""] * len(langs), pa.string()), 0, np.bincount(lang, minlength=len(langs)))

    return run


def windows_of_places(docs: DataFrame, least: int = 100, slots: int = SLOTS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, k, n): a window for each place whose word may occur ``least`` times, and with k = 0 numbers of all words."""
    spark = docs.sparkSession
    d = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    pages = d.mapInArrow(_counters(least, slots), "length int, page int, data binary").repartition("length", "page")
    bits = np.zeros((COUNTED, slots // 8), np.uint8)
    # one bit per slot, whatever the size of the corpus
    for r in pages.mapInArrow(_reached(least), "length int, page int, bits binary").collect():
        own = np.frombuffer(r["bits"], np.uint8)
        bits[r["length"], r["page"] * len(own) : (r["page"] + 1) * len(own)] = own
    return d.mapInArrow(_windows(spark.sparkContext.broadcast(bits)), "lang string, phrase string, k int, n long")


def phrase_counts(docs: DataFrame, least: int = 100, slots: int = SLOTS, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to ``LONGEST`` words that occur ``least`` times, and (lang, n) of all words."""
    sent = windows_of_places(docs, least, slots, text_col, lang_col)
    windows = stored(sent.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")), "windows")
    words_of = windows.filter("k = 0 and n > 0").select("lang", "n")
    flow = windows.filter(F.col("k") == LONGEST).select("lang", "phrase", F.col("n").alias("f"))
    levels = [flow.filter(F.col("f") >= least).withColumn("k", F.lit(LONGEST))]
    for k in range(LONGEST - 1, 0, -1):
        tails = windows.filter(F.col("k") == k).select("lang", "phrase", F.col("n").alias("f"))
        out = flow.select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "f")
        flow = stored(out.unionByName(tails).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "flow")
        levels.append(flow.filter(F.col("f") >= least).withColumn("k", F.lit(k)))
    grams = levels[0]
    for more in levels[1:]:
        grams = grams.unionByName(more)
    return stored(grams, "phrases"), words_of


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, slots: int = SLOTS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language the ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Texts are A-Z lowered, cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``; a null text
    has none, a null language is ``und``. ``a`` is the number of a phrase's occurrences, at least ``least``. Each cut in
    two parts with ``l`` and ``r`` occurrences gives ``floor(1000 a n / (l r))``, ``n`` being all words of the language; the
    lowest counts, of equal ones the leftmost cut. A phrase that stands in a longer one just as frequent is left
    out. Ties go to the larger ``a``, then the smaller phrase by bytes. Rows repeated in ``docs`` count each time; an
    empty table gives no rows.
    """
    grams, totals = phrase_counts(docs, least, slots, text_col, lang_col)
    longer = grams.filter("k >= 3")
    unary = longer.select("lang", F.expr("substring_index(phrase, ' ', k - 1)").alias("phrase"), "f").unionByName(
        longer.select("lang", F.expr("substring_index(phrase, ' ', 1 - k)").alias("phrase"), "f")
    )
    open_ = grams.filter("k >= 2").join(unary, ["lang", "phrase", "f"], "left_anti")
    cuts = open_.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring_index(phrase, ' ', cut - k)"))
    left = grams.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = grams.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    j = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    # l and r are at least a, so the score is at most 1000 n and fits 64 bits; the products are decimals of 38 digits
    score = F.expr("(cast(1000 as decimal(4)) * cast(f as decimal(15)) * cast(n as decimal(19))) div (cast(l as decimal(19)) * cast(r as decimal(19)))")
    best = j.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", F.col("f").alias("a"), "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
