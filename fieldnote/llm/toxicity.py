"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are runs of letters and digits, A-Z lowered. The vocabulary is chosen by the chi-square of term and label over
a bounded sample of labelled rows, each family of near copies counted once, however many pass; document frequencies
come from the whole corpus. Every text then has a sparse vector over these terms, ``(1 + ln tf) * idf`` at unit length.

Examples with equal vectors are one entry with its counts. Entries lie in blocks, ordered by their heaviest terms, so
that entries of a block resemble each other; per term the index keeps postings by block and the largest weight of each
block. A query adds up the block maxima of its terms, opens blocks in falling order of that bound, in growing waves, and
stops when the similarity of the ``k``-th nearest example is above the next bound, so the neighbours are exact; all
examples as similar as the ``k``-th count. Their votes, weighted by similarity, are calibrated on the examples themselves,
each scored without itself. Texts with the vector of an earlier text of the worker take its result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.llm.store import stored
from fieldnote.llm.wordhash import Texts, batches, runs, window_hashes, word_hashes, words

MAX_EXAMPLES = 20_000
"""Labelled rows that are used at most, half of each label where there are as many; spread by a hash of the id."""
MIN_FAMILIES = 5
MIN_CHI2 = 30.0
"""About a one in 20 million chance per term, so that none is picked by chance among millions of terms."""
BLOCK = 64
FIRST_WAVE = 8
"""Blocks opened at once at first; each further wave opens twice as many."""
NEIGHBOURS = 25
PRIOR_WEIGHT = 0.5
SHOWN = 3
"""Examples that a score names as its evidence."""
REMEMBERED = 100_000
"""Vectors whose result a Python worker keeps."""
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_rows(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every term of some texts, in order."""
    w = words(t, LETTER)
    return w.row_of(), word_hashes(t, w, lower=True)


@dataclass
class Index:
    """Vectors of the examples over ``terms`` (sorted hashes), by term and block. Equal vectors are one entry."""

    terms: np.ndarray
    idf: np.ndarray
    shown: list = field(default_factory=list)
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    entries: list = field(default_factory=list)
    starts: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    entry: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    most: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    prior: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def vectors(self, t: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, term numbers, weights) of the texts that hold a term."""
        row, h = term_rows(t)
        if not len(self.terms) or not len(h):
            return
        place = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[place] == h
        key = np.sort(row[hit] * len(self.terms) + place[hit])
        at, to = runs(key)
        row, term = np.divmod(key[at], len(self.terms))
        value = (1 + np.log(to - at)) * self.idf[term]
        for a, e in zip(*runs(row), strict=True):
            v = value[a:e]
            yield int(row[a]), term[a:e], v / np.sqrt((v * v).sum())

    def fill(self, ids: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``shown`` of an entry are its first examples, toxic ones before others; ids ascend."""
        equal: dict[bytes, list[int]] = {}
        for i, (t, w) in enumerate(vectors):
            equal.setdefault(t.tobytes() + np.round(w, 12).tobytes(), []).append(i)
        # heaviest terms first: neighbours in this order share them
        heavy = lambda own: tuple(vectors[own[0]][0][np.argsort(-vectors[own[0]][1], kind="stable")].tolist())
        groups = sorted(equal.values(), key=heavy)
        self.entries = [vectors[own[0]] for own in groups]
        self.n = np.array([len(own) for own in groups], float)
        self.toxic = np.array([labels[own].sum() for own in groups], float)
        self.shown = [[(ids[i], int(labels[i])) for i in sorted(own, key=lambda i: (-labels[i], i))[:SHOWN]] for own in groups]
        blocks = -(-len(groups) // BLOCK)
        entry = np.repeat(np.arange(len(groups)), [len(t) for t, _ in self.entries])
        term = np.concatenate([t for t, _ in self.entries]) if groups else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in self.entries]) if groups else np.zeros(0)
        order = np.lexsort((entry, term))
        self.entry, self.weight = entry[order], weight[order]
        cell = term[order] * blocks + self.entry // BLOCK
        self.starts = np.searchsorted(cell, np.arange(len(self.terms) * blocks + 1))
        most = np.zeros(len(self.terms) * blocks)
        np.maximum.at(most, cell, self.weight)
        self.most = most.reshape(len(self.terms), blocks)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Entries and similarities (above 0) that hold the ``k`` most similar examples and all as similar as the last.

        One example of the entry ``without`` is left out of account.
        """
        bounds = weight @ self.most[term]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        blocks, at, wave = self.most.shape[1], 0, FIRST_WAVE
        found, scores, worst = np.zeros(0, np.int64), np.zeros(0), 0.0
        while at < len(order) and bounds[order[at]] >= worst - 1e-12:
            some = order[at : at + wave]
            some = some[bounds[some] >= worst - 1e-12]
            at, wave = at + wave, wave * 2
            # all postings of the query's terms in the opened blocks
            cell = term[:, None] * blocks + some[None]
            s, n = self.starts[cell].ravel(), (self.starts[cell + 1] - self.starts[cell]).ravel()
            posting = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
            slot = np.repeat(np.tile(np.arange(len(some)), len(term)), n) * BLOCK + self.entry[posting] % BLOCK
            own = np.bincount(slot, weights=np.repeat(np.repeat(weight, len(some)), n) * self.weight[posting], minlength=len(some) * BLOCK)
            hit = np.flatnonzero(own > 0)
            entry = some[hit // BLOCK] * BLOCK + hit % BLOCK
            held = self.n[entry] - (entry == without) > 0
            found, scores = np.concatenate([found, entry[held]]), np.concatenate([scores, own[hit][held]])
            best = np.lexsort((found, -np.round(scores, 12)))
            found, scores = found[best], scores[best]
            sums = np.cumsum(self.n[found] - (found == without))
            if len(sums) and sums[-1] >= k:
                worst = scores[np.searchsorted(sums, k)]
                near = scores >= worst - 1e-12
                found, scores = found[near], scores[near]
        return found, scores

    def vote(self, found: np.ndarray, scores: np.ndarray, without: int = -1, label: int = 0) -> float:
        gone = found == without
        n, toxic = self.n[found] - gone, self.toxic[found] - gone * label
        return float(((scores * toxic).sum() + PRIOR_WEIGHT * self.prior) / ((scores * n).sum() + PRIOR_WEIGHT))

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * vote + self.offset)))


def _fit(vote: np.ndarray, label: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, with Platt's smoothed targets and a little shrinkage."""
    n1, n0 = (count * label).sum(), (count * (1 - label)).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([vote, np.ones(len(vote))], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (count * (p - target)) + 0.01 * b
        h = (x * (count * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return max(0.0, float(b[0])), float(b[1])


def _families(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, term, label) for the distinct terms of each example; near copies tend to share the family."""
    for b, t in batches(it, "text"):
        row, h = term_rows(t)
        label = b.column(1).to_numpy()
        ends = np.searchsorted(row, np.arange(len(t) + 1))
        out = []
        for r in range(len(t)):
            own = h[ends[r] : ends[r + 1]]
            if not len(own):
                continue
            grams = window_hashes(own, 5) if len(own) >= 5 else own
            terms = np.unique(own)
            out.append((np.full(len(terms), grams.min()), terms, np.full(len(terms), label[r])))
        if out:
            f, terms, y = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(terms.view(np.int64)), pa.array(y.astype(np.int32))], names=["family", "term", "label"])


def _frequencies(terms: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for _, t in batches(it, "text"):
            row, h = term_rows(t)
            place = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            hit = terms[place] == h
            key = np.sort(row[hit] * len(terms) + place[hit])
            at, _ = runs(key)
            total += np.bincount(key[at] % len(terms), minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(total)], names=["term", "n"])

    return run


def fitted_index(docs: DataFrame, labels: DataFrame) -> Index:
    """The index and calibration from ``docs`` (id, text) and ``labels`` (id, label 0/1, both not null, ids once)."""
    per = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, MAX_EXAMPLES / 2 / n) for y, n in per.items()}
    rate = F.coalesce(*[F.when(F.col("label") == y, s) for y, s in share.items()]) if share else F.lit(0.0)
    chosen = labels.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * float(1 << 30))
    # at most about MAX_EXAMPLES rows of an id and a label
    sample = stored(docs.join(F.broadcast(chosen), "id").select("text", F.col("label").cast("int").alias("label"), "id"), "examples")
    by_family = sample.select("text", "label").mapInArrow(_families, "family long, term long, label int")
    by_term = by_family.groupBy("term", "family").agg(F.max("label").alias("label")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).filter(F.col("n") >= MIN_FAMILIES)
    total, toxic = sample.select(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    n, k = F.col("n").cast("double"), F.col("toxic").cast("double")
    off = F.lit(float(max(total, 1))) * k - F.lit(float(toxic)) * n
    chi2 = F.lit(float(max(total, 1))) * off * off / F.greatest(n * (total - n) * F.lit(float(toxic)) * F.lit(float(total - toxic)), F.lit(1.0))
    best = by_term.withColumn("chi2", chi2).filter(F.col("chi2") >= MIN_CHI2).select("term").collect()
    terms = np.sort(np.array([r["term"] for r in best], np.int64).view(np.uint64))
    index = Index(terms, np.ones(len(terms)))
    index.prior = sum(per.get(y, 0) for y in per if y) / max(1, sum(per.values()))
    if not len(terms):
        index.slope, index.offset = 0.0, float(np.log((index.prior + 1e-6) / (1 - index.prior + 1e-6)))
        return index
    rows = docs.select("text").mapInArrow(_frequencies(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r["term"]: r["n"] for r in rows}
    everything = docs.count()
    index.idf = np.array([np.log((everything + 1) / (df.get(int(t), 0) + 1)) + 1 for t in terms.view(np.int64)])
    ids, y, vectors = [], [], []
    for r in sample.select("id", "label", "text").mapInArrow(_example_vectors(index), "id long, label int, terms array<int>, weights array<double>").orderBy("id").collect():
        ids.append(r["id"])
        y.append(r["label"])
        vectors.append((np.array(r["terms"], np.int64), np.array(r["weights"])))
    index.fill(ids, np.array(y, float), vectors)
    votes, labels_of, counts = [], [], []
    for i, (t, w) in enumerate(index.entries):
        found, scores = index.nearest(t, w, NEIGHBOURS, without=i)
        for y, n in ((0, index.n[i] - index.toxic[i]), (1, index.toxic[i])):
            if n:
                votes.append(index.vote(found, scores, i, y))
                labels_of.append(y)
                counts.append(n)
    # examples without any term are the rest of the sample
    none = index.vote(np.zeros(0, np.int64), np.zeros(0))
    vote = np.array([*votes, none, none])
    label = np.array([*labels_of, 0, 1], float)
    empty = [total - toxic - (index.n - index.toxic).sum(), toxic - index.toxic.sum()]
    count = np.array([*counts, *empty], float) / np.where(label > 0, share.get(1, 1.0), share.get(0, 1.0))
    index.slope, index.offset = _fit(vote, label, count)
    return index


def _example_vectors(index: Index):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in batches(it, "text"):
            found = list(index.vectors(t))
            row = pa.array([r for r, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), pa.array([x.astype(np.int32) for _, x, _ in found], pa.list_(pa.int32())), pa.array([w for _, _, w in found], pa.list_(pa.float64()))],
                names=["id", "label", "terms", "weights"],
            )

    return run


def _result(index: Index, term: np.ndarray, weight: np.ndarray) -> tuple[float, list[dict]]:
    found, scores = index.nearest(term, weight, NEIGHBOURS)
    shown = [{"id": i, "similarity": float(s), "label": y} for e, s in zip(found[:SHOWN].tolist(), scores, strict=False) for i, y in index.shown[e]]
    return index.vote(found, scores), shown[:SHOWN]


def _scores(shared, carried: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        none = index.vote(np.zeros(0, np.int64), np.zeros(0))
        seen: dict[bytes, tuple[float, list[dict]]] = {}
        for b, t in batches(it, "text"):
            vote, evidence = np.full(len(t), none), [[] for _ in range(len(t))]
            for r, term, weight in index.vectors(t):
                key = term.tobytes() + weight.tobytes()
                if key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[key] = _result(index, term, weight)
                vote[r], evidence[r] = seen[key]
            kind = pa.list_(pa.struct([("id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
            more = [f"c{i}" for i in range(carried)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(index.calibrated(vote)), pa.array(evidence, kind), *b.columns[2:]], names=["id", "score", "evidence", *more])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: float = 0.7, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``, ``evidence`` (the three nearest examples), columns ``carry``.

    Ids are whole numbers. Labels are learned only from ids whose crc32 (of the id as text) modulo 3 is not 1; the
    largest label of an id counts, null ids and labels do not. Texts without a term of the vocabulary, null and
    empty ones too, get the score of no neighbours. Without any label every score is near 0.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null").filter(~held)
    index = fitted_index(d, stored(known.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label")), "labelled"))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    more = "".join(f", c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))
    out = rows.mapInArrow(_scores(shared, len(carry)), f"id long, score double, evidence array<struct<id: long, similarity: double, label: int>>{more}")
    own = [F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"), "evidence"]
    return out.select(*own, *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
