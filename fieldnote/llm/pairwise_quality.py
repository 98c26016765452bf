"""Quality by Bradley-Terry pairwise ranking: a good text should beat a bad one.

A text has a few features of its whole text (shares of character classes, words, repetition). Preference pairs are
drawn from the labelled rows: both labels are dealt to hashed slots, and a good and a bad row that meet in a slot are a
pair, so that each row of the rarer label meets ``ROUNDS`` others on average, whatever the size. The probability that
the good one wins is the logistic function of the difference of their latent scores, linear in the features; weights
are those of least logistic loss on the feature differences. All labelled rows take part and the fit is a Spark job
over the stored pairs. The limit between bad and good is a quantile of the latent scores of the labelled rows: of a
fixed number of quantiles the one with the fewest wrong verdicts. The score is the chance to win against a
text at that limit, moved so that the limit is ``limit``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote.llm.store import stored
from fieldnote.llm.wordhash import Texts, batches, runs, window_hashes, word_hashes, words

ROUNDS = 8
QUANTILES = 1000
PENALTY = 1e-4

CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".", ",", "!", "?;:", "'\"()-", "|", "#*$%&", "<>", "_/\\@=+~^[]{}`"]
OTHER = len(CLASSES)
KIND = np.full(256, OTHER + 1)
KIND[:128] = OTHER
for _i, _chars in enumerate(CLASSES):
    KIND[[ord(c) for c in _chars]] = _i
N_KINDS = OTHER + 2
FEATURES = [f"kind_{i}" for i in range(N_KINDS)] + ["length", "word_length", "upper_words", "same_as_last", "distinct_words", "repeated_threes"]


def _per_text(hit: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row[hit], minlength=n)


def features_of(t: Texts) -> np.ndarray:
    """One row of features per text. Shares stand under a square root, so that a little of something counts."""
    n = len(t)
    kind = KIND[t.data]
    byte_row = np.repeat(np.arange(n), np.diff(t.offsets))
    kinds = np.bincount(byte_row * N_KINDS + kind, minlength=n * N_KINDS).reshape(n, N_KINDS)
    out = np.zeros((n, len(FEATURES)))
    out[:, :N_KINDS] = np.sqrt(kinds / np.maximum(1, np.diff(t.offsets))[:, None])
    w = words(t)
    row, count = w.row_of(), w.counts()
    h = word_hashes(t, w)
    each = np.maximum(1, count)
    upper = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(kind == 1, out=upper[1:])
    capitals = (upper[w.ends] - upper[w.starts] >= 2) if len(h) else np.zeros(0, bool)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    out[:, N_KINDS] = np.log1p(count)
    out[:, N_KINDS + 1] = np.log1p(np.bincount(row, weights=w.ends - w.starts, minlength=n) / each)
    out[:, N_KINDS + 2] = np.sqrt(_per_text(capitals, row, n) / each)
    out[:, N_KINDS + 3] = np.sqrt(_per_text(again, row, n) / each)
    out[:, N_KINDS + 4] = np.bincount(row[order], weights=fresh, minlength=n) / each
    g = window_hashes(h, 3)
    inside = np.flatnonzero(row[: len(g)] == row[2:]) if len(g) else np.zeros(0, np.int64)
    by = np.lexsort((g[inside], row[inside]))
    at, end = runs(g[inside][by])  # a window of the next text has another hash but for a rare meeting
    often = np.repeat(end - at > 1, end - at)
    out[:, N_KINDS + 5] = np.sqrt(_per_text(often, row[inside][by], n) / each)
    return out


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, t in batches(it, "text"):
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in features_of(t).T]], names=["id", *FEATURES])


def latent(weights: np.ndarray) -> Column:
    """The linear score of a row with columns ``FEATURES``."""
    total = F.lit(0.0)
    for name, w in zip(FEATURES, weights, strict=True):
        total = total + F.col(name) * F.lit(float(w))
    return total


def pairs(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(delta, label) from ``rows`` (id, label 0/1, features; an id once): differences of a good and a bad row.

    Every other pair is turned round, with label 0, as a fit needs both labels.
    """
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    slots = max(n.get(0, 0), n.get(1, 0), 1)
    dealt = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("slot", F.pmod(F.xxhash64("id", "round"), F.lit(slots)))
    good = dealt.filter("label = 1").select("round", "slot", F.col("id").alias("good"), F.array(*FEATURES).alias("x"))
    bad = dealt.filter("label = 0").select("round", "slot", F.col("id").alias("bad"), F.array(*FEATURES).alias("y"))
    sign = F.when(F.pmod(F.xxhash64("good", "bad", "round"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    met = good.join(bad, ["round", "slot"]).withColumn("sign", sign)
    return met.select(F.zip_with("x", "y", lambda a, b: (a - b) * F.col("sign")).alias("delta"), (F.col("sign") > 0).cast("double").alias("label"))


def fitted(rows: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights, and the quantile of latent scores with the fewest wrong verdicts, from ``rows`` (id, label, features)."""
    table = stored(pairs(rows, rounds).select(array_to_vector("delta").alias("features"), "label"), "pairs")
    if table.select("label").distinct().count() < 2:
        # too few labels for pairs of both signs: nothing is learned, and all rows are good
        return np.zeros(len(FEATURES)), -float("inf")
    model = LogisticRegression(fitIntercept=False, regParam=PENALTY, maxIter=100, tol=1e-8).fit(table)
    weights = model.coefficients.toArray()
    scored = rows.select("label", latent(weights).alias("s"))
    cuts = scored.select(F.percentile_approx("s", [i / QUANTILES for i in range(QUANTILES + 1)], 100 * QUANTILES).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("s")))
    counts = scored.groupBy(place.alias("place"), "label").agg(F.count("*").alias("n")).collect()
    good, bad = np.zeros(len(cuts) + 1), np.zeros(len(cuts) + 1)
    for r in counts:
        (good if r["label"] else bad)[r["place"]] += r["n"]
    # rows of place p and less lie below cut p: wrong are the good ones below a cut, and the bad ones from it on
    wrong = np.cumsum(good)[:-1] + bad.sum() - np.cumsum(bad)[:-1]
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[len(best) // 2])
    return weights, (cuts[i] + cuts[max(0, i - 1)]) / 2


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` in 0..1, ``predicted`` (1 from ``limit`` on), ``latent``.

    Labels are learned only from ids whose crc32 (of the id as text) modulo 5 is not 0; the smallest label of an id
    counts, null ids and labels do not, and of rows with one id one is learned from. Null and empty texts have the
    features of no text and a score like others. Without labels of both kinds every score is 1.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    table = stored(d.mapInArrow(_features, f"id {kind}, " + ", ".join(f"{c} double" for c in FEATURES)), "features")
    known = labels.select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null").filter(~held)
    known = known.groupBy("id").agg((F.min("label") > 0).cast("int").alias("label"))
    one = table.join(known, "id").groupBy("id", "label").agg(F.min(F.struct(*FEATURES)).alias("x")).select("id", "label", "x.*")
    weights, cut = fitted(stored(one, "labelled"))
    s = latent(weights)
    score = 1 / (1 + F.exp(-(s - F.lit(cut)) - F.lit(float(np.log(limit / (1 - limit))))))
    return table.select(F.col("id").alias(id_col), held.alias("held_out"), score.alias("score"), (s >= F.lit(cut)).cast("int").alias("predicted"), s.alias("latent"))
