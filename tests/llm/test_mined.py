"""Periodic runs, quality by pairs, collocations."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldnote.llm.collocations import collocations, windows_of_places
from fieldnote.llm.pairwise_quality import FEATURES, pairs, quality_scores
from fieldnote.llm.periodic_runs import digest, periodic_runs, runs_of
from tests.conftest import SF

from .helpers import documents, none, odd


def brute_runs(w, least=24, times=3):
    out = {}
    for d in range(1, len(w) // times + 1):
        j = 0
        while j < len(w) - d:
            start = j
            while j < len(w) - d and w[j] == w[j + d]:
                j += 1
            if j > start and j - start + d >= max(least, times * d):
                out.setdefault((start, j - start + d), d)
            j += 1
    return sorted(((s, n, d) for (s, n), d in out.items()), key=lambda x: (x[0], x[2]))


PIECE = st.one_of(
    st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=25), st.integers(1, 6), st.integers(0, 24)).map(lambda x: (x[0] * (x[1] + 1))[: len(x[0]) * x[1] + x[2]]),
    st.lists(st.integers(0, 4), max_size=20),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=6).map(lambda x: sum(x, [])), min_size=1, max_size=4))
def test_runs_equal_brute_force(texts):
    rows = np.cumsum([0, *map(len, texts)])
    assert runs_of(np.array(sum(texts, []), np.int64), rows, 24, 3) == [brute_runs(w) for w in texts]


def test_runs_of_many_lengths():
    rng = random.Random(5)
    for q in [1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64, 65, 100, 257, 1000]:
        block = [rng.randrange(10**6) for _ in range(q)]
        n = max(24, 3 * q) + rng.randrange(q)
        w = [-1] * 11 + (block * 30)[:n] + [-2] * 5
        assert runs_of(np.array(w), np.array([0, len(w)]), 24, 3) == [[(11, n, q)]]
        short = [-1] * 11 + (block * 30)[: max(24, 3 * q) - 1] + [-2] * 5
        assert runs_of(np.array(short), np.array([0, len(short)]), 24, 3) == [[]]


def test_run_rows(spark):
    rep = "a b c " * 20
    rows = [(1, f"x {rep}y", 0), (1, f"x {rep}y", 0), (2, None, 0), (3, " \n", 0), (None, "p " * 24 + "q", 1), (4, "long" + " w" * 300_000, 1), (5, "a " * 23, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long")
    got = sorted(digest(periodic_runs(df)).collect(), key=str)
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got}
    assert tuple(by[1])[:6] == (1, 1, 1, 60, 3, 20000) and by[1]["runs_sha256"] == hashlib.sha256(b"1,60,3\n").hexdigest()
    assert by[1]["collapsed_sha256"] == hashlib.sha256(b"x a b c y").hexdigest()
    assert tuple(by[None])[1:6] == (1, 0, 24, 1, 24000) and by[None]["collapsed_sha256"] == hashlib.sha256(b"p q").hexdigest()
    assert tuple(by[4])[1:6] == (1, 1, 300_000, 1, 300_000_000)
    for i in (2, 3):
        assert tuple(by[i])[1:6] == (0, None, None, None, None) and by[i]["runs_sha256"] == by[i]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[5]["n_runs"] == 0
    # of equal exponents the first; a text keeps the first period of each of its runs
    two = spark.createDataFrame([(1, "a b " * 12 + "z " + "c d " * 12)], "doc_id long, text string")
    found = periodic_runs(two).first()
    assert found["collapsed"] == "a b z c d" and digest(periodic_runs(two)).first()["start"] == 0
    assert len(periodic_runs(odd(spark)).collect()) == 12 and periodic_runs(none(spark)).count() == 0


def brute_collocations(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) for rows (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(f[lang, q] >= a for (other, q), b in f.items() if other == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


def test_collocations_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "The", "new", "york", "stock", "é", "and,", "x.", "漢字", "#", "\x0c"]
    texts = [" ".join(rng.choices(vocab, [9, 8, 3, 4, 4, 2, 1, 2, 2, 1, 1, 1])[0] for _ in range(rng.randrange(60))) for _ in range(120)]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), x) for x in texts] + [("en", None), ("fr", ""), ("en", "new york stock\texchange now " * 30), ("xx", "a b c d e f g " * 9)]
    df = spark.createDataFrame([(lang, x, 1) for lang, x in rows], "lang string, text string, phrase int").repartition(5)
    for least, top in ((4, 2000), (9, 5)):
        got = sorted(tuple(r) for r in collocations(df, least, top).collect())
        assert got == brute_collocations(rows, least, top) and len(got) > 8
    # tables of counters too small to tell phrases apart change the work, not the result
    assert sorted(tuple(r) for r in collocations(df, 4, 2000, slots=64).collect()) == brute_collocations(rows, 4, 2000)


def test_windows_sent_follow_the_text(spark):
    # at five times the text pairs of words become frequent, and what goes to Spark still grows as the words do
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(500)) for _ in range(250)]
    sent = {}
    for n in (50, 250):
        df = spark.createDataFrame([("en", x) for x in texts[:n]], "lang string, text string").repartition(4)
        windows = windows_of_places(df, 30)
        sent[n] = windows.filter("k > 0").count()
        assert [r["n"] for r in windows.filter("k = 0").groupBy().agg(F.sum("n").alias("n")).collect()] == [500 * n]
        # few windows differ while no pair is frequent
        assert (windows.filter("k > 1").count() > 0) == (n == 250)
    assert sent[250] <= 5 * sent[50] and sent[250] == 250 * 500


def test_windows_are_words_joined_by_one_space(spark):
    df = spark.createDataFrame([("en", "\t A \t b  c, A b\tc É 漢字 . É 漢字 A\n"), ("en", None), ("en", " .\t"), (None, "x")], "lang string, text string").coalesce(1)
    got = Counter()
    for r in windows_of_places(df, 2).collect():
        got[r["lang"], r["phrase"], r["k"]] += r["n"]
    assert got == {("en", "", 0): 11, ("und", "", 0): 1, ("en", "a b c", 3): 2, ("en", "b c", 2): 2, ("en", "c", 1): 2, ("en", "É 漢字", 2): 2, ("en", "漢字", 1): 2, ("en", "a", 1): 1}


def test_collocations_of_odd_rows(spark):
    rows = [(r["lang"], r["text"]) for r in odd(spark).collect()]
    assert sorted(tuple(r) for r in collocations(odd(spark), 3).collect()) == brute_collocations(rows, 3, 2000)
    assert collocations(none(spark)).count() == 0
    big = spark.createDataFrame([(1 << 40, "a b", "en")], "n long, text string, lang string")
    assert [tuple(r) for r in collocations(big.union(big), 2).collect()] == [("en", 1, "a b", 2, 2, 2, 4, 2000)]


def test_quality_scores_of_held_out_rows(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and (r["score"] >= 0.3) == bool(r["predicted"]) for r in rows.values())
    known = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(r["predicted"] == y for r, y in known) >= 0.95 * len(known)
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality_scores(docs, flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in rows.items())


def test_preference_pairs(spark):
    rows = spark.range(300).select("id", (F.col("id") % 5 > 0).cast("int").alias("label"), *[F.when(F.col("id") % 5 > 0, 1.0).otherwise(0.0).alias(c) for c in FEATURES])
    got = pairs(rows).collect()
    # each of the 60 rows of the rarer label meets eight others on average
    assert 240 < len(got) < 720 and 0 < sum(r["label"] for r in got) < len(got)
    assert all(r["delta"] == [1.0 if r["label"] else -1.0] * len(FEATURES) for r in got)


def test_quality_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, "a"), (1, 0, "a"), (2, 1, "a"), (None, 1, "a"), (3, None, "a"), (6, 1, "b"), (7, 0, "b"), (8, 0, "b"), (99, 1, "b")], "doc_id long, quality int, text string")
    assert len(quality_scores(odd(spark), labels).collect()) == 12
    assert {r["score"] for r in quality_scores(odd(spark), labels.limit(0)).collect()} == {1.0}
    assert quality_scores(none(spark), labels).count() == 0


def test_features_take_whole_texts(spark):
    a, b = "good words only here " * 5000, "good words only here " * 5000 + "| # ! " * 400
    first, second = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5][:2]
    df = spark.createDataFrame([(first, a), (second, b)], "doc_id long, text string")
    labels = spark.createDataFrame([(first, 1), (second, 0)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality_scores(df, labels).collect()}
    assert scores[first] > scores[second]
