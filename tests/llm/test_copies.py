"""Near copies, repeated passages and components against brute force and on odd rows."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from fieldnote.llm.components import components
from fieldnote.llm.jaccard_join import near_copies, parity_sketch, window_size
from fieldnote.llm.substring_dedup import without_repeats

from .helpers import LONG, PASSAGE, brute_components, brute_repeats, none, odd


def test_near_copies_equal_brute_force_on_a_loose_family(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            w[at] = f"x{rng.integers(5)}" if rng.random() < 0.5 else f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"{i}y{j}" for j in range(30))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((5, 80), (4, 85), (3, 60)):
        got = {r["doc_id"]: r["component_id"] for r in near_copies(df, k=k, percent=percent).collect()}
        assert got == brute_components(rows, k, percent)


def test_near_copies_of_odd_rows(spark):
    got = near_copies(odd(spark), k=4, percent=85).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[1] == [(4, 1)] and by[2] == [(4, 1), (4, 1)]
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[5] == [(0, 5)]
    assert sorted(by[None], key=str) == [(0, None), (4, 1)]
    assert near_copies(none(spark)).count() == 0


def test_window_and_sketch_bounds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(100, 300)], rng.integers(0, 2**63, 40, dtype=np.uint64)]))
        apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in (parity_sketch(a) ^ parity_sketch(b)))
        assert apart <= len(np.setxor1d(a, b))
    assert window_size(100, 85) == 16 and window_size(1, 85) == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(500, 540)] + [(3, 3), (None, 4)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(500, 540)} == {7} and 3 not in got and 4 not in got


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    common = [[f"p{k}_{i}" for i in range(rng.integers(50, 130))] for k in range(4)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.integers(0, 5)):
            w += [f"d{d}_{rng.integers(10**6)}" for _ in range(rng.integers(0, 60))]
            p = common[rng.integers(4)]
            a = rng.integers(0, 20)
            w += p[a : len(p) - rng.integers(0, 20)]
            if rng.random() < 0.3:
                w += p
        rows.append((d, "  ".join(w)))
    rows.append((100, " ".join(["same"] * 300)))
    rows.append((101, " ".join(["same"] * 120)))
    want = brute_repeats(rows)
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        kept = want[r["doc_id"]]
        assert r["n_words"] - r["n_removed"] == len(kept)
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert (r["kept"] is None) == (r["n_removed"] == 0) and (r["kept"] is None or r["kept"] == " ".join(kept))


def test_repeats_of_odd_rows(spark):
    got = without_repeats(odd(spark).withColumn("text", F.when(F.col("doc_id") == 1, F.lit(LONG)).otherwise(F.col("text")))).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert by[6] == [(30000, 30000)] and by[1] == [(30000, 0)]
    assert by[7] == [(64, 0)] and by[8][0][1] == len(PASSAGE.split())
    assert by[3] == [(0, 0)] and by[2] == [(7, 0), (7, 0)] and len(by[None]) == 2
    assert without_repeats(none(spark)).count() == 0
