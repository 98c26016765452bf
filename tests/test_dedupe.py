"""Duplicate rules against brute force on small fixtures, both ways: what goes, and what must stay."""

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fieldnote.functions import wordsets as ws
from fieldnote.operators import dedupe as dd
from fieldnote.operators import skew

COLUMNS = "record_id string, source string, author_key string, created_at string, text_clean string"


def words(text):
    return set(re.findall(r"[a-z0-9']+", text.lower()))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def order(r):
    return (r[3] or "9999", r[0])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 5
    texts, out = [], []
    for i in range(260):
        if texts and rng.random() < 0.6:
            b = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                j, roll = rng.randrange(len(b)), rng.random()
                if roll < 0.4:
                    b[j] = rng.choice(vocabulary)
                elif roll < 0.7 and len(b) > 3:
                    del b[j]
                else:
                    b.append(rng.choice(vocabulary) + str(rng.randrange(50)))
            t = " ".join(b)
        else:
            size = rng.choice([3, 5, 6, 7, 9, 12, 16, 22, 24, 28, 30, 40, 80, 150])
            t = " ".join(rng.choice(vocabulary) + rng.choice(["", "", "1", "2"]) for _ in range(size))
        texts.append(t)
        day = None if rng.random() < 0.3 else f"2024-01-{rng.randrange(1, 29):02d}"
        out.append((f"r{i:04d}", rng.choice(["s1", "s1", "s2"]), rng.choice(["a", "a", "b", None]), day, t))
    return out


def expected_near(rows):
    groups = defaultdict(list)
    for r in rows:
        if r[2]:
            groups[(r[1], r[2])].append(r)
    out = set()
    for g in groups.values():
        kept = []
        for r in sorted(g, key=order):
            t = words(r[4])
            winner = next((k for k, kt in kept if jaccard(t, kt) > 0.85), None)
            if winner is None:
                kept.append((r[0], t))
            else:
                out.add((r[0], winner))
    return out


def test_near_duplicates_equal_brute_force(spark, rows):
    got = {(r[0], r[1]) for r in dd.near_duplicates_same_author(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == expected_near(rows)


def test_near_duplicates_with_small_heads(spark, rows, monkeypatch):
    """With two heads per block the rounds must still end in the same answer."""
    monkeypatch.setattr(dd, "HEADS", 2)
    got = {(r[0], r[1]) for r in dd.near_duplicates_same_author(spark.createDataFrame(rows[:40], COLUMNS)).collect()}
    assert got == expected_near(rows[:40])


def test_similar_texts_equal_brute_force(spark, rows):
    by = defaultdict(list)
    for r in rows:
        by[(r[1], frozenset(words(r[4])))].append(r[0])
    want = set()
    for (sa, wa), (sb, wb) in combinations(by, 2):
        if sa == sb and jaccard(wa, wb) > 0.85:
            a, b = min(by[(sa, wa)]), min(by[(sb, wb)])
            want.add((min(a, b), max(a, b)))
    got = {(r.a, r.b) for r in dd.similar_texts(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == want


def test_echo_pairs_equal_brute_force(spark, rows):
    want = defaultdict(int)
    by = defaultdict(list)
    for r in rows:
        if r[2]:
            by[r[1]].append((r[2], words(r[4])))
    for s, items in by.items():
        want[s] = sum(1 for (a, x), (b, y) in combinations(items, 2) if a != b and jaccard(x, y) > 0.85)
    got = {r[0]: r[1] for r in dd.cross_author_echoes(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_consensus_is_kept_and_repeats_go(spark):
    same = "search cannot find old screenshots of my passport"
    rows = [(f"c{i}", "s", f"author{i}", None, same) for i in range(40)]
    rows += [(f"d{i}", "s", "one", f"2024-01-0{i + 1}", "I posted this very same thing again") for i in range(5)]
    df = spark.createDataFrame(rows, COLUMNS)
    lost = {r[0] for r in dd.exact_duplicates(df).collect()}
    assert lost == {"d1", "d2", "d3", "d4"}


def test_long_copies_cross_authors_and_authorless_short_ones_stay(spark):
    long = " ".join(f"word{i}" for i in range(30))
    rows = [("a", "s", "x", "2024-01-02", long), ("b", "t", "y", "2024-01-01", long), ("c", "s", None, None, "short one"), ("d", "s", None, None, "short one")]
    got = {(r[0], r[1]) for r in dd.exact_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {("a", "b")}


def test_hot_keys_are_salted_without_changing_the_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)], "id int, key string")
    per = rows.groupBy("key").count().withColumnRenamed("count", "n")
    got = skew.keyed_join(rows, per, ["key"], ["id"])
    want = rows.join(per, "key")
    assert sorted(map(tuple, got.select("key", "id", "n").collect())) == sorted(map(tuple, want.select("key", "id", "n").collect()))


def test_identical_near_copies_of_one_author_settle_in_one_round(spark):
    """A large group of near copies is compared with its first member, not pairwise."""
    base = " ".join(f"token{i}" for i in range(60))
    rows = [(f"n{i:03d}", "s", "bot", f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}", f"{base} unique{i}") for i in range(150)]
    got = {(r[0], r[1]) for r in dd.near_duplicates_same_author(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {(f"n{i:03d}", "n000") for i in range(1, 150)}


def zipf_sets(spark, n):
    """Sets of up to 60 words, drawn so that the word of rank r comes up with a chance in proportion to 1 / r."""
    u = lambda j: F.pmod(F.xxhash64(F.col("id"), j), F.lit(1 << 20)) / float(1 << 20)
    words = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda j: F.concat(F.lit("w"), F.floor(F.exp(u(j) * 9)).cast("string")))
    return spark.range(n).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("set_key"), F.array_sort(F.array_distinct(words)).alias("words"))


def test_blocks_of_common_words_do_not_grow(spark):
    """Blocks of texts that only share common words stay small however many texts there are."""
    most = []
    for n in (2_000, 8_000):
        blocks = dd.signature_blocks(zipf_sets(spark, n), ["source"], "set_key", 0.85)
        most.append(blocks.agg(F.max("n")).first()[0])
    assert most[1] <= dd.SPLIT and most[0] <= dd.SPLIT


def test_split_blocks_find_the_same_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(dd, "SPLIT", 6)
    test_similar_texts_equal_brute_force(spark, rows[:60])


def test_an_earlier_winner_is_found_after_a_text_has_lost(spark, monkeypatch):
    """With one head per block a text can lose to a later kept text before an earlier one is shown."""
    rng = random.Random(9)
    monkeypatch.setattr(dd, "HEADS", 1)
    base = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(12):
        own = [w for w in base if rng.random() > 0.06] + [f"x{rng.randrange(4)}" for _ in range(2)]
        rows.append((f"q{i:02d}", "s", "a", None, " ".join(own)))
    got = {(r[0], r[1]) for r in dd.near_duplicates_same_author(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == expected_near(rows)


def test_sketches_differ_in_no_more_bits_than_sets_in_words(spark, rows):
    """Pairs are told apart by sketches before their words move: no similar pair is lost, and most others are left out."""
    sets = [sorted(words(r[4])) for r in rows if len(words(r[4])) > 20][:40]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(sets)], "id long, words array<string>").select("id", dd.sketch(F.col("words")).alias("s"))
    lanes = {r.id: r.s for r in df.collect()}
    left_out = 0
    for a, b in combinations(range(len(sets)), 2):
        bits = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(lanes[a], lanes[b], strict=True))
        apart = len(set(sets[a]) ^ set(sets[b]))
        assert bits <= apart and (apart - bits) % 2 == 0
        left_out += bits >= 0.15 / 1.85 * (len(sets[a]) + len(sets[b]))
    assert left_out > 500


def test_similar_texts_do_not_multiply_in_the_blocks(spark, monkeypatch):
    """Near copies share most of their blocks. A block that holds them is not split: that gave a row for any two signatures."""
    monkeypatch.setattr(dd, "SPLIT", 64)
    base = " ".join(f"token{i}" for i in range(60))
    sets = spark.createDataFrame([("s", str(i), sorted([*base.split(), f"unique{i}"])) for i in range(150)], "source string, set_key string, words array<string>")
    rows = dd.signature_blocks(sets, ["source"], "set_key", 0.85).count()
    assert rows <= 150 * 61


def test_large_blocks_show_their_texts_in_turns(spark, rows, monkeypatch):
    """Blocks above ``SPLIT`` show ``SPLIT`` texts at a time; texts that were shown only lost ones ask again."""
    monkeypatch.setattr(dd, "SPLIT", 4)
    monkeypatch.setattr(dd, "HEADS", 1)
    base = " ".join(f"token{i}" for i in range(30))
    copies = [(f"n{i:03d}", "s1", "a", f"2024-02-01T00:00:{i:02d}", f"{base} one{i % 5} two{i % 3} three{i % 4}") for i in range(25)]
    some = rows[:30] + copies
    got = {(r[0], r[1]) for r in dd.near_duplicates_same_author(spark.createDataFrame(some, COLUMNS)).collect()}
    assert got == expected_near(some)


def test_words_read_in_batches_are_those_of_the_pattern():
    import pyarrow as pa

    texts = ["", None, "A b'c  D1-é İstanbul Kelvin ok", "x" * 300 + " " + "X" * 300 + " " + "x" * 299, "é", "end", "start a", "  ", "Straße'S\n\nß 9"]
    chunks = list(ws.text_words(pa.array(["skipped", *texts], pa.string()).slice(1)))
    hashes, sizes = [h for c in chunks for h in c[0].tolist()], [k for c in chunks for k in c[1].tolist()]
    want = [re.findall(r"[a-z0-9']+", (t or "").lower()) for t in texts]
    assert sizes == [len(w) for w in want]
    flat = [w for t in want for w in t]
    assert len(set(zip(flat, hashes, strict=True))) == len(set(flat)) == len(set(hashes))


def test_texts_are_read_once_by_the_whole_pass(spark, rows, monkeypatch):
    """Exact copies and near copies look at the same words; no text is read a second time."""
    plans = []
    monkeypatch.setattr(dd, "stored", lambda df, f=dd.stored: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    marks = dd.dedupe_marks(spark.createDataFrame(rows[:20], COLUMNS), spark.createDataFrame([], "record_id string, story_id string, source string, stage string, reason string, detail string, run_id string"), "r")
    plans.append(marks._jdf.queryExecution().optimizedPlan().toString())
    assert sum("read_words(" in p or "regexp_extract_all(" in p for p in plans) == 1


@pytest.mark.parametrize("job", ["near_duplicates_same_author", "cross_author_echoes"])
def test_texts_are_read_once(spark, rows, monkeypatch, job):
    plans = []
    monkeypatch.setattr(dd, "stored", lambda df, f=dd.stored: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    out = getattr(dd, job)(spark.createDataFrame(rows[:12], COLUMNS))
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert sum("read_words(" in p or "regexp_extract_all(" in p for p in plans) == 1
