"""Formatting, mixing, quality rules."""

import hashlib
import math

from pyspark.sql import functions as F

from fieldnote.llm.chat_format import digest, formatted
from fieldnote.llm.mix_sources import mixed
from fieldnote.llm.quality import js_distance, quality

from .helpers import WORD, documents, none, odd

CHAT = "conv_id long, turn long, role string, text string, formatted string, loss int, i int"


def test_chat_round_trip(spark):
    rows = [
        (1, 2, "assistant", r"a \s <part> </turn>" + "\n<turn user> \\", "", 0, 0),
        (1, 0, "user", "hi", "", 0, 0),
        (1, 1, "user", "<", "", 0, 0),
        (1, 3, "assistant", "é\U0001f600", "", 0, 0),
        (1, 3, "assistant", "é\U0001f600", "", 0, 0),
        (2, None, None, None, "", 0, 0),
        (None, 1, "r>o\\l", "x", "", 0, 0),
    ]
    want = {
        1: [("user", "hi"), ("user", "<"), ("assistant", rows[0][3]), ("assistant", "é\U0001f600"), ("assistant", "é\U0001f600")],
        2: [("", "")],
        None: [("r>o\\l", "x")],
    }
    chats = formatted(spark.createDataFrame(rows, CHAT))
    assert {r["conv_id"]: r["formatted"].count("</turn>") for r in chats.collect()} == {1: 2, 2: 1, None: 1}
    for r in digest(chats).collect():
        turns = want[r["conv_id"]]
        loss = "".join(t for k, t in turns if k == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{k}\n{t}\n" for k, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert formatted(spark.createDataFrame([], CHAT)).count() == 0


def brute_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix_meets_its_targets(spark):
    docs = documents(spark)
    text = {r["doc_id"]: r for r in docs.collect()}
    rows = mixed(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mixed(docs.repartition(3)).collect()}
    assert len(rows) == len(text) and again == {r["doc_id"]: r["taken"] for r in rows}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = text[r["doc_id"]]["source"]
        assert r["size"] == len(WORD.findall(text[r["doc_id"]]["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2.0)
    for s, t in want.items():
        assert math.isclose(target[s], t, rel_tol=1e-9)
        assert abs(taken[s] - t) <= max(r["size"] for r in rows if text[r["doc_id"]]["source"] == s)


def test_mix_keeps_chances(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 100, "big").otherwise("s").alias("source"))
    rows = [r for seed in range(6) for r in mixed(docs, seed=seed).collect() if r["doc_id"] >= 100]
    due = rows[0]["target"] / rows[0]["source_size"]
    early = [r["copies"] for r in rows if r["doc_id"] < 250]
    assert abs(sum(early) / len(early) - due) < 0.1


def test_mix_of_odd_rows(spark):
    rows = mixed(odd(spark)).collect()
    assert len(rows) == 12 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[6] == 30000
    assert mixed(none(spark)).count() == 0


def brute_counts(text):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark):
    docs = documents(spark)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = brute_counts(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_quality_verdicts_follow_the_labels(spark):
    from tests.conftest import SF

    j = quality(documents(spark)).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in j if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in j if r["quality"] == 0]
    assert sum(good) == len(good) and sum(bad) < 0.6 * len(bad)


def test_quality_of_odd_rows(spark):
    rows = quality(odd(spark)).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[4]["kept"] and by[6]["n_words"] == 30000
    assert quality(none(spark)).count() == 0


def test_js_distance(spark):
    one = spark.range(1).select(
        js_distance(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(5.0))).alias("far"),
        js_distance(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(6.0))).alias("same"),
        js_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("none"),
    )
    r = one.first()
    assert math.isclose(r["far"], 1.0) and r["same"] == 0.0 and r["none"] is None
