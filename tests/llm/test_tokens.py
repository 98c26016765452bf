"""Token files and packing against the tokenizers library, and exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldnote.llm.jaccard_join import near_copies
from fieldnote.llm.packing import packed, packed_patterns
from fieldnote.llm.store import new_path
from fieldnote.llm.substring_dedup import without_repeats
from fieldnote.llm.token_files import read_tokens, token_digest, write_tokens

from fieldnote.llm.wordhash import chunks, word_hashes, words

from .helpers import documents, none, odd

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def brute_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("rows", [documents, odd])
def test_token_files(spark, rows):
    docs = rows(spark)
    path = new_path(spark, "tokens")
    write_tokens(docs, path, WORDS)
    t = Tokenizer.from_file(WORDS)
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, crc(ids), len(ids)) for r in docs.collect() for ids in [t.encode(r["text"] or "", add_special_tokens=False).ids + [2]])
    got = token_digest(spark, path).orderBy("start").collect()
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == [x[:2] for x in want]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"], r["n_tokens"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert read_tokens(spark, path).filter("id = 7").count() == 1


def test_token_files_of_nothing(spark):
    path = new_path(spark, "tokens")
    write_tokens(none(spark), path, WORDS)
    assert token_digest(spark, path).count() == 0


@pytest.mark.parametrize("rows", [documents, odd])
def test_packing(spark, rows):
    docs = rows(spark)
    t = Tokenizer.from_file(BYTES)
    want, total = [], 0
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        cuts = list(range(len(ids), 0, -1024))[::-1]
        at = 0
        for i, e in enumerate(cuts):
            want.append((r["doc_id"] if r["doc_id"] is not None else -1, i, at, e - at, crc(ids[at:e])))
            at = e
    got = packed(docs, BYTES).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    if len(got) > 100:
        assert len(by) <= 1.03 * -(-total // 1024)


def test_packing_of_nothing(spark):
    assert packed(none(spark), BYTES).count() == 0


def test_patterns_use_every_length():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 5000):
        counts = np.bincount(np.clip(rng.lognormal(5.5, 1.2, n).astype(int), 1, 1024), minlength=1025)
        used = np.zeros(1025, int)
        for pattern, times in packed_patterns(counts, 1024):
            assert sum(pattern) <= 1024 and times > 0
            for x in pattern:
                used[x] += times
        assert (used == counts).all()


def thue_morse(n, first="ab"):
    """Two regular words of ``n`` letters, one the mirror of the other, on which polynomial hashes meet."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(first[b] for b in bits), "".join(first[1 - b] for b in bits)


def test_regular_words_do_not_meet(spark):
    pairs = [thue_morse(n) for n in (256, 512, 1024, 2048, 4096, 65536)]
    for a, b in pairs:
        t = next(chunks(pa.array([f"{a} {b} {a.upper()}"])))
        h = word_hashes(t, words(t))
        assert len(set(h.tolist())) == 3
        low = word_hashes(t, words(t), lower=True)
        assert low[0] == low[2] != low[1]
    rows = [(i, x) for i, x in enumerate(x for p in pairs[2:] for x in p)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["length"] for r in packed(df, public_tokenizers.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("length")).collect()}
    assert got == {i: len(tokenizer.encode(x, add_special_tokens=False).ids) + 1 for i, x in rows}
    kept = without_repeats(spark.createDataFrame([(1, f"{pairs[3][0]} " * 60), (2, f"{pairs[3][1]} " * 60)], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in kept] == [0, 0]
    same = near_copies(spark.createDataFrame([(1, pairs[3][0]), (2, pairs[3][1])], "doc_id long, text string"), k=4, percent=85).collect()
    assert {r["component_id"] for r in same} == {1, 2}
