"""Payload mappings, accounting and streaming ingest on literal items."""

import hashlib
import html
import json
import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from fieldnote import vocab
from fieldnote.operators.numbering import numbered
from fieldnote.plans import registry
from fieldnote.sources import ingest as ig
from fieldnote.session import checkpointed
from fieldnote.sources import mapping as mp
from fieldnote.sources import sinks as sk
from fieldnote.streaming.ingest import RAW, ingest_stream


def raw(spark, items, **extra):
    rows = [(json.dumps(i), "q1", "2026-01-01", k, *extra.values()) for k, i in enumerate(items)]
    cols = "payload string, collect_query string, collected_at string, arrival bigint" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame(rows, cols)


THREAD = {
    "reddit_id": "a1", "title": "Lost pic", "body": "mail me at bob@x.com", "author": "Al", "created_utc": 1700000000, "permalink": "/r/z/1", "subreddit": "z", "score": 3,
    "comments": [
        {"author": "B", "body": "hi  there\r\n\r\n\r\n\r\nok", "replies": [{"author": "C", "body": "deep", "replies": [{"author": "automod", "body": "bot"}]}]},
        {"author": "D", "body": "[deleted]"}, {"author": "E", "body": "last"},
    ],
}


def test_thread_is_one_record_depth_first(spark):
    r = mp.map_records(raw(spark, [THREAD]), "reddit", "salt", "run").first()
    assert r["text_clean"] == "Lost pic\n\nmail me at [EMAIL]\n\nhi there\n\nok\n\ndeep\n\nlast"
    assert [r["text_clean"][p["start"]:p["end"]] for p in r["posts"]] == ["Lost pic\n\nmail me at [EMAIL]", "hi there\n\nok", "deep", "last"]
    assert (r["n_deleted"], r["bots"], r["source_url"], r["thread_context"]) == (1, 1, "https://www.reddit.com/r/z/1", "r/z | Lost pic")
    assert r["author_key"] == r["posts"][0]["author_key"] and len(r["author_key"]) == 32


def test_every_post_deleted_gives_no_record(spark):
    items = [{"reddit_id": "a2", "title": "[removed]", "body": "", "author": "Al", "reddit_url": "http://u", "comments": []}]
    r = mp.map_records(raw(spark, items), "reddit", "salt", "run").first()
    assert r["record_id"] is None and r["n_deleted"] == 1


def test_flat_sources(spark):
    x = [{"id": "9", "fullText": "abc &amp; d…", "text": "abc &amp; defg @bob", "author": {"userName": "Zed"}, "createdAt": "Sat Sep 26 10:11:12 +0000 2026", "isReply": True}, {"id": "8", "isRetweet": True, "text": "t"}]
    rows = {r["native_id"]: r for r in mp.map_records(raw(spark, x), "x", "s", "r").collect()}
    assert rows["9"]["text_clean"] == "abc & defg [HANDLE]" and rows["9"]["created_at"] == "2026-09-26T10:11:12+00:00"
    assert rows["8"]["record_id"] is None and rows["8"]["n_deleted"] == 0
    q = [{"answer": {"id": "77", "text": "my text"}, "url": "https://q.com/What/answer/Jane-Doe", "author": {"name": "Jane"}, "title": "T"}]
    assert mp.map_records(raw(spark, q), "quora", "s", "r").first()["source_url"] == "https://q.com/What#answer-77"
    a = [{"id": {"label": "5"}, "title": {"label": "Ti"}, "content": {"label": "Bo"}, "im:rating": {"label": "4"}}, {"id": {"label": "6"}}]
    got = mp.map_records(raw(spark, a, app_id="1", country="in"), "appstore", "s", "r").collect()
    assert [(r["native_id"], r["rating"], r["text_clean"], r["region_hint"]) for r in got] == [("in-5", 4, "Ti\n\nBo", "IN")]


def test_threads_with_markup(spark):
    yt = [{"id": "t1", "snippet": {"videoId": "v", "topLevelComment": {"snippet": {"authorDisplayName": "A", "textDisplay": "a&lt;b<br>c", "publishedAt": "2024-01-02T00:00:00Z"}}},
           "replies": {"comments": [{"snippet": {"textOriginal": "late", "publishedAt": "2024-01-04T00:00:00Z"}}, {"snippet": {"textOriginal": "early", "publishedAt": "2024-01-03T00:00:00Z"}}]}}]
    assert mp.map_records(raw(spark, yt, video_title="vt"), "youtube", "s", "r").first()["text_clean"] == "a<b\nc\n\nearly\n\nlate"
    se = [{"question_id": "3", "title": "Q &amp; A", "body": "<p>hello</p>", "link": "L", "tags": ["a", "b"], "answers": [{"body": "<b>two</b>", "creation_date": 20}, {"body": "one", "creation_date": 10}]}]
    r = mp.map_records(raw(spark, se, site="webapps"), "stackexchange", "s", "r").first()
    assert (r["text_clean"], r["thread_context"]) == ("Q & A\n\nhello\n\none\n\ntwo", "webapps.stackexchange | a, b")
    hn = [{"objectID": "1", "story_text": "<p>x &lt; y", "title": "T"}, {"objectID": "2", "comment_text": "c", "title": "T"}]
    assert sorted(r["text_clean"] for r in mp.map_records(raw(spark, hn), "hackernews", "s", "r").collect()) == ["T\n\nx < y", "c"]
    gp = [{"tid": "1", "title": "Help", "posts": [{"author": "A", "date": "9/21/2026, 2:51:13 AM", "text": "where"}, {"author": "B", "text": "here"}, {"author": "B", "text": "here"}]}]
    r = mp.map_records(raw(spark, gp, base_url="http://h/"), "gp_help", "s", "r").first()
    assert (r["text_clean"], r["created_at"]) == ("Help\n\nwhere\n\nhere", "2026-09-21T02:51:13+00:00")


def test_reply_edges_of_any_depth(spark):
    rows = [("t", "a", None, 1), ("t", "b", "a", 1), ("t", "c", "a", 2), ("t", "d", "b", 1), ("t", "e", None, 2)]
    edges = spark.createDataFrame(rows, "thread_id string, id string, parent string, rank int")
    assert [r["id"] for r in mp.flatten_edges(edges).orderBy("position").collect()] == ["a", "b", "d", "c", "e"]


def test_tally_adds_up(spark):
    batch = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 1), (4, None, 2), (5, "c", 0)], "arrival bigint, record_id string, n_deleted int")
    stored = spark.createDataFrame([("b",), ("z",)], "record_id string")
    t = ig.tally(batch, stored).first()
    assert tuple(t) == (5, 2, 1, 1, 1, 3)
    assert {r["arrival"] for r in ig.new_records(batch, stored).collect()} == {1, 5}


def test_a_row_lost_on_the_way_is_noticed(spark):
    batch = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 1), (5, "c", 0)], "arrival bigint, record_id string, n_deleted int")
    stored = spark.createDataFrame([("b",)], "record_id string")
    written = ig.new_records(batch, stored)
    assert tuple(ig.tally(batch, stored, written).first()) == (4, 2, 1, 0, 1, 1)
    with pytest.raises(Exception, match="not all accounted for"):
        ig.tally(batch, stored, written.filter("record_id <> 'c'")).collect()


def test_a_lost_rebuild_leaves_the_table_as_it_was(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "table")
    rows = spark.range(10)
    with pytest.raises(FileNotFoundError):
        sk.current(spark, path)
    sk.rebuild(rows, path, "one")
    broken = rows.select(F.when(F.col("id") == 9, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sk.rebuild(broken, path, "two")
    assert sorted(tuple(r) for r in sk.current(spark, path).collect()) == [(i, "one") for i in range(10)]
    sk.rebuild(rows.filter("id < 3"), path, "three")
    assert sorted(tuple(r) for r in sk.current(spark, path).collect()) == [(i, "three") for i in range(3)]


def test_rows_are_numbered_in_ranges(spark):
    df = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("k")).repartition(7)
    out = numbered(df, ["k"])
    assert [r["k"] for r in out.orderBy("nth").collect()] == sorted(r["k"] for r in df.collect())
    assert [r["nth"] for r in out.orderBy("nth").collect()] == list(range(1, 5001))
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan.split("count")[0]
    assert numbered(df.limit(0), ["k"]).count() == 0


def test_streamed_ingest_is_idempotent(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    source, out, check = (os.path.join(folder, n) for n in ("in", "out", "chk"))
    items = [{"reviewId": f"r{i % 3}", "userName": "U", "content": f"text {i}", "score": 5} for i in range(5)]

    def feed(k):
        df = raw(spark, items).withColumns({"arrival": F.col("arrival") + 100 * k, "app_id": F.lit("com.x")})
        df.coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(RAW + ", app_id string").parquet(source)
        ingest_stream(stream, "play", out, check, "salt", "run").awaitTermination()
        return sorted((r["native_id"], r["text_clean"]) for r in spark.read.parquet(out).collect())

    feed(0)
    first = run()
    assert first == [("r0", "text 0"), ("r1", "text 1"), ("r2", "text 2")]
    feed(1)
    assert run() == first


def test_deep_and_long_threads_keep_every_reply(spark):
    deep = []
    for k in range(40, 0, -1):
        deep = [{"author": f"a{k}", "body": f"reply {k}", "replies": deep}]
    wide = [{"author": "b", "body": f"turn {k}"} for k in range(2000)]
    base = {"title": "T", "body": "top", "author": "Al", "created_utc": 1, "permalink": "/r/z/1", "subreddit": "z", "score": 3}
    items = [{**base, "reddit_id": "deep", "comments": deep}, {**base, "reddit_id": "wide", "comments": wide}, {**base, "reddit_id": "none"}]
    rows = {r["native_id"]: r for r in mp.map_records(raw(spark, items), "reddit", "salt", "run").collect()}
    assert rows["t3_deep"]["text_clean"].split("\n\n")[1:] == ["top", *[f"reply {k}" for k in range(1, 41)]]
    assert len(rows["t3_wide"]["posts"]) == 2001 and rows["t3_none"]["text_clean"] == "T\n\ntop"


def test_replies_whose_parent_is_not_there_are_roots(spark):
    rows = [("t", "a", None, 1), ("t", "b", "gone", 1), ("t", "c", "b", 1), ("u", "d", "gone", 4)]
    edges = spark.createDataFrame(rows, "thread_id string, id string, parent string, rank int")
    got = [(r["id"], r["depth"], r["orphan"]) for r in mp.flatten_edges(edges).orderBy("thread_id", "position").collect()]
    assert got == [("a", 1, False), ("b", 1, True), ("c", 2, False), ("d", 1, True)]


def test_reply_edges_by_doubling(spark, monkeypatch):
    rng = random.Random(4)
    rows, want = [], {}
    for t in range(12):
        ids = [f"{t}-{i}" for i in range(rng.choice([1, 2, 5, 40]))]
        ranks = {i: rng.randrange(3) for i in ids}
        parents = {i: (rng.choice(ids[:k]) if k and rng.random() < 0.8 else rng.choice([None, "gone"])) for k, i in enumerate(ids)}
        rows += [(f"t{t}", i, parents[i], ranks[i]) for i in ids]
        rows += [(f"t{t}", i, parents[i], ranks[i] + 1) for i in ids[:1]]  # the same post once more

        def walk(i, depth, out):
            out.append((i, depth))
            for c in sorted((c for c in ids if parents[c] == i), key=lambda c: (ranks[c], c)):  # noqa: B023
                walk(c, depth + 1, out)  # noqa: B023

        out = []
        for i in sorted((i for i in ids if parents[i] not in ids), key=lambda i: (parents[i] is not None, ranks[i], i)):
            walk(i, 1, out)
        want[f"t{t}"] = out
    # a circle has no root
    rows += [("t0", "x", "y", 1), ("t0", "y", "x", 1)]
    # a chain of 2,000 turns takes 12 rounds and the same number of joins of fixed-size rows
    rows += [("chain", str(i), str(i - 1) if i else None, 1) for i in range(2000)]
    want["chain"] = [(str(i), i + 1) for i in range(2000)]
    rounds = []
    monkeypatch.setattr(mp, "checkpointed", lambda df: rounds.append(1) or checkpointed(df))
    got = {}
    for r in mp.flatten_edges(spark.createDataFrame(rows, "thread_id string, id string, parent string, rank int")).orderBy("thread_id", "position").collect():
        got.setdefault(r["thread_id"], []).append((r["id"], r["depth"]))
        assert len(got[r["thread_id"]]) == r["position"] + 1
    assert got == want and len(rounds) <= 2 + 12
    assert mp.flatten_edges(spark.createDataFrame([], "thread_id string, id string, parent string, rank int")).count() == 0


def brute_text(text):
    """Scrubbed and normalised by Python's own expressions."""
    for kind, shown, pattern in vocab.SCRUB_RULES:
        text = re.sub(re.sub(r"^\(\?i?U\)", "", pattern), lambda m: shown, text, flags=re.I if pattern.startswith("(?i") else 0)  # noqa: B023
    phone = re.compile(vocab.PHONE_CANDIDATE.removeprefix("(?U)"))
    text = phone.sub(lambda m: "[PHONE]" if vocab.PHONE_DIGITS[0] <= len(re.sub(r"\D", "", m.group())) <= vocab.PHONE_DIGITS[1] else m.group(), text)
    text = re.sub("[ \t\f\v\xa0]+", " ", re.sub("\r\n?", "\n", text))
    return re.sub("\n{3,}", "\n\n", "\n".join(x.strip() for x in text.split("\n"))).strip()


ROWS = [
    "mail bob.lee@mail.example.com or see https://a.example/x?y=1 now", "call +91 98765 43210 today", "u/some_one and @some.body said", "ABCDE1234F is 1234 5678 9012",
    "card 4111 1111 1111 1111 1", "3 &lt; 4 &amp; www.b.example", "plain words", "year 2024, 12 of 30", "  two\t lines\r\n\r\n\r\n\r\nof 5 ",
]


def test_digests_of_all_rows_equal_a_brute_force_scrub(spark):
    folder = tempfile.mkdtemp()
    docs = [(i, x, "en", "a", 2 + 11 * i) for i, x in enumerate(ROWS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i % 2, i // 2, "user", x) for i, x in enumerate(ROWS)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    queries, digest = registry.load(), lambda x: hashlib.md5(x.encode()).hexdigest()
    for name, read in (("review_texts", str), ("store_feed_texts", str), ("answer_texts", str), ("short_post_texts", html.unescape)):
        got = {r["native_id"].removeprefix("in-"): r["digest"] for r in queries[name].job(spark, folder).collect()}
        assert got == {str(i): digest(brute_text(read(x))) for i, x in enumerate(ROWS)}, name
    got = {r["native_id"]: r["digest"] for r in queries["thread_texts"].job(spark, folder).collect()}
    assert got == {f"t3_{k}": digest("\n\n".join(brute_text(x) for x in ROWS[k::2])) for k in range(2)}
