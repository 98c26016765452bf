"""Queries on collection: payloads to records, accounting, parsed answers, and result-table upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnote.functions import text as tx
from fieldnote.operators import marks as mk
from fieldnote.plans import standins as st
from fieldnote.plans.catalog_coding import _NORM
from fieldnote.plans.registry import query
from fieldnote.sources import ingest as ig
from fieldnote.sources import mapping as mp
from fieldnote.sources import model_output as mo
from fieldnote.sources import sinks as sk
from fieldnote.session import shared_folder
from fieldnote.streaming.ingest import RAW, ingest_stream, top_up

S = SparkSession
T = st.with_tables

_HAS_DATA = "regexp_matches({0}, '[0-9@]|u/|www|http')"


def _plain(column: str = "text"):
    """Texts without characters that personal data is made of: their scrub is checked to change nothing."""
    return ~F.col(column).rlike("[0-9@]|u/|www|http")


def _digests(rows: DataFrame) -> DataFrame:
    """All records with the digest of their text. SQL cannot scrub, so these have none; the tests compare all rows with a brute-force scrub."""
    return rows.filter("record_id is not null").select("native_id", F.md5("text_clean").alias("digest"))


# ------------------------------------------------------------------------------- threads
def thread_payloads(spark: S, d: str) -> DataFrame:
    """Each conversation as one nested post: every turn is the reply to the turn before."""
    turn = F.struct("turn", "role", "text")
    c = st.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    # every turn answers the one before, so the tree is as deep as the conversation is long
    open_ = F.transform(
        F.slice("t", 2, F.size("t")), lambda x: F.rtrim(F.to_json(F.struct(x["role"].alias("author"), x["text"].alias("body"))), F.lit("}"))
    )
    chain = F.when(F.size("t") > 1, F.concat(F.lit("["), F.array_join(open_, ',"replies":['), F.repeat(F.lit("}]"), F.size("t") - 1))).otherwise("[]")
    first = F.get("t", 0)
    payload = F.to_json(
        F.struct(
            F.col("conv_id").cast("string").alias("reddit_id"), F.lit("").alias("title"), first["text"].alias("body"), first["role"].alias("author"),
            F.lit("1700000000").alias("created_utc"), F.concat(F.lit("/r/x/"), "conv_id").alias("permalink"), F.lit("x").alias("subreddit"),
            F.size("t").alias("score"),
        )
    )
    payload = F.concat(F.rtrim(payload, F.lit("}")), F.lit(',"comments":'), chain, F.lit("}"))
    return c.select(payload.alias("payload"), F.lit("term").alias("collect_query"), F.col("conv_id").alias("arrival"))


@query(
    "thread_records",
    f"""SELECT native_id, n AS engagement, CASE WHEN NOT risky THEN md5(string_agg(c, chr(10) || chr(10) ORDER BY turn)) END AS digest, count(*) AS posts FROM (
          SELECT 't3_' || conv_id AS native_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, bool_or({_HAS_DATA.format('text')}) OVER (PARTITION BY conv_id) AS risky, {_NORM} AS c FROM conversations)
        WHERE c <> '' GROUP BY native_id, n, risky""",
)
def thread_records(spark: S, d: str) -> DataFrame:
    """Nested threads to records, depth first. All threads; a digest only where SQL, which has no scrub, has the same text (see thread_texts)."""
    risky = st.read(spark, d, "conversations").filter(~_plain()).select(F.concat(F.lit("t3_"), F.col("conv_id").cast("string")).alias("native_id"), F.lit(True).alias("risky")).distinct()
    rows = mp.map_records(thread_payloads(spark, d), "reddit", st.SALT, "r").join(risky, "native_id", "left")
    return rows.select("native_id", "engagement", F.when(F.col("risky").isNull(), F.md5("text_clean")).alias("digest"), F.coalesce(F.size("posts"), F.lit(1)).alias("posts"))


@query("thread_texts")
def thread_texts(spark: S, d: str) -> DataFrame:
    """The digest of every thread's text, scrubbed ones too."""
    return _digests(mp.map_records(thread_payloads(spark, d), "reddit", st.SALT, "r"))


@query(
    "reply_order",
    """SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(turn AS VARCHAR) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations""",
)
def reply_order(spark: S, d: str) -> DataFrame:
    """Turns as a chain of replies of any depth, brought back into reading order."""
    c = st.read(spark, d, "conversations")
    edges = c.select(
        F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").cast("string").alias("id"),
        F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), F.lit(1).alias("rank"),
    )
    rows = mp.flatten_edges(edges)
    return rows.select("thread_id", "id", (F.col("position") + 1).alias("nth"))


# ------------------------------------------------------------------------------- flat items
def _flat(spark: S, d: str, fields: list) -> DataFrame:
    docs = st.read(spark, d, "documents")
    return docs.select(
        F.to_json(F.struct(*fields)).alias("payload"), F.col("lang").alias("collect_query"), F.col("doc_id").alias("arrival"),
        F.lit("com.example.app").alias("app_id"), F.lit("in").alias("country"), F.lit("site").alias("site"), F.lit("https://help.example/").alias("base_url"), F.lit("title").alias("video_title"),
    )


_FLAT_SQL = f"""SELECT CAST(doc_id AS VARCHAR) AS native_id, CASE WHEN NOT {_HAS_DATA.format('text')} THEN md5(c) END AS digest, <columns>
                FROM (SELECT doc_id, source, lang, n_chars, text, {_NORM} AS c FROM documents) WHERE c <> ''"""


def _compared(spark: S, d: str, rows: DataFrame, *cols, plain=None) -> DataFrame:
    """All mapped rows; a digest of the text where SQL, which has no scrub, has the same text. The _texts queries have all digests."""
    same = _plain() if plain is None else plain
    risky = st.read(spark, d, "documents").filter(~same).select(F.col("doc_id").cast("string").alias("native_id"), F.lit(True).alias("risky"))
    return (
        rows.filter(F.col("record_id").isNotNull())
        .withColumn("native_id", F.regexp_replace("native_id", "^in-", ""))
        .join(risky, "native_id", "left")
        .select("native_id", F.when(F.col("risky").isNull(), F.md5("text_clean")).alias("digest"), *cols)
    )


def review_payloads(spark: S, d: str) -> DataFrame:
    c = F.col
    return _flat(spark, d, [c("doc_id").cast("string").alias("reviewId"), c("source").alias("userName"), c("text").alias("content"), (1 + c("n_chars") % 5).alias("score")])


@query("review_records", _FLAT_SQL.replace("<columns>", "CAST(1 + n_chars % 5 AS INT) AS rating, 'android' AS platform_hint"))
def review_records(spark: S, d: str) -> DataFrame:
    return _compared(spark, d, mp.map_records(review_payloads(spark, d), "play", st.SALT, "r"), "rating", "platform_hint")


@query("review_texts")
def review_texts(spark: S, d: str) -> DataFrame:
    """The digest of every text, scrubbed ones too."""
    return _digests(mp.map_records(review_payloads(spark, d), "play", st.SALT, "r"))


def store_feed_payloads(spark: S, d: str) -> DataFrame:
    label = lambda x: F.struct(x.cast("string").alias("label"))
    c = F.col
    return _flat(spark, d, [label(c("doc_id")).alias("id"), label(c("text")).alias("content"), label(1 + c("n_chars") % 5).alias("im:rating")])


@query("store_feed_records", _FLAT_SQL.replace("<columns>", "CAST(1 + n_chars % 5 AS INT) AS rating, 'IN' AS region_hint"))
def store_feed_records(spark: S, d: str) -> DataFrame:
    return _compared(spark, d, mp.map_records(store_feed_payloads(spark, d), "appstore", st.SALT, "r"), "rating", "region_hint")


@query("store_feed_texts")
def store_feed_texts(spark: S, d: str) -> DataFrame:
    """The digest of every text, scrubbed ones too."""
    return _digests(mp.map_records(store_feed_payloads(spark, d), "appstore", st.SALT, "r"))


def answer_payloads(spark: S, d: str) -> DataFrame:
    c = F.col
    return _flat(spark, d, [F.struct(c("doc_id").cast("string").alias("id"), c("text").alias("text")).alias("answer"), F.concat(F.lit("https://q.example/What/answer/"), "source").alias("url"), c("lang").alias("title")])


@query("answer_records", _FLAT_SQL.replace("<columns>", "'https://q.example/What#answer-' || doc_id AS source_url, lang AS thread_context"))
def answer_records(spark: S, d: str) -> DataFrame:
    """Answers keep the question's address; the part that names their author is cut."""
    return _compared(spark, d, mp.map_records(answer_payloads(spark, d), "quora", st.SALT, "r"), "source_url", "thread_context")


@query("answer_texts")
def answer_texts(spark: S, d: str) -> DataFrame:
    """The digest of every text, scrubbed ones too."""
    return _digests(mp.map_records(answer_payloads(spark, d), "quora", st.SALT, "r"))


def short_post_payloads(spark: S, d: str) -> DataFrame:
    c = F.col
    return _flat(
        spark, d,
        [c("doc_id").cast("string").alias("id"), F.substring("text", 1, 100).alias("fullText"), c("text"), (c("n_chars") % 3 == 0).alias("isReply"), (c("n_chars") % 11 == 0).alias("isRetweet")],
    )


@query(
    "short_post_records",
    f"""SELECT CAST(doc_id AS VARCHAR) AS native_id, CASE WHEN NOT {_HAS_DATA.format('text')} AND text NOT LIKE '%&%' THEN md5(c) END AS digest, CASE WHEN n_chars % 3 = 0 THEN 'reply' END AS thread_context, 'https://x.com/i/status/' || doc_id AS source_url
        FROM (SELECT doc_id, n_chars, text, {_NORM} AS c FROM documents) WHERE c <> '' AND n_chars % 11 <> 0""",
)
def short_post_records(spark: S, d: str) -> DataFrame:
    """The longer of two texts counts; reposts are fetched but hold no text."""
    rows = mp.map_records(short_post_payloads(spark, d), "x", st.SALT, "r")
    # A text holding an entity is decoded, which SQL does not.
    return _compared(spark, d, rows, "thread_context", "source_url", plain=_plain() & ~F.col("text").contains("&"))


@query("short_post_texts")
def short_post_texts(spark: S, d: str) -> DataFrame:
    """The digest of every text, scrubbed ones too."""
    return _digests(mp.map_records(short_post_payloads(spark, d), "x", st.SALT, "r"))


@query("comment_thread_records")
def comment_thread_records(spark: S, d: str) -> DataFrame:
    """Question, answers and markup: pages as questions with two answers each."""
    p = st.read(spark, d, "pages")
    answer = lambda n: F.struct(F.concat(F.lit("<p>answer "), F.col("url"), F.lit("</p>")).alias("body"), F.lit(n).alias("creation_date"))
    payload = F.to_json(
        F.struct(
            F.col("page_id").cast("string").alias("question_id"), F.lit("Q &amp; A").alias("title"), F.col("url").alias("link"), F.col("html").alias("body"),
            F.array(answer(20), answer(10)).alias("answers"), F.lit(1700000000).alias("creation_date"),
        )
    )
    raw = p.select(payload.alias("payload"), F.lit("q").alias("collect_query"), F.col("page_id").alias("arrival"), F.lit("site").alias("site"))
    return mp.map_records(raw, "stackexchange", st.SALT, "r").select("native_id", F.size("posts").alias("posts"), F.length("text_clean").alias("n_chars"))


@query(
    "item_counts",
    """SELECT count(*) AS fetched, count(*) FILTER (n_chars % 10 = 1) AS unreadable, count(*) FILTER (n_chars % 10 = 0) AS placeholders, count(*) FILTER (n_chars % 10 > 1) AS items FROM documents""",
)
def item_counts(spark: S, d: str) -> DataFrame:
    k = F.col("n_chars") % 10
    payload = F.when(k == 1, "{broken").when(k == 0, '{"noResults": true}').otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"))))
    return mp.item_counts(st.read(spark, d, "documents").select(payload.alias("payload")), "x")


@query(
    "bot_authors",
    """SELECT event_id FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'u/AutoModerator' WHEN 'click' THEN 'stats_bot' WHEN 'error' THEN 'robot' ELSE 'Ann' END AS a FROM events)
       WHERE regexp_replace(lower(a), '^u/', '') IN ('automoderator') OR regexp_matches(lower(a), '[-_]bot$')""",
)
def bot_authors(spark: S, d: str) -> DataFrame:
    t = F.col("event_type")
    author = F.when(t == "view", "u/AutoModerator").when(t == "click", "stats_bot").when(t == "error", "robot").otherwise("Ann")
    return st.read(spark, d, "events").filter(tx.is_bot(author)).select("event_id")


# ------------------------------------------------------------------------------- accounting
_BATCH = """SELECT event_id AS arrival, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) || event_type END AS record_id, event_type AS collect_query, user_id FROM events"""


def batch(spark: S, d: str) -> DataFrame:
    e = st.read(spark, d, "events")
    rid = F.when(F.col("event_type") != "error", F.concat(F.col("user_id").cast("string"), "event_type"))
    return e.select(F.col("event_id").alias("arrival"), rid.alias("record_id"), F.col("event_type").alias("collect_query"), F.lit(0).alias("n_deleted"), "user_id")


def _stored(spark: S, d: str) -> DataFrame:
    return batch(spark, d).filter("record_id is not null and user_id < 40").select("record_id").distinct()


@query(
    "ingest_tally",
    """SELECT count(*) AS fetched, count(DISTINCT record_id) FILTER (user_id >= 40) AS written_new, count(DISTINCT record_id) FILTER (user_id < 40) AS already_present,
         count(*) FILTER (record_id IS NULL) AS all_deleted, count(record_id) - count(DISTINCT record_id) AS duplicate_in_batch, 0 AS deleted_posts FROM b""".replace("FROM b", f"FROM ({_BATCH}) AS b"),
)
def ingest_tally(spark: S, d: str) -> DataFrame:
    return ig.tally(batch(spark, d), _stored(spark, d))


@query("new_records", f"SELECT min(arrival) AS arrival, record_id FROM ({_BATCH}) AS b WHERE record_id IS NOT NULL AND user_id >= 40 GROUP BY record_id")
def new_records(spark: S, d: str) -> DataFrame:
    return ig.new_records(batch(spark, d), _stored(spark, d)).select("arrival", "record_id")


@query(
    "query_yields",
    f"SELECT collect_query, count(DISTINCT record_id) FILTER (user_id >= 40) AS new_records FROM ({_BATCH}) AS b GROUP BY collect_query",
)
def query_yields(spark: S, d: str) -> DataFrame:
    b = batch(spark, d)
    return ig.yields(b, _stored(spark, d), b)


# ------------------------------------------------------------------------------- answers from outside
@query(
    "parsed_answers",
    """SELECT CAST(doc_id AS VARCHAR) AS custom_id, CASE WHEN quality = 1 AND toxic = 0 THEN quality END AS label, CASE WHEN toxic = 1 THEN 'model_refusal' WHEN quality = 0 THEN 'coding_failed' END AS failure,
         CASE WHEN toxic IS NULL THEN NULL ELSE 100 END AS input_tokens FROM labels
       UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, 'missing', NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def parsed_answers(spark: S, d: str) -> DataFrame:
    """Labels as response lines: refusals, broken documents, and documents nobody answered for."""
    ok = F.to_json(F.struct(F.col("quality").alias("label")))
    text = F.when(F.col("quality") == 0, '{"label": ').otherwise(ok)
    kind = F.when(F.col("toxic") == 1, "refusal").otherwise("output_text")
    content = F.array(F.struct(kind.alias("type"), text.alias("text")))
    body = F.struct(F.array(F.struct(F.lit("message").alias("type"), content.alias("content"))).alias("output"), F.struct(F.lit(100).alias("input_tokens")).alias("usage"))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("custom_id"), F.struct(body.alias("body")).alias("response")))
    parsed = mo.parse_responses(st.read(spark, d, "labels").select(line.alias("value")), "label int")
    asked = st.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("custom_id"))
    return mo.answers_for(asked, parsed).select("custom_id", F.col("answer.label").alias("label"), "failure", "input_tokens")


# ------------------------------------------------------------------------------- result tables
@query(
    "replaced_rows",
    """SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def replaced_rows(spark: S, d: str) -> DataFrame:
    o = st.read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    again = o.filter("o_orderstatus = 'P'")
    return sk.replaced(o, again, again.withColumn("o_orderstatus", F.lit("new")), "o_orderkey")


@query("rebuilt_table", """SELECT o_orderkey, o_orderstatus, 'run-2' AS run_id FROM orders WHERE o_orderstatus <> 'P'""")
def rebuilt_table(spark: S, d: str) -> DataFrame:
    """A result table written twice: what the second run built is all that is there, stamped with that run."""
    path = f"{shared_folder(spark)}/rebuilt-{uuid.uuid4().hex}"
    o = st.read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sk.rebuild(o, path, "run-1")
    sk.rebuild(o.filter("o_orderstatus <> 'P'"), path, "run-2")
    return sk.current(spark, path)


@query(
    "streamed_records",
    f"""SELECT CAST(k AS VARCHAR) AS native_id, count(*) AS items, any_value(stars) AS rating FROM (SELECT doc_id - doc_id % 2 AS k, {_NORM} AS c FROM documents),
        LATERAL (SELECT CAST(1 + k % 5 AS INT) AS stars) WHERE c <> '' GROUP BY k""",
)
def streamed_records(spark: S, d: str) -> DataFrame:
    """Documents as a stream of reviews, two of one id, fed twice: each id is stored once, whatever is replayed."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    key = F.col("doc_id") - F.col("doc_id") % 2
    items = st.read(spark, d, "documents").select(
        F.to_json(F.struct(key.cast("string").alias("reviewId"), F.col("source").alias("userName"), F.col("text").alias("content"), (1 + key % 5).alias("score"))).alias("payload"),
        F.col("lang").alias("collect_query"), F.lit("2026-01-01").alias("collected_at"), F.col("doc_id").alias("arrival"), F.lit("com.example.app").alias("app_id"), key.alias("k"),
    )
    items.drop("k").write.parquet(f"{folder}/in/a")
    items.drop("k").withColumn("arrival", F.col("arrival") + 10**12).write.parquet(f"{folder}/in/b")
    for part in ("a", "b"):
        stream = spark.readStream.schema(RAW + ", app_id string").parquet(f"{folder}/in/{part}")
        ingest_stream(stream, "play", f"{folder}/out", f"{folder}/progress-{part}", st.SALT, "r").awaitTermination()
    stored = spark.read.parquet(f"{folder}/out").select("native_id", "rating")
    fed = items.join(_with_text(spark, d), F.col("arrival") == F.col("t"), "left_semi").groupBy(F.col("k").cast("string").alias("native_id")).agg(F.count("*").alias("items"))
    return stored.join(fed, "native_id")


def _with_text(spark: S, d: str) -> DataFrame:
    return st.read(spark, d, "documents").filter(tx.normalise(F.col("text")) != "").select(F.col("doc_id").alias("t"))


@query(
    "topped_up",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, true AS queued FROM documents WHERE doc_id % 5 <> 0 AND n_chars % 7 <> 0 AND n_chars % 11 <> 0""",
)
def topped_up(spark: S, d: str) -> DataFrame:
    """Documents that cleaning kept and no pass has read: neither a story nor a mark of the reading pass."""
    r = st.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "source", "doc_id", "n_chars")
    stories = r.filter("doc_id % 5 = 0").select("record_id", F.concat("record_id", F.lit(":0")).alias("story_id"))
    out = mk.mark(r.filter("n_chars % 7 = 0"), "clean", "too_short", "by rule", "r").unionByName(mk.mark(r.filter("n_chars % 11 = 0"), "segment", "no_story", "by rule", "r"))
    return top_up(r, stories, out).select("record_id", "queued")


_RUNS = """SELECT 'orders' AS "table", 'run' || o_orderstatus AS run_id FROM orders UNION SELECT 'events', 'run' || event_type FROM events"""


def _manifest(spark: S, d: str) -> DataFrame:
    return sk.manifest(
        {
            "orders": st.read(spark, d, "orders").select(F.concat(F.lit("run"), "o_orderstatus").alias("run_id")),
            "events": st.read(spark, d, "events").select(F.concat(F.lit("run"), "event_type").alias("run_id")),
        }
    )


@query("run_manifest", f"""SELECT "table", string_agg(run_id, ',' ORDER BY run_id) AS run_ids FROM ({_RUNS}) GROUP BY "table" """)
def run_manifest(spark: S, d: str) -> DataFrame:
    return _manifest(spark, d).withColumn("run_ids", F.array_join("run_ids", ","))


@query("stale_tables", """SELECT 'orders' AS "table" """)
def stale_tables(spark: S, d: str) -> DataFrame:
    now = _manifest(spark, d)
    pinned = now.withColumn("run_ids", F.when(F.col("table") == "orders", F.slice("run_ids", 1, 1)).otherwise(F.col("run_ids")))
    return sk.stale_tables(pinned, now).select("table")


@query(
    "served_figures",
    T("stories", """SELECT key, CAST((nth - 1) // 40 AS INT) AS part, '[' || string_agg(row, ',' ORDER BY row) || ']' AS value_json, 'r' AS run_id FROM (
         SELECT *, row_number() OVER (PARTITION BY key ORDER BY row) AS nth FROM (
           SELECT 'spans' AS key, '{"n":' || count(*) || ',"min_len":' || min(length(story_id)) || '}' AS row FROM stories
           UNION ALL SELECT 'buckets', '{"bucket":"' || bucket || '","n":' || count(*) || '}' FROM stories GROUP BY bucket
           UNION ALL SELECT 'cells', '{"record_id":"' || record_id || '","primary_stage":"' || primary_stage || '","n":' || count(*) || '}' FROM stories GROUP BY record_id, primary_stage))
       GROUP BY key, (nth - 1) // 40 UNION ALL SELECT 'none', 0, '[]', 'r'"""),
)
def served_figures(spark: S, d: str) -> DataFrame:
    s = st.stories(spark, d)
    return sk.served_figures(
        {
            "spans": s.agg(F.count("*").alias("n"), F.min(F.length("story_id")).alias("min_len")),
            "buckets": s.groupBy("bucket").agg(F.count("*").alias("n")),
            "cells": s.groupBy("record_id", "primary_stage").agg(F.count("*").alias("n")),
            "none": s.filter("false").select("bucket"),
        },
        "r",
        rows=40,
    )


@query(
    "corpus_stamp",
    T("stories records", """SELECT 'Corpus v1 — ' || (SELECT count(*) FROM stories WHERE day_no <> 31 AND bucket = 'core') || ' core stories from ' || (SELECT count(DISTINCT author_key) FROM stories WHERE day_no <> 31 AND bucket = 'core')
        || ' people, in ' || format('{:,}', count(*)) || ' public records collected ' || min(created_at) || ' to ' || max(created_at) || ' · codebook v1' AS stamp FROM records"""),
)
def corpus_stamp(spark: S, d: str) -> DataFrame:
    from fieldnote.operators import funnel

    s, r = st.stories(spark, d), st.records(spark, d)
    stories = funnel.story_funnel(s.drop("source"), s.select("record_id", "source").distinct(), st.story_exclusions(s), "r")
    records = funnel.record_funnel(r, st.no_marks(spark), "r")
    return sk.corpus_stamp(stories.unionByName(records), r, "v1", "v1")
