"""Collected payloads to records.

A payload table has one JSON document per row: ``payload``, ``collect_query``, ``arrival`` (a unique
number: the order of collection), and for some sources a few columns that were known when it was fetched.
Each source is a mapping that reads its fields and lists the posts of an item; what follows (scrubbing,
offsets, ids) is the same for all sources. A thread is one record and stays in its row throughout.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldnote import vocab
from fieldnote.functions import html as hx
from fieldnote.functions import text as tx
from fieldnote.session import checkpointed

POSTS = "array<struct<author:string,text:string,at:string>>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def post(author: Column, text: Column, at: Column) -> Column:
    return F.struct(
        author.cast("string").alias("author"), text.cast("string").alias("text"), at.cast("string").alias("at")
    )


def _or_empty(posts: Column) -> Column:
    return F.coalesce(posts, F.array().cast(POSTS))


def _filled(*options: Column) -> Column:
    """The first option that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


# ------------------------------------------------------------------------------- reply trees
def tree_posts(tree: Column) -> Column:
    """A nested reply list, as JSON, as one list of posts: each reply right after what it answers, of any depth."""

    def flat(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: _depth_first(json.loads(t)) if t else [])

    return F.pandas_udf(flat, POSTS)(tree)


def _depth_first(nodes: list | None) -> list[dict]:
    out, open_ = [], list(reversed(nodes or []))
    while open_:
        n = open_.pop()
        if isinstance(n, dict):
            values = ((k, n.get(f)) for k, f in (("author", "author"), ("text", "body"), ("at", "created_utc")))
            out.append({k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in values})
            replies = n.get("replies")
            open_ += reversed(replies if isinstance(replies, list) else [])
    return out


def flatten_edges(edges: DataFrame) -> DataFrame:
    """A reply tree given as rows (``thread_id, id, parent, rank``), of any depth, in depth-first order.

    Gives ``thread_id, id, position, depth, orphan``: the place in the thread from 0, the level from 1, and whether the
    parent's row is not there: such a reply is a root of its own, after the roots that were roots already. Siblings
    stand by rank, then id. Of rows with one id the one with the smallest rank counts; replies in a circle have no root and are left out.

    The walk round the tree enters and leaves every post: a list of two steps a post, in which each step knows the
    next. Steps are numbered by doubling: each round a step jumps as far as its goal has jumped, so a chain of n posts
    takes about log2(2n) rounds, and what a step carries has a fixed size whatever the depth.
    """
    given = edges.groupBy("thread_id", "id").agg(F.min(F.struct("rank", "parent")).alias("x")).select("thread_id", "id", "x.parent", "x.rank")
    there = given.select("thread_id", F.col("id").alias("parent"), F.lit(True).alias("found"))
    # a post with very many replies is one window: its siblings are sorted and streamed, not collected
    w = W.partitionBy("thread_id", "above").orderBy("orphan", "rank", "id")
    held = given.join(there, ["thread_id", "parent"], "left").withColumn("orphan", F.col("parent").isNotNull() & F.col("found").isNull())
    held = held.withColumn("above", F.when(F.col("found"), F.col("parent")))
    held = checkpointed(held.withColumns({"sibling": F.lead("id").over(w), "place": F.row_number().over(w)}).select("thread_id", "id", "above", "orphan", "sibling", "place"))
    first = held.filter("place = 1 and above is not null").select("thread_id", F.col("above").alias("id"), F.col("id").alias("child"))
    step = lambda kind, of: F.when(of.isNotNull(), F.struct(F.lit(kind).alias("out"), of.alias("id")))
    posts = held.join(first, ["thread_id", "id"], "left")
    own = F.struct(F.lit(False).alias("out"), "id"), F.struct(F.lit(True).alias("out"), "id")
    steps = posts.select(
        "thread_id",
        F.explode(
            F.array(
                F.struct(own[0].alias("at"), F.coalesce(step(False, F.col("child")), own[1]).alias("next"), F.lit(1).alias("enters"), F.lit(1).alias("rise")),
                F.struct(own[1].alias("at"), F.coalesce(step(False, F.col("sibling")), step(True, F.col("above"))).alias("next"), F.lit(0).alias("enters"), F.lit(-1).alias("rise")),
            )
        ).alias("s"),
    ).select("thread_id", "s.*")
    # enters, rise: posts entered and levels climbed from this step up to the one before ``next``
    steps = checkpointed(steps)
    longest = steps.groupBy("thread_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(max(0, longest - 1).bit_length()):
        goal = steps.select("thread_id", F.col("at").alias("next"), F.col("next").alias("then"), F.col("enters").alias("e"), F.col("rise").alias("r"))
        steps = checkpointed(
            steps.join(goal, ["thread_id", "next"], "left").select(
                "thread_id", "at", F.col("then").alias("next"), (F.col("enters") + F.coalesce("e", F.lit(0))).alias("enters"), (F.col("rise") + F.coalesce("r", F.lit(0))).alias("rise")
            )
        )
    # all that reach the end have no next; posts still to be entered and levels still to climb give the place
    reached = steps.filter("next is null and not at.out").select("thread_id", F.col("at.id").alias("id"), "enters", "rise")
    total = reached.groupBy("thread_id").agg(F.max("enters").alias("total"))
    return reached.join(total, "thread_id").join(held.select("thread_id", "id", "orphan"), ["thread_id", "id"]).select(
        "thread_id", "id", (F.col("total") - F.col("enters")).alias("position"), (1 - F.col("rise")).alias("depth"), "orphan"
    )


# ------------------------------------------------------------------------------- per source
@dataclass(frozen=True)
class Mapping:
    """How one source's payload becomes a record. ``fields`` maps record columns to columns over ``p``."""

    schema: str
    fields: Callable[[], dict[str, Column]]
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    keep: Callable[[], Column] = lambda: F.lit(True)


_P = F.col


def _reddit() -> dict[str, Column]:
    title, body = tx.strip(F.coalesce("p.title", F.lit(""))), tx.strip(F.coalesce("p.body", F.lit("")))
    opening = F.when(tx.is_deleted(body), title).otherwise(tx.strip(F.concat(title, F.lit("\n\n"), body)))
    replies = _or_empty(tree_posts(F.col("p.comments")))
    people = F.filter(replies, lambda c: ~tx.is_bot(c["author"]))
    url = _filled(F.col("p.reddit_url"), F.col("p.permalink"), F.lit(""))
    return {
        "native_id": F.concat(F.lit("t3_"), "p.reddit_id"),
        "source_url": F.when(url.startswith("/"), F.concat(F.lit("https://www.reddit.com"), url)).otherwise(url),
        "posts": F.concat(F.array(post(F.col("p.author"), opening, F.col("p.created_utc"))), people),
        "bots": F.size(replies) - F.size(people),
        "created_at": F.col("p.created_utc"),
        "engagement": F.col("p.score"),
        "thread_context": F.when(
            F.col("p.subreddit").isNotNull() & (F.col("p.subreddit") != ""),
            F.concat(F.lit("r/"), "p.subreddit", F.lit(" | "), title),
        ).otherwise(title),
    }


def _x() -> dict[str, Column]:
    at = F.col("p.createdAt")
    return {
        "native_id": F.col("p.id"),
        # The handle in the collected address is personal data; the id alone resolves.
        "source_url": F.concat(F.lit("https://x.com/i/status/"), "p.id"),
        "posts": F.array(post(F.col("p.author.userName"), F.col("longest"), at)),
        "created_at": at,
        "engagement": F.col("p.likeCount"),
        "thread_context": F.when(F.col("p.isReply"), "reply"),
    }


def _x_text(df: DataFrame) -> DataFrame:
    full, short = F.coalesce("p.fullText", F.lit("")), F.coalesce("p.text", F.lit(""))
    return df.withColumn("longest", hx.unescape(F.when(F.length(full) >= F.length(short), full).otherwise(short)))


def _quora() -> dict[str, Column]:
    native = _filled(F.col("p.answer.id"), F.col("p.url"))
    page = _filled(F.col("p.question.url"), F.regexp_replace(F.coalesce("p.url", F.lit("")), "(?s)/answer/[^/?#]+.*", ""), F.lit(""))
    return {
        "native_id": native,
        # The answer's own address ends in its author's name: link the question and name the answer.
        "source_url": F.concat(page, F.lit("#answer-"), native),
        "posts": F.array(
            post(
                _filled(F.col("p.answer.author.name"), F.col("p.author.name")),
                _filled(F.col("p.answer.text"), F.col("p.text")),
                _filled(F.col("p.answer.posted_at"), F.col("p.posted_at")),
            )
        ),
        "engagement": F.col("p.metrics.upvotes"),
        "thread_context": _filled(F.col("p.question.title"), F.col("p.title")),
    }


def _play() -> dict[str, Column]:
    return {
        "native_id": F.col("p.reviewId"),
        "source_url": F.concat(F.lit("https://play.google.com/store/apps/details?id="), "app_id", F.lit("&reviewId="), "p.reviewId"),
        "posts": F.array(post(F.col("p.userName"), F.col("p.content"), F.col("p.at"))),
        "rating": F.col("p.score"),
        "engagement": F.col("p.thumbsUpCount"),
        "platform_hint": F.lit("android"),
    }


def _appstore() -> dict[str, Column]:
    label = lambda name: F.col(f"p.{name}.label")
    text = tx.strip(F.concat(F.coalesce(label("title"), F.lit("")), F.lit("\n\n"), F.coalesce(label("content"), F.lit(""))))
    return {
        "native_id": F.concat("country", F.lit("-"), label("id")),
        "source_url": F.concat(
            F.lit("https://apps.apple.com/"), "country", F.lit("/app/id"), "app_id", F.lit("?see-all=reviews#review-"), label("id")
        ),
        "posts": F.array(post(F.col("p.author.name.label"), text, label("updated"))),
        "rating": label("`im:rating`").try_cast("int"),
        "platform_hint": F.lit("ios"),
        "region_hint": F.upper("country"),
    }


_YT = "struct<authorDisplayName:string,textOriginal:string,textDisplay:string,publishedAt:string,likeCount:bigint>"


def _youtube_texts(df: DataFrame) -> DataFrame:
    replies = F.array_sort(
        F.coalesce("p.replies.comments", F.array().cast(f"array<struct<snippet:{_YT}>>")),
        lambda a, b: F.when(F.coalesce(a["snippet"]["publishedAt"], F.lit("")) < F.coalesce(b["snippet"]["publishedAt"], F.lit("")), -1)
        .when(F.coalesce(a["snippet"]["publishedAt"], F.lit("")) > F.coalesce(b["snippet"]["publishedAt"], F.lit("")), 1)
        .otherwise(0),
    )
    all_ = F.concat(F.array("p.snippet.topLevelComment.snippet"), F.transform(replies, lambda r: r["snippet"]))
    df = df.withColumn("said", all_)
    return df.withColumn("shown", hx.unescape_each(F.transform("said", lambda s: hx.strip_tags(s["textDisplay"]))))


def _youtube() -> dict[str, Column]:
    return {
        "native_id": F.col("p.id"),
        "source_url": F.concat(F.lit("https://www.youtube.com/watch?v="), "p.snippet.videoId", F.lit("&lc="), "p.id"),
        "posts": F.zip_with(
            "said", "shown", lambda s, t: post(s["authorDisplayName"], _filled(s["textOriginal"], tx.strip(t)), s["publishedAt"])
        ),
        "engagement": F.col("p.snippet.topLevelComment.snippet.likeCount"),
        "thread_context": F.col("video_title"),
    }


_SE_OWNER = "owner:struct<display_name:string>,body:string,creation_date:bigint"


def _stackexchange_texts(df: DataFrame) -> DataFrame:
    answers = F.array_sort(
        F.coalesce("p.answers", F.array().cast(f"array<struct<{_SE_OWNER}>>")),
        lambda a, b: F.signum((F.coalesce(a["creation_date"], F.lit(0)) - F.coalesce(b["creation_date"], F.lit(0))).cast("double")).cast("int"),
    )
    df = df.withColumn("answers", answers)
    bodies = F.concat(F.array(F.col("p.title"), hx.strip_tags(F.col("p.body"))), F.transform("answers", lambda a: hx.strip_tags(a["body"])))
    return df.withColumn("plain", hx.unescape_each(bodies))


def _stackexchange() -> dict[str, Column]:
    question = F.concat(F.get("plain", 0), F.lit("\n\n"), tx.strip(F.get("plain", 1)))
    rest = F.slice("plain", 3, F.greatest(F.size("plain") - 2, F.lit(0)))
    return {
        "native_id": F.concat("site", F.lit("-"), "p.question_id"),
        "source_url": F.col("p.link"),
        "posts": F.concat(
            F.array(post(F.col("p.owner.display_name"), question, F.col("p.creation_date"))),
            F.zip_with("answers", rest, lambda a, t: post(a["owner"]["display_name"], tx.strip(t), a["creation_date"])),
        ),
        "engagement": F.col("p.score"),
        "thread_context": F.concat("site", F.lit(".stackexchange | "), F.array_join(F.coalesce("p.tags", F.array().cast("array<string>")), ", ")),
    }


def _hackernews_text(df: DataFrame) -> DataFrame:
    comment = F.nullif(F.col("p.comment_text"), F.lit(""))
    body = tx.strip(hx.unescape(hx.strip_tags(F.coalesce(comment, F.col("p.story_text"), F.lit("")))))
    return df.withColumn("body", body)


def _hackernews() -> dict[str, Column]:
    titled = (F.coalesce("p.title", F.lit("")) != "") & (F.coalesce("p.comment_text", F.lit("")) == "")
    text = F.when(titled, tx.strip(F.concat("p.title", F.lit("\n\n"), "body"))).otherwise(F.col("body"))
    return {
        "native_id": F.col("p.objectID"),
        "source_url": F.concat(F.lit("https://news.ycombinator.com/item?id="), "p.objectID"),
        "posts": F.array(post(F.col("p.author"), text, F.col("p.created_at"))),
        "engagement": F.col("p.points"),
        "thread_context": _filled(F.col("p.story_title"), F.col("p.title")),
    }


def _gp_help() -> dict[str, Column]:
    """A help thread shows its promoted answer twice; a repeated (author, date, text) is one post."""
    title = F.coalesce("p.title", F.lit(""))
    given = F.coalesce("p.posts", F.array().cast("array<struct<author:string,date:string,text:string>>"))

    def shown(p: Column, i: Column) -> Column:
        text = tx.strip(F.coalesce(p["text"], F.lit("")))
        led = F.when((i == 0) & (title != "") & ~F.startswith(text, title), F.concat(title, F.lit("\n\n"), text)).otherwise(text)
        return post(p["author"], led, tx.to_iso(p["date"]))

    posts = F.array_distinct(F.transform(given, shown))
    return {
        "native_id": F.col("p.tid"),
        "source_url": F.concat("base_url", "p.tid"),
        "posts": posts,
        "created_at": F.get(posts, 0)["at"],
        "thread_context": F.col("p.title"),
    }


_LABEL = "struct<label:string>"
MAPPINGS: dict[str, Mapping] = {
    "reddit": Mapping(
        "reddit_id string, title string, body string, author string, created_utc string, reddit_url string, "
        "permalink string, subreddit string, score bigint, noResults boolean, comments string",
        _reddit,
        keep=lambda: ~F.coalesce("p.noResults", F.lit(False)),
    ),
    "x": Mapping(
        "id string, fullText string, text string, author struct<userName:string>, createdAt string, likeCount bigint, "
        "isReply boolean, isRetweet boolean, retweeted_tweet string, noResults boolean",
        _x,
        prepare=_x_text,
        keep=lambda: ~F.coalesce("p.noResults", F.lit(False)),
    ),
    "quora": Mapping(
        "answer struct<id:string,text:string,posted_at:string,author:struct<name:string>>, question struct<url:string,title:string>, "
        "url string, text string, title string, posted_at string, author struct<name:string>, metrics struct<upvotes:bigint>, noResults boolean",
        _quora,
        keep=lambda: ~F.coalesce("p.noResults", F.lit(False)),
    ),
    "play": Mapping("reviewId string, userName string, content string, at string, score int, thumbsUpCount bigint", _play),
    "appstore": Mapping(
        f"id {_LABEL}, title {_LABEL}, content {_LABEL}, updated {_LABEL}, `im:rating` {_LABEL}, author struct<name:{_LABEL}>",
        _appstore,
        keep=lambda: F.col("p.`im:rating`").isNotNull(),
    ),
    "youtube": Mapping(
        f"id string, snippet struct<videoId:string,topLevelComment:struct<snippet:{_YT}>>, replies struct<comments:array<struct<snippet:{_YT}>>>",
        _youtube,
        prepare=_youtube_texts,
    ),
    "stackexchange": Mapping(
        f"question_id string, title string, link string, score bigint, tags array<string>, {_SE_OWNER.replace(':', ' ', 1).replace('body:', 'body ').replace('creation_date:', 'creation_date ')}, "
        f"answers array<struct<{_SE_OWNER}>>",
        _stackexchange,
        prepare=_stackexchange_texts,
    ),
    "hackernews": Mapping(
        "objectID string, comment_text string, story_text string, title string, author string, created_at string, points bigint, story_title string",
        _hackernews,
        prepare=_hackernews_text,
    ),
    "gp_help": Mapping("tid string, title string, posts array<struct<author:string,date:string,text:string>>", _gp_help),
}
OPTIONAL = {
    "bots": "int", "created_at": "string", "rating": "int", "engagement": "bigint", "thread_context": "string",
    "platform_hint": "string", "region_hint": "string",
}


def parse_items(raw: DataFrame, source: str) -> DataFrame:
    """The payload as a struct ``p``; placeholders and other non-items are left out."""
    m = MAPPINGS[source]
    return raw.withColumn("p", F.from_json("payload", m.schema)).filter(m.keep())


def item_counts(raw: DataFrame, source: str) -> DataFrame:
    """How many payloads are items, placeholders or unreadable."""
    m = MAPPINGS[source]
    rows = raw.withColumn("p", F.from_json("payload", m.schema))
    readable = F.is_valid_json if hasattr(F, "is_valid_json") else None
    broken = F.try_parse_json("payload").isNull() if readable is None else ~readable("payload")
    return rows.agg(
        F.count("*").alias("fetched"),
        F.count_if(broken).alias("unreadable"),
        F.count_if(~broken & ~m.keep()).alias("placeholders"),
        F.count_if(~broken & m.keep()).alias("items"),
    )


def map_records(raw: DataFrame, source: str, salt: str, run_id: str, method: str | None = None) -> DataFrame:
    """Payloads of one source to record rows (``record_id`` NULL where every post was deleted)."""
    m = MAPPINGS[source]
    df = m.prepare(parse_items(raw, source))
    fields = m.fields()
    if source == "x":
        # A repost is fetched but holds no text of its own.
        repost = F.coalesce("p.isRetweet", F.lit(False)) | F.col("p.retweeted_tweet").isNotNull()
        fields["posts"] = F.when(repost, F.array().cast(POSTS)).otherwise(fields["posts"])
    cols = {k: v for k, v in fields.items()}
    for name, kind in OPTIONAL.items():
        cols[name] = cols.get(name, F.lit(None)).cast(kind)
    carried = [c for c in ("arrival", "collect_query", "collected_at") if c in raw.columns]
    rows = df.select(*carried, *[c.alias(n) for n, c in cols.items()])
    return records_from_posts(rows, source, salt, run_id, method or vocab.SOURCE_METHOD[source])


def records_from_posts(rows: DataFrame, source: str, salt: str, run_id: str, method: str) -> DataFrame:
    """The part every source shares: drop deleted posts, scrub, normalise, join, and note offsets."""
    gap = len(vocab.POST_SEPARATOR)
    source_col = F.lit(source)
    kept = F.filter("posts", lambda p: ~tx.is_deleted(p["text"]))
    scrubbed = F.transform(
        kept, lambda p: F.struct(p["author"].alias("author"), tx.scrub(p["text"]).alias("raw"), p["at"].alias("at"))
    )
    parts = F.filter(
        F.transform(
            scrubbed,
            lambda p: F.struct(
                tx.author_key(source_col, p["author"], salt).alias("author_key"),
                p["raw"].alias("raw"),
                tx.normalise(p["raw"]).alias("clean"),
            ),
        ),
        lambda p: p["clean"] != "",
    )
    first_at = F.get(kept, 0)["at"]
    # Parts come out of a generator: a later filter on the record would otherwise be worked out below it, scrub and all, once more.
    rows = rows.select("*", F.explode(F.array(F.struct(parts.alias("parts")))).alias("held"))
    df = rows.withColumns(
        {
            "parts": F.col("held.parts"),
            "n_given": F.size("posts"),
            "created_at": tx.to_iso(F.coalesce("created_at", first_at)),
        }
    )
    sums = tx.running_sums(F.transform("parts", lambda p: F.length(p["clean"]) + gap))
    ends = F.transform(sums, lambda e: e - gap)
    df = df.withColumn("ends", ends)
    placed = F.zip_with(
        "parts",
        "ends",
        lambda p, e: F.struct(p["author_key"].alias("author_key"), (e - F.length(p["clean"])).alias("start"), e.alias("end")),
    )
    some = F.size("parts") > 0
    missing = F.lit(None).cast("string")
    return df.select(
        *[c for c in ("arrival",) if c in rows.columns],
        F.when(some, tx.record_id(source_col, F.col("native_id"))).alias("record_id"),
        source_col.alias("source"),
        F.lit(method).alias("collect_method"),
        F.when(some & (F.coalesce("source_url", F.lit("")) == ""), F.raise_error(F.lit("a record needs its address")).cast("string"))
        .otherwise(F.col("source_url")).alias("source_url"),
        F.col("native_id").cast("string").alias("native_id"),
        F.get("parts", 0)["author_key"].alias("author_key"),
        "created_at",
        F.array_join(F.transform("parts", lambda p: p["raw"]), vocab.POST_SEPARATOR).alias("text_raw"),
        F.array_join(F.transform("parts", lambda p: p["clean"]), vocab.POST_SEPARATOR).alias("text_clean"),
        missing.alias("text_en"),
        missing.alias("lang"),
        "rating",
        "engagement",
        tx.scrub(F.col("thread_context")).alias("thread_context"),
        "platform_hint",
        "region_hint",
        (F.col("collect_query") if "collect_query" in rows.columns else missing).alias("collect_query"),
        (F.col("collected_at") if "collected_at" in rows.columns else missing).alias("collected_at"),
        F.lit(run_id).alias("ingest_run_id"),
        F.when(F.size("parts") > 1, placed).alias("posts"),
        (F.col("n_given") - F.size("parts")).alias("n_deleted"),
        F.coalesce("bots", F.lit(0)).alias("bots"),
    )
