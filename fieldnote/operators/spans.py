"""Threads, posts, and the spans of stories inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldnote import vocab
from fieldnote.functions import spans as sp
from fieldnote.functions import text as tx
from fieldnote.operators import marks as mk


def own_posts(posts: Column, author: Column, text: Column) -> Column:
    """The post list of a record; a single-post record is one post over its whole text."""
    whole = F.array(
        F.struct(author.alias("author_key"), F.lit(0).alias("start"), F.length(text).alias("end"))
    )
    return F.coalesce(posts, whole)


def assemble_threads(posts: DataFrame, separator: str = vocab.POST_SEPARATOR) -> DataFrame:
    """Posts to one record per thread.

    Input: ``thread_id, ordinal, author_key, text`` (already scrubbed). Deleted and empty posts are left
    out and counted. A record is one row, so a thread's posts meet in one row by definition; posts of
    other threads do not.
    """
    clean = tx.normalise(F.col("text"))
    ok = ~tx.is_deleted(F.col("text")) & (clean != "")
    part = F.struct("ordinal", "author_key", clean.alias("clean"), F.col("text").alias("raw"))
    rows = posts.groupBy("thread_id").agg(
        F.array_sort(F.collect_list(F.when(ok, part))).alias("parts"), F.count_if(~ok).alias("n_deleted")
    )
    gap = len(separator)
    ends = tx.running_sums(F.transform("parts", lambda p: F.length(p["clean"]) + gap))
    placed = F.zip_with(
        "parts",
        ends,
        lambda p, e: F.struct(p["author_key"].alias("author_key"), (e - gap - F.length(p["clean"])).alias("start"), (e - gap).alias("end")),
    )
    return rows.select(
        "thread_id",
        F.array_join(F.transform("parts", lambda p: p["raw"]), separator).alias("text_raw"),
        F.array_join(F.transform("parts", lambda p: p["clean"]), separator).alias("text_clean"),
        F.get("parts", 0)["author_key"].alias("author_key"),
        F.when(F.size("parts") > 1, placed).alias("posts"),
        F.size("parts").alias("n_posts"),
        "n_deleted",
    )


def explode_posts(records: DataFrame) -> DataFrame:
    """The posts of each record as rows again: ``record_id, post, author_key, start, end, text``."""
    listed = own_posts(F.col("posts"), F.col("author_key"), F.col("text_clean"))
    return records.select("record_id", "text_clean", F.posexplode(listed).alias("i", "p")).select(
        "record_id",
        (F.col("i") + 1).alias("post"),
        F.col("p.author_key").alias("author_key"),
        F.col("p.start").alias("start"),
        F.col("p.end").alias("end"),
        sp.region_text(F.col("text_clean"), F.col("p")).alias("text"),
    )


def distinct_posts(posts: DataFrame) -> DataFrame:
    """Drop a thread's repeated posts (same author, date and text); the first one stays."""
    return (
        posts.groupBy("thread_id", "author", "created_at", "text")
        .agg(F.min("ordinal").alias("ordinal"))
        .select("thread_id", "ordinal", "author", "created_at", "text")
    )


def chunk_threads(records: DataFrame, most: int = vocab.CHUNK_CHARS) -> DataFrame:
    """Cut threads on post boundaries: ``record_id, part, first_post, n_posts, chars``.

    Parts are filled in order up to ``most`` characters. A longer post is a part of its own, never cut.
    """
    listed = own_posts(F.col("posts"), F.col("author_key"), F.col("text_clean"))
    lengths = F.transform(listed, lambda p: p["end"] - p["start"])
    rows = records.select("record_id", lengths.alias("n")).withColumn("to", tx.running_sums(F.col("n")))
    posts = F.transform("n", lambda n, i: F.struct(i.alias("i"), (F.get("to", i) - n).alias("before"), F.get("to", i).alias("to")))
    # a part starts with the first post that would bring the part before beyond the limit
    rows = rows.withColumn("starts", tx.chain(posts, lambda start, p: p["to"] - start["before"] > most))
    part = F.transform(
        "starts",
        lambda p, k: F.struct(
            k.alias("part"),
            (p["i"] + 1).alias("first_post"),
            (F.coalesce(F.get("starts", k + 1)["i"], F.size("n")) - p["i"]).cast("bigint").alias("n_posts"),
            (F.coalesce(F.get("starts", k + 1)["before"], F.element_at("to", -1)) - p["before"]).cast("bigint").alias("chars"),
        ),
    )
    return rows.select("record_id", F.explode(part).alias("p")).select("record_id", "p.*")


# ------------------------------------------------------------------------------- quotes
def verify_quotes(quotes: DataFrame, stories: DataFrame, records: DataFrame) -> DataFrame:
    """Each (story, field, quote) with the exact span it matches, or NULL.

    A quote is looked for in the story and in its author's later posts; another person's words in the
    same thread never support it.
    """
    where = stories.select("story_id", "record_id", "char_start", "char_end", F.col("author_key").alias("story_author"))
    text = records.select("record_id", "text_clean", own_posts(F.col("posts"), F.col("author_key"), F.col("text_clean")).alias("posts"))
    regions = sp.allowed_regions(F.col("posts"), F.col("char_start"), F.col("char_end"), F.col("story_author"))
    return (
        quotes.join(where, "story_id")
        .join(text, "record_id")
        .select("story_id", "field", "quote", sp.verify(F.col("text_clean"), F.col("quote"), regions).alias("span"))
    )


def queries_in_text(queries: DataFrame, texts: DataFrame, unquote: bool = True) -> DataFrame:
    """Literal searches a story reports, kept when its text holds them.

    ``queries``: story_id, queries (array of struct text, worked). Output has the attempt number, whether
    it worked, and ``in_text``. ``unquote`` takes the quotation marks round a search away; a caller whose searches are
    slices of text, where a mark belongs to the text, leaves them.
    """
    rows = queries.select("story_id", F.posexplode("queries").alias("i", "q"))
    q = tx.squeeze(F.col("q.text"))
    if unquote:
        q = F.regexp_replace(q, "^['\"‘’“”]+|['\"‘’“”]+$", "")
    rows = rows.select(
        "story_id",
        q.alias("query_text"),
        (F.col("i") + 1).alias("attempt_no"),
        F.when(F.col("q.worked") == "yes", True).when(F.col("q.worked") == "no", False).alias("worked"),
    ).filter("query_text <> ''")
    return rows.join(texts.select("story_id", "text_clean"), "story_id").select(
        "story_id", "query_text", "attempt_no", "worked",
        F.contains(F.lower(tx.squeeze(F.col("text_clean"))), F.lower("query_text")).alias("in_text"),
    )


# ------------------------------------------------------------------------------- story spans
def locate_stories(answers: DataFrame, records: DataFrame) -> DataFrame:
    """Place returned stories in their record by their first and last words.

    ``answers``: record_id, post, start, end, bucket, reason, confidence, reaches_stage. Adds char_start,
    char_end (NULL when not found) and the author of the post.
    """
    text = records.select(
        "record_id", "text_clean", own_posts(F.col("posts"), F.col("author_key"), F.col("text_clean")).alias("posts")
    )
    at = sp.locate(F.col("text_clean"), F.col("posts"), F.col("post"), F.col("start"), F.col("end"))
    return (
        answers.join(text, "record_id")
        .withColumn("at", at)
        .withColumns(
            {
                "char_start": F.col("at.start"),
                "char_end": F.col("at.end"),
                "author_key": F.get("posts", F.col("post") - 1)["author_key"],
                "text": F.substring("text_clean", F.col("at.start") + 1, F.col("at.end") - F.col("at.start")),
                "reason": F.coalesce(F.nullif(tx.strip(F.col("reason")), F.lit("")), F.lit("—")),
                "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))),
                "reaches_stage": F.least(F.lit(10), F.greatest(F.lit(0), F.col("reaches_stage"))),
            }
        )
        .drop("at", "posts", "text_clean")
    )


def merge_spans(spans: DataFrame) -> DataFrame:
    """Keep a set of spans that do not overlap, per record, with counts of what was dropped.

    ``spans``: record_id, char_start, char_end (NULL when not located). In order of (start, end) a span is
    dropped when it starts before the last kept one ends. Spans with one start are reduced to the
    shortest before the rows of a record meet (of such a group at most the first can be kept), so a
    record's list is never longer than its text.
    """
    per_start = spans.groupBy("record_id", "char_start").agg(F.min("char_end").alias("char_end"), F.count("*").alias("n"))
    is_at = F.col("char_start").isNotNull()
    rows = per_start.groupBy("record_id").agg(
        F.sum("n").alias("returned"),
        F.coalesce(F.sum(F.when(~is_at, F.col("n"))), F.lit(0)).alias("unlocated"),
        F.array_sort(
            F.collect_list(F.when(is_at, F.struct(F.col("char_start").alias("start"), F.col("char_end").alias("end"))))
        ).alias("open"),
    )
    # spans start in order, so all later ones start after a kept one ends once one does
    kept = tx.chain(F.col("open"), lambda last, s: s["start"] >= last["end"])
    return rows.withColumn("kept", kept).select(
        "record_id",
        "returned",
        "unlocated",
        (F.col("returned") - F.col("unlocated") - F.size("kept")).alias("overlapping"),
        F.size("kept").alias("n_kept"),
        "kept",
    )


def kept_stories(merged: DataFrame) -> DataFrame:
    """The kept spans as rows with their ordinal and story id."""
    return merged.select("record_id", F.posexplode("kept").alias("ordinal", "s")).select(
        F.concat("record_id", F.lit(":"), F.col("ordinal").cast("string")).alias("story_id"),
        "record_id",
        "ordinal",
        F.col("s.start").alias("char_start"),
        F.col("s.end").alias("char_end"),
    )


def story_ordinals(stories: DataFrame) -> DataFrame:
    """Number the stories of a record by position, from zero."""
    w = W.partitionBy("record_id").orderBy("char_start", "char_end")
    return stories.withColumn("ordinal", F.row_number().over(w) - 1)


def outcome_marks(merged: DataFrame, records: DataFrame, run_id: str) -> DataFrame:
    """The ``records`` that were read and left without a story: nothing returned, or nothing that could be located."""
    read = records.select("record_id", "source").join(merged.select("record_id", "n_kept", "returned", "unlocated"), "record_id", "left")
    empty = read.fillna(0, ["n_kept", "returned", "unlocated"]).filter("n_kept = 0")
    reason = F.when(F.col("returned") > 0, "span_unverified").otherwise("no_story")
    detail = F.when(
        F.col("returned") > 0,
        F.concat(F.col("returned").cast("string"), F.lit(" returned, "), F.col("unlocated").cast("string"), F.lit(" not located")),
    ).otherwise("no retrieval story in the record")
    return mk.mark(empty, "segment", reason, detail, run_id)


def apply_verdicts(
    stories: DataFrame, verdicts: DataFrame, records: DataFrame, exclusions: DataFrame, run_id: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A second reader's verdicts: (stories, exclusions, counts).

    ``verdicts``: story_id, is_story, bucket, reason, reaches_stage. A rejected story is marked, a kept
    one takes the new bucket, stages only rise, and a record whose stories are all marked is marked too.
    """
    v = verdicts.select(
        "story_id",
        "is_story",
        F.col("bucket").alias("new_bucket"),
        F.col("reason").alias("new_reason"),
        F.least(F.lit(10), F.greatest(F.lit(0), F.col("reaches_stage"))).alias("new_stage"),
    )
    judged = stories.join(v, "story_id", "left")
    if "source" not in stories.columns:
        judged = judged.join(records.select("record_id", "source"), "record_id")
    keeps = F.coalesce(F.col("is_story"), F.lit(False))
    rejected = judged.filter("is_story = false")
    told = F.concat(F.lit("rejected by confirmation: "), F.coalesce("new_reason", F.lit("")))
    out = mk.add_marks(exclusions, mk.mark(rejected, "segment", "no_story", told, run_id, story=True))
    live = mk.live_stories(stories, out).groupBy("record_id").agg(F.count("*").alias("live"))
    emptied = (
        stories.select("record_id").distinct().join(live, "record_id", "left_anti")
        .join(records.select("record_id", "source"), "record_id")
    )
    out = mk.add_marks(out, mk.mark(emptied, "segment", "no_story", "every story rejected by confirmation", run_id))
    changed = F.col("new_bucket") != F.col("bucket")
    updated = judged.select(
        *[
            c
            for c in stories.columns
            if c not in ("bucket", "bucket_reason", "reaches_stage")
        ],
        F.when(keeps, F.col("new_bucket")).otherwise(F.col("bucket")).alias("bucket"),
        F.when(keeps & changed, F.coalesce(F.nullif(tx.strip(F.col("new_reason")), F.lit("")), F.lit("—")))
        .otherwise(F.col("bucket_reason")).alias("bucket_reason"),
        F.when(keeps, F.greatest("reaches_stage", "new_stage")).otherwise(F.col("reaches_stage")).alias("reaches_stage"),
    )
    counts = judged.groupBy("bucket").agg(
        F.count_if(F.col("is_story").isNull()).alias("unanswered"),
        F.count_if(F.col("is_story") == F.lit(False)).alias("rejected"),
        F.count_if(keeps & changed).alias("bucket_changed"),
        F.count_if(keeps & (F.col("new_stage") > F.col("reaches_stage"))).alias("stage_raised"),
    )
    return updated, out, counts


def match_intervals(first: DataFrame, second: DataFrame, bucket: int = 4096) -> DataFrame:
    """Pair two sets of non-overlapping spans of a record, one to one, in order of position.

    A pair shares at least half of the shorter span; each span of ``first``, in order, takes the first span of ``second``
    that is still free. Input: ``record_id, char_start, char_end, id``. Output: ``record_id, a, b``.

    Spans meet in buckets of text, one that crosses a border in each of its buckets; a pair counts in the bucket where
    the later of the two starts. As neither side overlaps itself, there are fewer such pairs than spans. One sweep over
    a record's pairs settles them: spans are taken in order, so only the last taken one of each side has to be known.
    """
    def cut(df: DataFrame, name: str) -> DataFrame:
        s = F.struct(F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.col("id").cast("string").alias("id"))
        last = F.greatest(F.floor((F.col("char_end") - 1) / bucket), F.floor(F.col("char_start") / bucket))
        return df.filter("char_start is not null and char_end is not null").select(
            "record_id", s.alias(name), F.explode(F.sequence(F.floor(F.col("char_start") / bucket), last)).alias("bucket")
        )

    x, y = F.col("x"), F.col("y")
    common = F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])
    shorter = F.least(x["end"] - x["start"], y["end"] - y["start"])
    met = cut(first, "x").join(cut(second, "y"), ["record_id", "bucket"]).filter((common > 0) & (common >= 0.5 * shorter))
    pairs = met.filter(F.col("bucket") == F.floor(F.greatest(x["start"], y["start"]) / bucket)).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("pairs"))
    # neither side overlaps itself, so in this order the spans of both sides only move on
    taken = tx.chain(F.col("pairs"), lambda last, p: (p["x"] > last["x"]) & (p["y"] > last["y"]))
    return pairs.select("record_id", F.explode(taken).alias("m")).select("record_id", F.col("m.x.id").alias("a"), F.col("m.y.id").alias("b"))


def raise_stages(stories: DataFrame, second: DataFrame) -> DataFrame:
    """Stages rise to what a second reader saw, never fall. ``second``: story_id, reaches_stage."""
    up = second.groupBy("story_id").agg(F.max("reaches_stage").alias("seen"))
    return stories.join(up, "story_id", "left").withColumn(
        "reaches_stage", F.greatest("reaches_stage", F.coalesce("seen", "reaches_stage"))
    ).drop("seen")


def confirm_tags(
    tags: DataFrame, stories: DataFrame, records: DataFrame, verdicts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Theme tags that have a verified quote and a positive verdict, and counts of the others.

    ``tags``: story_id, theme, quote, ordinal (the last one of a theme counts). ``verdicts``: story_id,
    theme, keep.
    """
    one = tags.groupBy("story_id", "theme").agg(F.max_by("quote", "ordinal").alias("quote"))
    found = verify_quotes(one.withColumnRenamed("theme", "field"), stories, records).withColumnRenamed("field", "theme")
    judged = found.join(verdicts.select("story_id", "theme", "keep"), ["story_id", "theme"], "left")
    keep = F.col("span").isNotNull() & F.coalesce("keep", F.lit(False))
    kept = judged.filter(keep).select("story_id", "theme", "span")
    counts = judged.groupBy("theme").agg(
        F.count_if(F.col("span").isNull()).alias("dropped_unverified"),
        F.count_if(F.col("span").isNotNull()).alias("candidates"),
        F.count_if(F.col("span").isNotNull() & F.col("keep").isNull()).alias("unanswered"),
        F.count_if(keep).alias("kept"),
    )
    return kept, counts


def theme_counts(themes: DataFrame) -> DataFrame:
    """Stories of each confirmed theme, most first: ``theme, stories``. ``themes``: a row per story and theme."""
    return themes.groupBy("theme").agg(F.count("*").alias("stories")).orderBy(F.desc("stories"), "theme")


def record_bucket(records: DataFrame, stories: DataFrame) -> DataFrame:
    """The most relevant bucket among a record's stories; ``irrelevant`` when it has none."""
    rank = F.array_position(F.array(*[F.lit(b) for b in vocab.BUCKETS]), F.col("bucket"))
    best = stories.groupBy("record_id").agg(F.min(rank).cast("int").alias("r"))
    names = F.array(*[F.lit(b) for b in vocab.BUCKETS])
    return records.select("record_id").join(best, "record_id", "left").select(
        "record_id", F.coalesce(F.get(names, F.col("r") - 1), F.lit("irrelevant")).alias("bucket")
    )


def retry_list(merged: DataFrame) -> DataFrame:
    """Records to read once more: a part without an answer, or a story that was not located."""
    return merged.filter("missing_parts > 0 or unlocated > 0").select("record_id", "n_kept", "missing_parts", "unlocated")


def retry_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What reading the listed records once more changed: their counts before and after (NULL: not read again)."""
    cols = ["n_kept", "missing_parts", "unlocated"]
    a = before.select("record_id", *[F.col(c).alias(f"{c}_before") for c in cols])
    b = after.select("record_id", *[F.col(c).alias(f"{c}_after") for c in cols])
    return a.join(b, "record_id", "left")
