"""Expectations over tables: each check returns its violations, counted by rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldnote import vocab
from fieldnote.functions import rules as ru
from fieldnote.functions import text as tx
from fieldnote.operators import marks as mk
from fieldnote.operators.coding import CODES, code_maps, questions_asked


def row_rules(table: str) -> dict[str, Column]:
    """The conditions every row of a table meets."""
    c = F.col
    one_of = lambda col, vals: c(col).isin(list(vals))
    unless_null = lambda col, cond: c(col).isNull() | cond
    share = lambda col: c(col).between(0, 1)
    rules = {
        "records": {
            "source is known": one_of("source", vocab.SOURCE_METHOD),
            "collect_method is known": one_of("collect_method", vocab.COLLECT_METHODS),
            "source_url is not empty": F.length("source_url") > 0,
            "text_raw is not empty": F.length("text_raw") > 0,
            "text_clean is present": c("text_clean").isNotNull(),
            "rating is 1-5": unless_null("rating", c("rating").between(1, 5)),
            "platform_hint is known": unless_null("platform_hint", one_of("platform_hint", vocab.PLATFORM_HINTS)),
        },
        "exclusions": {
            "stage is known": one_of("stage", vocab.STAGES_OF_WORK),
            "reason is known": one_of("reason", vocab.EXCLUSION_REASONS),
        },
        "stories": {
            "bucket is known": one_of("bucket", vocab.BUCKETS),
            "bucket_reason is not empty": F.length("bucket_reason") > 0,
            "bucket_conf is a share": share("bucket_conf"),
            "reaches_stage is 0-10": c("reaches_stage").between(0, 10),
            "ordinal is not negative": c("ordinal") >= 0,
            "span is not empty": (c("char_start") >= 0) & (c("char_end") > c("char_start")),
            "text is as long as its span": F.length("text") == c("char_end") - c("char_start"),
        },
        "story_spine": {
            "photo_class is known": one_of("photo_class", vocab.PHOTO_CLASSES),
            "media_type is known": one_of("media_type", vocab.MEDIA_TYPES),
            "primary_stage is 0-10": one_of("primary_stage", vocab.FAILURE_OWNER),
            "failure_owner is known": one_of("failure_owner", set(vocab.FAILURE_OWNER.values())),
            "outcome is known": one_of("outcome", vocab.OUTCOMES),
            "severity is 1-5": unless_null("severity", c("severity").between(1, 5)),
            "coding_conf is a share": share("coding_conf"),
        },
        "story_codes": {
            "accuracy is known": unless_null("accuracy", one_of("accuracy", vocab.ACCURACIES)),
            "confidence is a share": share("confidence"),
            "stage 5 is inferred": ~c("question").startswith("5.") | c("inferred"),
        },
        "evidence": {"span is long enough": F.length("span") >= vocab.MIN_SPAN},
        "story_themes": {"span is long enough": F.length("span") >= vocab.MIN_SPAN},
        "runs": {"status is known": one_of("status", vocab.RUN_STATUSES)},
    }
    return rules.get(table, {})


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rule, rows`` for each rule; one pass over the table. A NULL outcome breaks a rule."""
    counts = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(f"c{i}") for i, r in enumerate(rules.values())])
    return counts.select(
        F.explode(
            F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("rows")) for i, name in enumerate(rules)])
        ).alias("x")
    ).select("x.rule", "x.rows")


def failing_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The rows that break a rule, with the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a child table its parent lacks."""
    return child.filter(F.col(key).isNotNull()).select(key).distinct().join(parent.select(key), key, "left_anti")


# ------------------------------------------------------------------------------- stories
def not_verbatim(stories: DataFrame, records: DataFrame) -> DataFrame:
    """Stories whose text is not the exact slice of their record."""
    cut = F.substring("text_clean", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return (
        stories.select("story_id", "record_id", "text", "char_start", "char_end")
        .join(records.select("record_id", "text_clean"), "record_id")
        .filter((F.col("text") != cut) | (F.col("text") == ""))
        .select("story_id")
    )


def overlapping_stories(stories: DataFrame) -> DataFrame:
    """Stories that start before the previous one of their record ends."""
    before = F.lag("char_end").over(W.partitionBy("record_id").orderBy("char_start", "char_end"))
    return stories.withColumn("before", before).filter("char_start < before").select("story_id")


def wrong_author(stories: DataFrame, posts: DataFrame) -> DataFrame:
    """Stories whose author is not the author of the post they start in (``posts`` as exploded rows)."""
    p = posts.select("record_id", F.col("author_key").alias("post_author"), F.col("start"), F.col("end"))
    s = stories.select("story_id", "record_id", "char_start", "author_key")
    inside = (F.col("start") <= F.col("char_start")) & (F.col("char_start") < F.col("end"))
    return s.join(p, "record_id").filter(inside & ~F.col("author_key").eqNullSafe(F.col("post_author"))).select("story_id")


# ------------------------------------------------------------------------------- codes
def unlisted_values(codes: DataFrame, dim_value: DataFrame) -> DataFrame:
    """Code values that are neither listed, ``not_stated`` nor ``other:`` with a text."""
    free = F.col("value").startswith("other:") & (F.length("value") > 6)
    open_ = codes.filter((F.col("value") != "not_stated") & ~free)
    return open_.join(dim_value.select("question", "value"), ["question", "value"], "left_anti").groupBy(
        "question", "value"
    ).agg(F.count("*").alias("rows"))


def missing_questions(stories: DataFrame, codes: DataFrame, dim_question: DataFrame) -> DataFrame:
    """Questions a story was asked and has no row for."""
    return questions_asked(stories, dim_question).join(
        codes.select("story_id", "question").distinct(), ["story_id", "question"], "left_anti"
    )


def broken_derivations(spine: DataFrame, codes: DataFrame) -> DataFrame:
    """Stories whose owner or node does not follow from their stage, codes and outcome."""
    maps = code_maps(codes.filter(F.col("question").isin("5.4", "7.2")))
    rows = spine.join(maps, "story_id", "left").withColumn("codes", F.coalesce("codes", F.create_map().cast(CODES)))
    stage, outcome = F.col("primary_stage"), F.col("outcome")
    owner = ru.failure_owner(stage)
    node = ru.metric_node(stage, F.col("codes"), outcome)
    return rows.select(
        "story_id",
        (~F.col("failure_owner").eqNullSafe(owner)).alias("owner_differs"),
        (~F.col("metric_node").eqNullSafe(node)).alias("node_differs"),
    ).filter("owner_differs or node_differs")


def videos_not_adjacent(stories: DataFrame, spine: DataFrame) -> DataFrame:
    return stories.join(spine.filter("media_type = 'video'").select("story_id"), "story_id", "left_semi").filter(
        "bucket <> 'adjacent'"
    ).select("story_id")


def mixed_versions(runs: DataFrame, version: str = "codebook_version") -> DataFrame:
    """Stages whose runs used more than one codebook version."""
    return runs.filter(F.col(version).isNotNull()).groupBy("stage").agg(
        F.count_distinct(version).alias("versions")
    ).filter("versions > 1")


# ------------------------------------------------------------------------------- collection
def field_survival(records: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Per source: how many rows kept their author, date and posts, and the mean text length."""
    kept = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    return (
        records.groupBy("source")
        .agg(
            F.count("*").alias("n"),
            kept("author_key").alias("authors"),
            kept("created_at").alias("dates"),
            F.count("posts").alias("threads"),
            F.avg(F.length("text_clean")).alias("mean_length"),
        )
        .withColumn("hollow", (F.col("authors") < at_least) | (F.col("dates") < at_least))
    )


def truncated_texts(
    records: DataFrame,
    checked: DataFrame | None = None,
    caps: Sequence[int] = tuple(vocab.TRUNCATION_CAPS),
    platform_max: Mapping[str, int] = vocab.PLATFORM_MAX,
    text: str = "text_raw",
) -> DataFrame:
    """Records that look cut: a read-more ending or exactly a round cap.

    Records in ``checked`` (native_id) were found whole; a platform's own maximum is not a cut.
    """
    ending = F.lit(False)
    trimmed = F.regexp_replace(F.col(text), "(?U)\\s+\\z", "")
    for e in vocab.TRUNCATION_ENDINGS:
        ending = ending | trimmed.endswith(e)
    size = F.length(text)
    allowed = F.coalesce(size == ru.lookup(dict(platform_max), F.col("source")), F.lit(False))
    bad = records.filter((ending | size.isin(list(caps))) & ~allowed)
    if checked is not None:
        bad = bad.join(checked.select("native_id"), "native_id", "left_anti")
    return bad.select("record_id", "source", size.alias("length"), ending.alias("cut_marker"))


# ------------------------------------------------------------------------------- results
def unbalanced_sources(funnel: DataFrame) -> DataFrame:
    """Sources whose collected records are not kept plus excluded."""
    n = lambda step: F.sum(F.when(F.col("step") == step, F.col("n")))
    excluded = F.sum(F.when(F.col("step").startswith("excluded:"), F.col("n")).otherwise(0))
    return funnel.groupBy("source").agg(n("collected").alias("collected"), n("kept").alias("kept"), excluded.alias("excluded")).filter(
        "collected <> kept + excluded"
    )


def impossible_counts(result: DataFrame) -> DataFrame:
    """Result rows without a run, or whose count exceeds its denominator."""
    bad = F.col("run_id").isNull() | (F.col("run_id") == "") | (F.col("n") > F.col("denom")) | (F.col("n") < 0)
    return result.filter(F.coalesce(bad, F.lit(True)))


def exclusion_identity(records: DataFrame, exclusions: DataFrame) -> DataFrame:
    """``total, kept, excluded, balanced`` over all records."""
    out = mk.record_marks(exclusions).select("record_id").distinct().withColumn("out", F.lit(1))
    return (
        records.select("record_id").join(out, "record_id", "left")
        .agg(F.count("*").alias("total"), F.count_if(F.col("out").isNull()).alias("kept"), F.count("out").alias("excluded"))
        .withColumn("balanced", F.col("total") == F.col("kept") + F.col("excluded"))
    )


# ------------------------------------------------------------------------------- codebook
def codebook_problems(dim_question: DataFrame, dim_value: DataFrame, nodes: Sequence[str], questions: int) -> DataFrame:
    """What is wrong with a codebook: ``question, problem``. A sound codebook gives no rows."""
    problem = lambda df, text: df.select("question", F.lit(text).alias("problem"))
    q = dim_question
    stage_of = F.split_part("question", F.lit("."), F.lit(1))
    blank = F.lit(False)
    for c in ("block", "select", "text", "plain", "metric_node"):
        blank = blank | F.col(c).isNull() | (F.col(c) == "")
    per = dim_value.groupBy("question").agg(
        F.count("*").alias("n"),
        F.count_distinct("value").alias("distinct"),
        F.count_if(F.col("value").isin("not_stated", "other")).alias("fixed"),
    )
    parts = [
        problem(repeated_keys(q, ["question"]), "question id is repeated"),
        problem(q.filter(stage_of != F.col("stage")), "sits under another stage"),
        problem(q.filter(blank), "a field is missing"),
        problem(q.filter(~F.col("block").isin(vocab.BLOCKS)), "unknown block"),
        problem(q.filter(~F.col("select").isin("single", "multi")), "select is not single or multi"),
        problem(q.filter(~F.col("metric_node").isin(list(nodes))), "unknown metric node"),
        problem(q.filter((F.col("stage") == "5") & ~F.col("inferred")), "stage 5 is not inferred"),
        problem(q.join(per, "question", "left_anti"), "has no values"),
        problem(per.filter("fixed <> 2"), "needs not_stated and other"),
        problem(per.filter("n - fixed < 2"), "fewer than two substantive values"),
        problem(per.filter("n <> distinct"), "a value is repeated"),
        q.agg(F.count("*").alias("n")).filter(F.col("n") != questions).select(
            F.lit("_all").alias("question"), F.lit("wrong number of questions").alias("problem")
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaking_texts(records: DataFrame, column: str = "text_clean") -> DataFrame:
    """Records that still show personal data."""
    return records.withColumn("kinds", tx.leaks(F.col(column))).filter(F.size("kinds") > 0).select("record_id", "kinds")
