"""From coders' answers to long code rows, and the rules checked over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldnote import vocab
from fieldnote.functions import rules as ru
from fieldnote.functions import text as tx
from fieldnote.operators import marks as mk

CODES = "map<string,array<string>>"
SPINE_QUESTIONS = ["1.4", "3.2", "5.4", "7.2"]
"""The questions that other spine columns follow from."""


def code_maps(codes: DataFrame) -> DataFrame:
    """One map of question to values per story, values in the order stated. A story has a bounded number of questions.

    The order is ``position`` where the rows carry it, else ``seq``; values without either are ordered by name. ``codes``
    has a row per code, or one per story with its ``codes`` as an array, which then stay in their row.
    """
    if "codes" in codes.columns:
        inside = codes.schema["codes"].dataType.elementType.names

        def values(q: Column) -> Column:
            seq = lambda c: F.coalesce(*[c[n] for n in ("position", "seq") if n in inside], F.lit(0))
            said = F.transform(F.filter("codes", lambda c: c["question"] == q), lambda c: F.struct(seq(c).alias("seq"), c["value"].alias("value")))
            return F.struct(q.alias("question"), F.transform(F.array_sort(F.array_distinct(said)), lambda x: x["value"]).alias("values"))

        asked = F.array_distinct(F.transform("codes", lambda c: c["question"]))
        return codes.filter(F.size("codes") > 0).select("story_id", F.map_from_entries(F.transform(asked, values)).alias("codes"))
    place = F.coalesce(*[F.col(c) for c in ("position", "seq") if c in codes.columns], F.lit(0))
    per = codes.groupBy("story_id", "question").agg(
        F.transform(F.array_sort(F.collect_set(F.struct(place.alias("seq"), "value"))), lambda x: x["value"]).alias("values")
    )
    return per.groupBy("story_id").agg(F.map_from_entries(F.collect_list(F.struct("question", "values"))).alias("codes"))


def canonical_values(answers: DataFrame, dim_value: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers to listed values: (codes, problems).

    ``answers``: story_id, question, position, value, other (free text of an ``other`` answer). Free text that
    spells a listed value, or its part after the colon, is that value; other free text becomes
    ``other:<slug>``. Invalid values are dropped and counted; ``not_stated`` stands only alone.
    Each code keeps its ``position`` among the story's answers; ``seq`` is published for question 7.2 alone.
    """
    slug = F.replace(F.lower(tx.squeeze(F.coalesce("other", F.lit("")))), F.lit(" "), F.lit("_"))
    # The first listing of a spelling wins, as in the question's own order.
    place = F.col("position") if "position" in dim_value.columns else F.lit(0)
    listed = dim_value.select("question", "value", place.alias("p"))
    spelled = (
        listed.select("question", F.col("value").alias("spelling"), "value", "p")
        .unionByName(listed.select("question", F.element_at(F.split("value", ":"), -1).alias("spelling"), "value", "p"))
        .groupBy("question", "spelling")
        .agg(F.min(F.struct("p", "value")).alias("m"))
        .select("question", "spelling", F.col("m.value").alias("listed"))
    )
    spelled = spelled.withColumnsRenamed({"question": "sq", "spelling": "ss"})
    valid = listed.select(F.col("question").alias("vq"), F.col("value").alias("known")).distinct()
    free_text = (F.col("value") == "other") & (F.col("slug") != "")
    rows = answers.withColumn("slug", slug).join(
        spelled, (F.col("question") == F.col("sq")) & (F.col("slug") == F.col("ss")) & free_text, "left"
    )
    free = F.concat(F.lit("other:"), F.when(F.col("slug") == "", "unspecified").otherwise(F.col("slug")))
    rows = rows.withColumn(
        "code", F.when(F.col("value") == "other", F.coalesce("listed", free)).otherwise(F.col("value"))
    ).join(valid, (F.col("question") == F.col("vq")) & (F.col("code") == F.col("known")), "left")
    ok = F.col("known").isNotNull() | (F.col("code") == "not_stated") | (
        F.col("code").startswith("other:") & (F.length("code") > 6)
    )
    problems = rows.agg(
        F.count_if((F.col("value") == "other") & (F.col("slug") == "")).alias("other_without_text"),
        F.count_if(~ok).alias("invalid_value"),
    )
    # At least one row stays per (story, question): not_stated when nothing valid was said.
    said = ok & (F.col("code") != "not_stated")
    per_value = (
        rows.withColumn("code", F.when(said, F.col("code")))
        .groupBy("story_id", "question", "code")
        .agg(F.min("position").alias("position"))
    )
    w = W.partitionBy("story_id", "question")
    codes = (
        per_value.withColumn("stated", F.count("code").over(w))
        .filter(F.col("code").isNotNull() | (F.col("stated") == 0))
        .withColumn("nth", F.row_number().over(w.orderBy("position", "code")))
        .select(
            "story_id",
            "question",
            F.coalesce("code", F.lit("not_stated")).alias("value"),
            F.when(F.col("question") == "7.2", F.col("nth")).alias("seq"),
            F.col("nth").alias("position"),
        )
    )
    return codes, problems


def cue_rows(cues: DataFrame) -> DataFrame:
    """Cue judgements: one row per cue, the first judgement wins; ``not_stated`` when there is none.

    ``cues``: story_id, cues (array of struct cue, accuracy).
    """
    some = (
        cues.select("story_id", F.posexplode("cues").alias("i", "c"))
        .groupBy("story_id", F.col("c.cue").alias("value"))
        .agg(F.min_by("c.accuracy", "i").alias("accuracy"))
    )
    none = cues.filter(F.coalesce(F.size("cues"), F.lit(0)) <= 0).select(
        "story_id", F.lit("not_stated").alias("value"), F.lit(None).cast("string").alias("accuracy")
    )
    return some.unionByName(none).select("story_id", F.lit("2.2").alias("question"), "value", "accuracy")


def code_rows(codes: DataFrame, cues: DataFrame, stories: DataFrame, dim_question: DataFrame, run_id: str) -> DataFrame:
    """All code rows of a pass, with the structural source kind and the inferred flag of the question's stage.

    ``stories``: story_id, source, coding_conf.
    """
    none = F.lit(None)
    kind = stories.filter("story_id is not null").select(
        "story_id", F.lit("10.3").alias("question"), ru.source_kind(F.col("source")).alias("value"),
        none.cast("string").alias("accuracy"), none.cast("int").alias("seq"), F.col("coding_conf").alias("confidence"),
    )
    # Stories are the short side: hashed, so that codes pass through the join unsorted, and before the union, which would
    # take them from the tasks of their stories.
    known = stories.select("story_id", F.col("coding_conf").alias("confidence")).hint("shuffle_hash")
    rows = (
        codes.select("story_id", "question", "value", none.cast("string").alias("accuracy"), F.col("seq").cast("int")).join(known, "story_id")
        .unionByName(cues.select("story_id", "question", "value", "accuracy", none.cast("int").alias("seq")).join(known, "story_id"))
        .unionByName(kind)
    )
    flags = F.broadcast(dim_question.select("question", "inferred"))
    return (
        rows.join(flags, "question", "left")
        .select(
            "story_id", "question", "value", "accuracy", "seq",
            F.coalesce("inferred", F.lit(False)).alias("inferred"), "confidence", F.lit(run_id).alias("run_id"),
        )
    )


def derive_spine(coded: DataFrame, code_map: DataFrame) -> DataFrame:
    """Add the columns that follow from others: owner, node, severity, mode, urgency.

    ``coded``: story_id, primary_stage, outcome, stakes, effort, emotional_intensity and what else is kept.
    """
    rows = coded.join(code_map, "story_id", "left").withColumn("codes", F.coalesce("codes", F.create_map().cast(CODES)))
    c, stage, outcome = F.col("codes"), F.col("primary_stage"), F.col("outcome")
    return rows.withColumns(
        {
            "failure_owner": ru.failure_owner(stage),
            "metric_node": ru.metric_node(stage, c, outcome),
            "severity": ru.severity(F.col("stakes"), F.col("effort"), F.col("emotional_intensity"), outcome),
            "mode_used": ru.first_mode(c),
            "urgency": ru.first_urgency(c),
        }
    ).drop("codes", "stakes", "effort", "emotional_intensity")


def questions_asked(stories: DataFrame, dim_question: DataFrame) -> DataFrame:
    """Which questions each story is asked, from its bucket and how far it reaches."""
    rows = stories.select("story_id", F.explode(ru.blocks_for(F.col("bucket"), F.col("reaches_stage"))).alias("block"))
    return rows.join(dim_question.select("block", "question"), "block").select("story_id", "block", "question")


def demote_videos(stories: DataFrame, spine: DataFrame) -> DataFrame:
    """A story coded as video only is adjacent, whatever it was before."""
    media = spine.select("story_id", "media_type")
    rows = stories.join(media, "story_id", "left")
    moved = (F.col("media_type") == "video") & (F.col("bucket") != "adjacent")
    moved = F.coalesce(moved, F.lit(False))
    return rows.withColumn(
        "bucket_reason",
        F.when(moved, "video_out_of_scope: media_type coded video").otherwise(F.col("bucket_reason")),
    ).withColumn("bucket", ru.bucket_with_media(F.col("bucket"), F.coalesce("media_type", F.lit("")))).drop("media_type")


def recode_suspects(spine: DataFrame, codes: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Stories whose stage their own codes contradict: ``story_id, rule``.

    The quiet-success rule looks at live stories only; the stage 0 rule looks at all.
    """
    questions = ["0.1", "0.2", *vocab.NOT_A_FAILURE]
    maps = code_maps(codes.filter(F.col("question").isin(questions)))
    rows = spine.select("story_id", "primary_stage", "outcome").join(maps, "story_id", "left").withColumn(
        "codes", F.coalesce("codes", F.create_map().cast(CODES))
    )
    c, stage, outcome = F.col("codes"), F.col("primary_stage"), F.col("outcome")
    library = rows.filter(ru.stage0_without_evidence(stage, c, outcome)).select(
        "story_id", F.lit("stage0_without_evidence").alias("rule")
    )
    quiet = mk.live_stories(rows.filter(ru.success_without_failure(stage, c, outcome)), exclusions).select(
        "story_id", F.lit("success_without_failure").alias("rule")
    )
    return library.unionByName(quiet)


def collected_values(codes: DataFrame) -> DataFrame:
    """The stated values of each (story, question) as one string."""
    return (
        codes.filter("value <> 'not_stated' and question <> '10.3'")
        .groupBy("story_id", "question")
        .agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("values"))
    )


def evidence_cards(spine: DataFrame, stories: DataFrame, records: DataFrame, evidence: DataFrame, codes: DataFrame) -> DataFrame:
    """A story with its record, its coding, the quotes behind it and its stated values."""
    quotes = evidence.groupBy("story_id").agg(
        F.array_sort(F.collect_list(F.struct("field", "span"))).alias("evidence")
    )
    values = collected_values(codes).groupBy("story_id").agg(
        F.array_sort(F.collect_list(F.struct("question", "values"))).alias("answers")
    )
    return (
        stories.select("story_id", "record_id", "text")
        .join(records.select("record_id", "source"), "record_id")
        .join(spine.drop("source", "author_key", "population", "run_id"), "story_id")
        .join(quotes, "story_id", "left")
        .join(values, "story_id", "left")
    )


def residual_evidence(codes: DataFrame, spine: DataFrame, stories: DataFrame, disagreements: DataFrame, below: float = 0.6) -> DataFrame:
    """What the codebook may have missed: free-text values, unsure codings and reader disagreements."""
    others = codes.filter(F.col("value").startswith("other:") & (F.col("question") != "10.3")).select(
        F.lit("other_value").alias("kind"), "story_id", "question", "value"
    )
    unsure = spine.filter(F.col("coding_conf") < below).select("story_id", "primary_stage").join(
        stories.select("story_id", "text"), "story_id"
    ).select(F.lit("low_confidence").alias("kind"), "story_id", "primary_stage", "text")
    apart = disagreements.select(F.lit("reader_disagreement").alias("kind"), "story_id", "coded", "reader")
    return others.unionByName(unsure, allowMissingColumns=True).unionByName(apart, allowMissingColumns=True)


def valid_groups(groups: DataFrame, evidence_rows: DataFrame, at_least: int = 2) -> DataFrame:
    """Proposed groups, with only members that exist; a group needs ``at_least`` of them.

    ``groups``: group, exemplars (array of ids).
    """
    known = evidence_rows.select("story_id").distinct()
    return (
        groups.select("group", F.explode("exemplars").alias("story_id"))
        .distinct()
        .join(known, "story_id", "left_semi")
        .groupBy("group")
        .agg(F.count("*").alias("members"))
        .filter(F.col("members") >= at_least)
    )
