"""Rules that derive one coded column from others. ``codes`` is a map of question to its values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldnote import vocab


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def values_of(codes: Column, question: str) -> Column:
    return F.coalesce(F.try_element_at(codes, F.lit(question)), F.array().cast("array<string>"))


def states_beyond(codes: Column, question: str, silent: list[str]) -> Column:
    """Some value of the question is none of ``silent``."""
    return F.exists(values_of(codes, question), lambda v: ~v.isin(silent))


def failure_owner(stage: Column) -> Column:
    return lookup(vocab.FAILURE_OWNER, stage)


def source_kind(source: Column) -> Column:
    return lookup(vocab.SOURCE_KIND, source)


def metric_node(stage: Column, codes: Column, outcome: Column) -> Column:
    """The stage's node; stage 5 with a buried result, and stages 7-8 that tried again and found it, differ."""
    buried = (stage == "5") & states_beyond(codes, "5.4", ["not_stated"])
    refined = (
        stage.isin("7", "8")
        & states_beyond(codes, "7.2", ["not_stated", "quit"])
        & outcome.isin("found", "found_after_struggle")
    )
    return (
        F.when(buried, "target_ranked_visible")
        .when(refined, "found_after_refinement")
        .otherwise(lookup(vocab.STAGE_NODE, stage))
    )


def severity(stakes: Column, effort: Column, intensity: Column, outcome: Column) -> Column:
    """1-5 from three 0-2 parts and the points of the outcome."""
    total = stakes + effort + intensity + lookup(vocab.OUTCOME_POINTS, outcome)
    out = None
    for level, (low, high) in vocab.SEVERITY_SCALE.items():
        hit = total.between(low, high)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def first_mode(codes: Column) -> Column:
    return F.get(F.filter(values_of(codes, "3.2"), lambda v: v != "not_stated"), 0)


def first_urgency(codes: Column) -> Column:
    return F.get(F.filter(values_of(codes, "1.4"), lambda v: v.startswith("urgency:")), 0)


def blocks_for(bucket: Column, reaches_stage: Column) -> Column:
    """The blocks of questions a story is asked."""
    core = F.array(*[F.lit(b) for b in vocab.CORE_BLOCKS])
    partial = F.array_compact(
        F.array(F.lit("A"), F.when(reaches_stage >= 5, "C"), F.when(reaches_stage >= 7, "D"))
    )
    return F.when(bucket == "core", core).otherwise(partial)


def bucket_with_media(bucket: Column, media_type: Column) -> Column:
    return F.when(media_type == "video", "adjacent").otherwise(bucket)


def stage0_without_evidence(stage: Column, codes: Column, outcome: Column) -> Column:
    """Coded "never in the library" although it was found and nothing says it was out of reach."""
    unreachable = states_beyond(codes, "0.1", ["yes_backed_up", "not_stated"])
    wrong_data = F.exists(values_of(codes, "0.2"), lambda v: v.isin(vocab.DATA_WRONG))
    return (stage == "0") & outcome.isin("found", "found_after_struggle") & ~unreachable & ~wrong_data


def success_without_failure(stage: Column, codes: Column, outcome: Column) -> Column:
    """Coded as a failure although it was found at once and no failure is stated."""
    failed = F.lit(False)
    for question, fine in vocab.NOT_A_FAILURE.items():
        failed = failed | states_beyond(codes, question, ["not_stated", *fine])
    return stage.isin("2", "4", "5") & (outcome == "found") & ~failed
