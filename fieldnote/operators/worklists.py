"""What is still to do: set differences and unions of ids, without fetching them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.operators import marks as mk


def union_ids(*frames: DataFrame, key: str = "story_id") -> DataFrame:
    """Distinct ids of several tables."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.unionByName(f.select(key))
    return out.distinct()


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def pending_stories(stories: DataFrame, spine: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Live stories that are neither coded nor marked by the coding stage."""
    failed = mk.story_marks(exclusions).filter("stage = 'code'")
    done = union_ids(spine, failed)
    return difference(mk.live_stories(stories, exclusions), done, "story_id")


def pending_records(records: DataFrame, stories: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Records that passed cleaning and have not been read for stories yet."""
    open_ = mk.live_records(records, exclusions, before_stage="segment")
    read = union_ids(stories, exclusions.filter("stage = 'segment'"), key="record_id")
    return difference(open_, read, "record_id")


def unconfirmed(stories: DataFrame, exclusions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Live stories no second reader has judged."""
    return difference(mk.live_stories(stories, exclusions), confirmed, "story_id")


def missing_answers(requests: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    return requests.join(answers.select(*keys), list(keys), "left_anti")


def members_of_any(codes: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Stories that meet at least one of several rules: ``story_id`` and which rules it met."""
    flags = [F.bool_or(F.expr(p)).alias(name) for name, p in predicates.items()]
    rows = codes.groupBy("story_id").agg(*flags)
    any_of = F.lit(False)
    for name in predicates:
        any_of = any_of | F.coalesce(F.col(name), F.lit(False))
    return rows.filter(any_of)


def members_of_all(codes: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Stories that meet every one of several rules."""
    flags = [F.bool_or(F.expr(p)).alias(name) for name, p in predicates.items()]
    rows = codes.groupBy("story_id").agg(*flags)
    all_of = F.lit(True)
    for name in predicates:
        all_of = all_of & F.coalesce(F.col(name), F.lit(False))
    return rows.filter(all_of).select("story_id")
