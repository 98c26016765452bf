"""Marks, guards and refreshes on literal rows."""

import pytest
from pyspark.sql import functions as F

from fieldnote.operators import agreement as ag
from fieldnote.operators import marks as mk
from fieldnote.operators import opportunity as op
from fieldnote.plans.standins import no_marks

MARK = "record_id string, story_id string, source string, stage string, reason string, detail string, run_id string"


def test_the_first_mark_of_a_stage_stays(spark):
    one = spark.createDataFrame([("a", None, "s", "clean", "too_short", "x", "r1")], MARK)
    two = spark.createDataFrame([("a", None, "s", "clean", "exact_duplicate", "y", "r2"), ("a", "a:0", "s", "clean", "no_story", "z", "r2")], MARK)
    out = mk.add_marks(mk.add_marks(no_marks(spark), one), two)
    assert {(r["record_id"], r["story_id"], r["reason"]) for r in out.collect()} == {("a", None, "too_short"), ("a", "a:0", "no_story")}
    records = spark.createDataFrame([("a", "s"), ("b", "s")], "record_id string, source string")
    assert [r["record_id"] for r in mk.live_records(records, out).collect()] == ["b"]
    assert mk.live_records(records, out, before_stage="clean").count() == 2


def test_a_gate_replaces_its_own_marks(spark):
    old = spark.createDataFrame([("a", None, "s", "prefilter", "lexicon_rejected", "x", "r1"), ("b", None, "s", "clean", "too_short", "x", "r1")], MARK)
    new = spark.createDataFrame([("c", None, "s", "prefilter", "lexicon_rejected", "x", "r2")], MARK)
    assert {r["record_id"] for r in mk.replace_stage_marks(old, "prefilter", new).collect()} == {"b", "c"}


def test_a_barred_field_stops_the_headline(spark):
    rows = spark.createDataFrame([(1,)], "x int")
    ok = spark.createDataFrame([("severity", "low_reliability"), ("primary_stage", "ok")], "field string, verdict string")
    assert op.require_reliable(rows, ok).count() == 1
    bad = spark.createDataFrame([("primary_stage", "low_reliability")], "field string, verdict string")
    with pytest.raises(Exception, match="low_reliability"):
        op.require_reliable(rows, bad).collect()


def test_refresh_keeps_the_second_coder(spark):
    c = "story_id string, field string, coder string, value array<string>"
    coding = spark.createDataFrame([("a", "f", "primary", ["old"]), ("a", "f", "secondary", ["x"])], c)
    now = spark.createDataFrame([("a", "f", "primary", ["new"]), ("b", "f", "primary", ["y"])], c)
    got = sorted((r["story_id"], r["coder"], r["value"]) for r in ag.refresh_primary(coding, now).collect())
    assert got == [("a", "primary", ["new"]), ("a", "secondary", ["x"])]


def test_kappa_edges(spark):
    rows = [("same", "a", "a")] * 3 + [("half", "a", "a"), ("half", "b", "b"), ("half", "a", "b"), ("half", "b", "a")]
    got = {r["field"]: r["value"] for r in ag.kappa_table(spark.createDataFrame(rows, "field string, a string, b string")).collect()}
    assert got == {"same": 1.0, "half": 0.0}


def test_bands_break_where_they_should(spark):
    df = spark.createDataFrame([(4, 100), (5, 100), (10, 100), (15, 100), (25, 100)], "n int, d int")
    assert [r[0] for r in df.select(op.frequency_band(F.col("n"), F.col("d"))).collect()] == [1, 2, 3, 4, 5]


def test_first_mode_and_urgency_are_the_first_stated(spark):
    from fieldnote.operators import coding as cd

    answers = [("s", "3.2", 0, "scroll", ""), ("s", "3.2", 1, "album", ""), ("s", "1.4", 0, "none", ""), ("s", "1.4", 1, "urgency:soon", ""), ("s", "1.4", 2, "urgency:later", "")]
    listed = [("3.2", "scroll"), ("3.2", "album"), ("1.4", "none"), ("1.4", "urgency:soon"), ("1.4", "urgency:later")]
    rows = spark.createDataFrame(answers, "story_id string, question string, position int, value string, other string")
    codes, _ = cd.canonical_values(rows, spark.createDataFrame(listed, "question string, value string"))
    coded = spark.createDataFrame([("s", "3", "found", 1, 1, 1)], "story_id string, primary_stage string, outcome string, stakes int, effort int, emotional_intensity int")
    r = cd.derive_spine(coded, cd.code_maps(codes)).first()
    assert (r["mode_used"], r["urgency"]) == ("scroll", "urgency:soon")


def test_long_free_text_answers_stay_apart(spark):
    from fieldnote.operators import coding as cd

    texts = ["x" * 70 + "a", "x" * 70 + "b"]
    rows = spark.createDataFrame([("s", "2.4", i, "other", t) for i, t in enumerate(texts)], "story_id string, question string, position int, value string, other string")
    codes, _ = cd.canonical_values(rows, spark.createDataFrame([("2.4", "other")], "question string, value string"))
    assert {r["value"] for r in codes.collect()} == {f"other:{t}" for t in texts}


def test_measures_read_their_tables_once_or_twice(spark):
    import re

    from fieldnote.plans import registry

    from .conftest import SF

    for name, most in (("derived_measures", 2), ("cue_matrix", 1), ("crosstab", 1), ("reliability", 1)):
        plan = registry.load()[name].job(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"/lineitem\.parquet", plan)) <= most, name
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
