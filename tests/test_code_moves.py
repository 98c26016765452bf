"""How codes are moved: lines of a story as bits, codes never sorted or shuffled."""

import pytest

from fieldnote.plans import catalog_answers, registry
from fieldnote.plans import standins as st

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["block_yield", "code_rows", "coder_table"])
def test_no_row_of_a_code_is_sorted(spark, name):
    """A list of lines per story, or a join that sorts codes, would grow with the lines a task holds."""
    text = plan(registry.load()[name].job(spark, SF))
    assert not any(x in text for x in ("ObjectHashAggregate", "SortAggregate", "SortMergeJoin", "+- Sort ", "collect_"))


def test_failure_modes_and_crosstab_hash_the_stories(spark):
    for name in ("failure_modes", "crosstab"):
        text = plan(registry.load()[name].job(spark, SF))
        assert "ShuffledHashJoin [story_id" in text and "collect_" not in text


def test_claimable_differences_reads_no_lines(spark):
    assert "l_orderkey" not in plan(registry.load()["claimable_differences"].job(spark, SF))


def test_some_questions_of_a_story(spark, tmp_path):
    lines = [(1, 1, "Z", "O", 5.0, 0.01, 0.0), (1, 2, "A", "F", 5.0, 0.04, 0.06), (2, 1, None, None, None, None, None)]
    names = "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_tax double, l_discount double"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    for some in (["5.6"], ["2.1", "7.2"], ["2.2", "2.4"], ["1.4"]):
        got = {(r["story_id"], *c) for r in st.story_codes(spark, str(tmp_path), True, some).collect() for c in r["codes"]}
        assert got == {tuple(r) for r in st.codes(spark, str(tmp_path), True).collect() if r["question"] in some}


def test_coverage_goes_through_the_lines_once(spark):
    text = plan(registry.load()["coverage"].job(spark, SF))
    assert len([x for x in text.splitlines() if "FileScan" in x and "l_orderkey" in x]) == 1


def test_measures_look_at_codes_where_they_are(spark):
    """The values of a story's questions come out of its row: no code is listed again by story."""
    assert "collect_set" not in plan(registry.load()["derived_measures"].job(spark, SF))


def test_questions_are_read_once_for_a_kind(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog_answers.rt, "tag_questions", lambda df, f=catalog_answers.rt.tag_questions: seen.append(df.columns) or f(df))
    tagged = catalog_answers.tagged_kinds(spark, SF)
    kinds = [c for c in catalog_answers.plans(spark, SF).columns if c != "plan_id"]
    assert "plans" in seen[0] and tagged.count() == catalog_answers.plans(spark, SF).select(kinds).distinct().count()
    assert tagged.groupBy().sum("plans").first()[0] == catalog_answers.plans(spark, SF).count()
