"""Queries on counts: funnels, profiles, coverage, cross-tabs, derived measures, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnote import vocab
from fieldnote.operators import crosstab as ct
from fieldnote.operators import funnel, ledger
from fieldnote.operators import marks as mk
from fieldnote.plans import standins as st
from fieldnote.plans.catalog_clean import _CLEANING, cleaning_marks
from fieldnote.plans.registry import query

S = SparkSession
T = st.with_tables
LIVE = {"live": "SELECT * FROM stories WHERE day_no <> 31"}
CODED = {**LIVE, "sp": "SELECT * FROM live WHERE population IN ('core', 'adjacent')"}


def spine(spark: S, d: str) -> DataFrame:
    s = st.stories(spark, d)
    return mk.live_stories(s, st.story_exclusions(s))


def _records_of_stories(spark: S, d: str) -> DataFrame:
    return st.stories(spark, d).select("record_id", "source").distinct()


@query(
    "story_funnel",
    T("stories", """SELECT step, step_order, source, n, denom, n_authors FROM (
        SELECT unnest([{'step': 'stories', 'step_order': 100, 'n': n0, 'n_authors': a0}, {'step': 'stories:core', 'step_order': 101, 'n': n1, 'n_authors': a1},
                       {'step': 'stories:adjacent', 'step_order': 102, 'n': n2, 'n_authors': a2}, {'step': 'stories:irrelevant', 'step_order': 103, 'n': n3, 'n_authors': a3}], recursive := true), source, n0 AS denom
        FROM (SELECT coalesce(source, '_all') AS source, count(*) AS n0, count(DISTINCT author_key) AS a0,
                count(*) FILTER (bucket = 'core') AS n1, count(DISTINCT author_key) FILTER (bucket = 'core') AS a1,
                count(*) FILTER (bucket = 'adjacent') AS n2, count(DISTINCT author_key) FILTER (bucket = 'adjacent') AS a2,
                count(*) FILTER (bucket = 'irrelevant') AS n3, count(DISTINCT author_key) FILTER (bucket = 'irrelevant') AS a3
              FROM live GROUP BY GROUPING SETS ((source), ())))""", LIVE),
)
def story_funnel(spark: S, d: str) -> DataFrame:
    s = st.stories(spark, d)
    rows = funnel.story_funnel(s.drop("source"), _records_of_stories(spark, d), st.story_exclusions(s), "r")
    return rows.drop("run_id")


_PROFILE = """SELECT source, min(collect_method) AS collect_method, count(*) AS n_records, count(DISTINCT author_key) AS n_authors,
       0 AS n_threads, count(created_at) AS n_dated, min(created_at) AS earliest, max(created_at) AS latest,
       count(*) FILTER (record_id NOT IN (SELECT record_id FROM ex)) AS n_kept, CAST(0 AS DOUBLE) AS collect_usd
FROM records GROUP BY source"""


@query("source_profile", T("records marks", _PROFILE, _CLEANING))
def source_profile(spark: S, d: str) -> DataFrame:
    rows = funnel.source_profile(st.records(spark, d), cleaning_marks(spark, d), st.runs(spark, d), "r")
    return rows.drop("run_id")


@query("spend_by_source", "SELECT event_type AS source, round(sum(value / 100), 4) AS collect_usd FROM events GROUP BY event_type")
def spend_by_source(spark: S, d: str) -> DataFrame:
    return funnel.spend_by_source(st.runs(spark, d)).select("source", F.round("collect_usd", 4).alias("collect_usd"))


@query(
    "method_share",
    T("records", """SELECT collect_method, n_records, CAST(sum(n_records) OVER () AS BIGINT) AS denom, n_records / n_authors AS records_per_person, n_records < 30 AS under_floor
       FROM (SELECT collect_method, CAST(sum(n) AS BIGINT) AS n_records, sum(a) AS n_authors FROM
         (SELECT source, min(collect_method) AS collect_method, count(*) AS n, count(DISTINCT author_key) AS a FROM records GROUP BY source) GROUP BY collect_method)"""),
)
def method_share(spark: S, d: str) -> DataFrame:
    profile = funnel.source_profile(st.records(spark, d), st.no_marks(spark), st.runs(spark, d), "r")
    return funnel.method_share(profile)


@query(
    "author_dominance",
    T("stories", """SELECT source, CAST(sum(n) AS BIGINT) AS denom, max(n) AS n, max(n) / sum(n) AS top_share, max(n) / sum(n) > 0.05 AS dominated
       FROM (SELECT source, author_key, count(*) AS n FROM stories GROUP BY ALL) GROUP BY source HAVING sum(n) >= 100"""),
)
def author_dominance(spark: S, d: str) -> DataFrame:
    return funnel.author_dominance(st.stories(spark, d))


@query(
    "term_hits",
    """WITH r AS (SELECT c_custkey AS id, n_name AS source, c_mktsegment AS term, c_acctbal < 0 AS out FROM customer JOIN nation ON c_nationkey = n_nationkey),
            k AS (SELECT o_custkey AS id, count(*) AS core FROM orders WHERE o_orderstatus = 'F' AND day(o_orderdate) <> 31 GROUP BY o_custkey)
       SELECT term, coalesce(source, '_all') AS source, count(*) AS records, count(*) FILTER (NOT out) AS kept, CAST(coalesce(sum(core), 0) AS BIGINT) AS core_stories
       FROM r LEFT JOIN k USING (id) GROUP BY GROUPING SETS ((term, source), (term))""",
)
def term_hits(spark: S, d: str) -> DataFrame:
    c, n = st.read(spark, d, "customer"), st.read(spark, d, "nation")
    r = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("record_id"), F.col("n_name").alias("source"), F.col("c_mktsegment").alias("collect_query"), "c_acctbal"
    )
    s = st.stories(spark, d)
    record_out = r.filter("c_acctbal < 0").select(
        "record_id", F.lit(None).cast("string").alias("story_id"), "source", F.lit("clean").alias("stage"),
        F.lit("too_short").alias("reason"), F.lit("").alias("detail"), F.lit("r").alias("run_id"),
    )
    return funnel.lexicon_hits(r, s, record_out.unionByName(st.story_exclusions(s)))


# ------------------------------------------------------------------------------- coverage
_ASKED = {
    **LIVE,
    "per_story": "SELECT question, source, story_id, count(*) FILTER (value <> 'not_stated') AS said FROM codes JOIN live USING (story_id) GROUP BY ALL",
    "per": "SELECT question, coalesce(source, '_all') AS source, count(*) AS asked, count(*) FILTER (said > 0) AS n_coded FROM per_story GROUP BY GROUPING SETS ((question, source), (question))",
    "cov": """SELECT question, p.source, q.stage, q.block, n_coded, asked - n_coded AS n_not_stated, n_coded / asked AS coverage,
                CASE WHEN q.block = 'S' OR (asked - n_coded) / asked <= 0.85 THEN 'coded' ELSE 'register' END AS disposition
              FROM per p JOIN dim_question q USING (question)
              UNION ALL SELECT question, '_all', stage, block, 0, 0, NULL, 'register' FROM dim_question WHERE question NOT IN (SELECT question FROM per)""",
}


def _coverage(spark: S, d: str) -> DataFrame:
    return ct.coverage(st.codes(spark, d), spine(spark, d).select("story_id", "source"), st.dim_question(spark), "r")


@query("coverage", T("stories codes dim_question", "SELECT * FROM cov", _ASKED))
def coverage(spark: S, d: str) -> DataFrame:
    return _coverage(spark, d).drop("run_id")


@query(
    "interview_register",
    T("stories codes dim_question", """SELECT question, stage, 'wording of ' || question AS text, 'plain ' || question AS plain, n_coded || ' of ' || (n_coded + n_not_stated) AS answered
       FROM cov WHERE source = '_all' AND disposition = 'register'""", _ASKED),
)
def interview_register(spark: S, d: str) -> DataFrame:
    return ct.interview_register(_coverage(spark, d), st.dim_question(spark))


@query(
    "answer_concentration",
    T("codes", """SELECT question, value AS top_value, round_even(n / total, 3) AS top_share, n / total > 0.85 AS degenerate FROM (
         SELECT *, sum(n) OVER (PARTITION BY question) AS total, row_number() OVER (PARTITION BY question ORDER BY n DESC, value) AS r
         FROM (SELECT question, value, count(*) AS n FROM codes WHERE value <> 'not_stated' GROUP BY ALL)) WHERE r = 1"""),
)
def answer_concentration(spark: S, d: str) -> DataFrame:
    return ct.concentration(st.codes(spark, d))


# ------------------------------------------------------------------------------- cross-tabs
_FIELDS = ["primary_stage", "outcome", "media_type", "source", "photo_class"]
_LONG = {
    **CODED,
    "field_values": " UNION ALL ".join(f"SELECT story_id, '{f}' AS dim, CAST({f} AS VARCHAR) AS val FROM sp" for f in _FIELDS),
    "code_values": "SELECT c.story_id, 'q:' || question AS dim, value AS val FROM (SELECT DISTINCT story_id, question, value FROM codes) c JOIN sp USING (story_id)",
    "cells": """SELECT story_id, dim, val FROM field_values UNION ALL SELECT story_id, dim, val FROM code_values""",
    "split": """SELECT c.story_id, s.author_key, s.population || '.' || c.dim AS dim_a, c.val AS val_a, x.b AS dim_b, x.v AS val_b
                FROM cells c JOIN sp s USING (story_id), LATERAL (SELECT unnest(
                  CASE WHEN c.dim = 'photo_class' THEN [{'b': '_all', 'v': '_all'}]
                  ELSE [{'b': 'photo_class', 'v': '_all'}, {'b': 'photo_class', 'v': s.photo_class}]
                    || CASE WHEN c.dim = 'primary_stage' THEN [{'b': 'source', 'v': '_all'}, {'b': 'source', 'v': s.source}]
                            WHEN c.dim IN ('q:3.2', 'q:9.4') THEN [{'b': 'outcome', 'v': '_all'}, {'b': 'outcome', 'v': s.outcome}] ELSE [] END END) AS x)""",
    "den": "SELECT dim_a, dim_b, val_b, count(DISTINCT story_id) AS denom FROM split GROUP BY ALL",
    "xt": """SELECT dim_a, val_a, dim_b, val_b, count(*) AS n, any_value(denom) AS denom, count(DISTINCT author_key) AS n_authors
             FROM split JOIN den USING (dim_a, dim_b, val_b) WHERE NOT (dim_a LIKE '%.q:%' AND val_a = 'not_stated') GROUP BY dim_a, val_a, dim_b, val_b""",
}


def crosstab_rows(spark: S, d: str) -> DataFrame:
    return ct.crosstab(spine(spark, d), st.story_codes(spark, d), "r", fields=_FIELDS)


@query("crosstab", T("stories codes", "SELECT * FROM xt", _LONG))
def crosstab(spark: S, d: str) -> DataFrame:
    return crosstab_rows(spark, d).drop("run_id")


@query(
    "headline_values",
    T("stories codes", """SELECT dim_a, dim_b, val_a, n, denom, n_authors FROM (SELECT *, row_number() OVER (PARTITION BY dim_a, dim_b ORDER BY n DESC, val_a) AS r
       FROM xt WHERE val_b = '_all' AND val_a NOT IN ('1', '9', '10')) WHERE r = 1""", _LONG),
)
def headline_values(spark: S, d: str) -> DataFrame:
    return ct.headline(crosstab_rows(spark, d))


@query(
    "share_of_answered",
    T("stories codes dim_question", """SELECT dim_a, val_a, n, denom, of_said, n / of_said AS share_of_said FROM (
         SELECT x.*, c.n_coded AS of_said FROM xt x JOIN cov c ON c.source = '_all' AND c.question = split_part(x.dim_a, '.q:', 2) WHERE x.val_b = '_all' AND x.dim_a LIKE '%.q:%')
       WHERE n > 0 AND n <= of_said AND of_said < denom""", {**_LONG, **{k: v for k, v in _ASKED.items() if k != "live"}}),
)
def share_of_answered(spark: S, d: str) -> DataFrame:
    return ct.share_of_answered(crosstab_rows(spark, d), _coverage(spark, d))


# ------------------------------------------------------------------------------- derived measures
_FAM = st._sql_list(vocab.CUE_FAMILIES)


def _family_sql(metric: str, question: str, family: str) -> str:
    return f"""SELECT '{metric}' AS metric, key, population, coalesce(n, 0) AS n, denom, coalesce(n_authors, 0) AS n_authors FROM
      (SELECT population, count(DISTINCT story_id) AS denom, unnest({_FAM}) AS key FROM codes JOIN live USING (story_id) WHERE question = '{question}' GROUP BY population)
      LEFT JOIN (SELECT population, {family} AS key, count(DISTINCT story_id) AS n, count(DISTINCT author_key) AS n_authors FROM codes JOIN live USING (story_id)
        WHERE question = '{question}' AND {family} IS NOT NULL GROUP BY ALL) USING (population, key)"""


_HEAD = "split_part(value, ':', 1)"
_CUES = " UNION ALL ".join(
    [
        _family_sql("cue_remembered", "2.1", _HEAD),
        _family_sql("cue_forgotten", "2.4", st.sql_map(vocab.FORGOTTEN_FAMILY, "value")),
        _family_sql("cue_wrong", "2.2", f"CASE WHEN accuracy = 'certain_wrong' THEN {_HEAD} END"),
        """SELECT 'certain_wrong', '_all', population, count(DISTINCT CASE WHEN accuracy = 'certain_wrong' THEN story_id END), count(DISTINCT story_id),
                  count(DISTINCT CASE WHEN accuracy = 'certain_wrong' THEN author_key END) FROM codes JOIN live USING (story_id) WHERE question = '2.2' GROUP BY population""",
    ]
)


@query("cue_matrix", T("stories codes", _CUES, LIVE))
def cue_matrix(spark: S, d: str) -> DataFrame:
    return ct.cue_matrix(st.story_codes(spark, d, questions=ct.MEASURED), spine(spark, d))


def _rate_sql(metric: str, question: str, hit: str) -> str:
    return f"""SELECT '{metric}' AS metric, '_all' AS key, population, count(DISTINCT CASE WHEN {hit} THEN story_id END) AS n, count(DISTINCT story_id) AS denom,
                 count(DISTINCT CASE WHEN {hit} THEN author_key END) AS n_authors FROM codes JOIN live USING (story_id) WHERE question = '{question}' GROUP BY population"""


_PIVOT = "(question = '6.7' AND value NOT IN ('not_stated', 'ignore_it')) OR (question = '7.2' AND value = 'anchor_and_pivot') OR (question = '9.1' AND value = 'path:anchor_and_pivot')"
_BEHAVIOURS = " UNION ALL ".join(
    [
        _rate_sql("results_as_cues", "6.5", "value NOT IN ('not_stated', 'nothing')"),
        f"""SELECT 'anchor_and_pivot', '_all', population, count(*) FILTER (p), count(*), count(DISTINCT author_key) FILTER (p)
            FROM (SELECT *, story_id IN (SELECT story_id FROM codes WHERE {_PIVOT}) AS p FROM live) GROUP BY population""",
        "SELECT 'workaround', '_all', population, count(*) FILTER (workaround), count(*), count(DISTINCT author_key) FILTER (workaround) FROM live GROUP BY population",
        """SELECT 'fallback', key, population, coalesce(n, 0), denom, coalesce(n_authors, 0) FROM (SELECT population, count(DISTINCT story_id) AS denom FROM codes JOIN live USING (story_id) WHERE question = '9.4' GROUP BY population)
           CROSS JOIN (SELECT DISTINCT replace(value, 'fallback:', '') AS key FROM codes WHERE question = '9.4' AND value LIKE 'fallback:%')
           LEFT JOIN (SELECT population, replace(value, 'fallback:', '') AS key, count(DISTINCT story_id) AS n, count(DISTINCT author_key) AS n_authors FROM codes JOIN live USING (story_id)
             WHERE question = '9.4' AND value LIKE 'fallback:%' GROUP BY ALL) USING (population, key)""",
        _rate_sql("preventive_habit", "10.2", "value <> 'not_stated'"),
    ]
)


@query("behaviour_rates", T("stories codes", _BEHAVIOURS, LIVE))
def behaviour_rates(spark: S, d: str) -> DataFrame:
    return ct.behaviour_rates(st.story_codes(spark, d, questions=ct.MEASURED), spine(spark, d))


_JS = """SELECT 'js_divergence' AS metric, source AS key, population, round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 4) AS value,
       any_value(sn) AS n, any_value(denom) AS denom, any_value(n_authors) AS n_authors
  FROM (SELECT s.population, s.source, s.sn, s.n_authors, t.denom, coalesce(c.n, 0) / s.sn AS p, v.pn / t.denom AS q
        FROM (SELECT population, source, count(*) AS sn, count(DISTINCT author_key) AS n_authors FROM live GROUP BY ALL) s
        JOIN (SELECT population, count(*) AS denom FROM live GROUP BY ALL) t USING (population)
        JOIN (SELECT population, primary_stage, count(*) AS pn FROM live GROUP BY ALL) v USING (population)
        LEFT JOIN (SELECT population, source, primary_stage, count(*) AS n FROM live GROUP BY ALL) c ON c.population = s.population AND c.source = s.source AND c.primary_stage = v.primary_stage
        WHERE s.sn >= 10) GROUP BY source, population"""


@query("source_divergence", T("stories", _JS, LIVE))
def source_divergence(spark: S, d: str) -> DataFrame:
    return ct.source_divergence(spine(spark, d)).drop("note")


def derived_rows(spark: S, d: str) -> DataFrame:
    # the codes that the measures look at, and of those the ones that name a fallback, are worked out apart
    return ct.derived(st.story_codes(spark, d, questions=ct.MEASURED), spine(spark, d), run_id="r", fallbacks=st.story_codes(spark, d, questions=["9.4"]))


@query(
    "derived_measures",
    T("stories codes", f"""SELECT metric, key, population, round(n / denom, 6) AS value, n, denom, n_authors FROM ({_CUES} UNION ALL {_BEHAVIOURS}) WHERE population IN ('core', 'adjacent') AND denom > 0
       UNION ALL SELECT metric, key, population, value, n, denom, n_authors FROM ({_JS}) WHERE population IN ('core', 'adjacent')""", LIVE),
)
def derived_measures(spark: S, d: str) -> DataFrame:
    return derived_rows(spark, d).select("metric", "key", "population", F.round("value", 6).alias("value"), "n", "denom", "n_authors")


@query(
    "free_text_rate",
    T("codes", """SELECT question, count(*) AS answered, count(*) FILTER (value LIKE 'other:%') AS other, count(*) FILTER (value LIKE 'other:%') / count(*) AS rate
                  FROM codes WHERE value <> 'not_stated' AND question <> '10.3' GROUP BY question HAVING count(*) >= 10"""),
)
def free_text_rate(spark: S, d: str) -> DataFrame:
    return ct.other_rate(st.codes(spark, d))


@query(
    "block_yield",
    T("codes dim_question", """SELECT block, count(*) AS n, count(*) FILTER (value <> 'not_stated') AS stated, count(*) FILTER (value <> 'not_stated') / count(*) AS "yield"
                               FROM codes JOIN dim_question USING (question) WHERE question <> '10.3' GROUP BY block"""),
)
def block_yield(spark: S, d: str) -> DataFrame:
    return ct.block_yield(st.codes(spark, d), st.dim_question(spark))


# ------------------------------------------------------------------------------- ledgers
_COST = """CAST(round(CAST(CASE model WHEN 'gpt-5' THEN ((input_tokens - cached_tokens) * 1.25::DOUBLE + cached_tokens * 0.125::DOUBLE + output_tokens * 10.0::DOUBLE) / 1e6
  WHEN 'gpt-5-mini' THEN ((input_tokens - cached_tokens) * 0.25::DOUBLE + cached_tokens * 0.025::DOUBLE + output_tokens * 2.0::DOUBLE) / 1e6
  WHEN 'gpt-5-nano' THEN ((input_tokens - cached_tokens) * 0.05::DOUBLE + cached_tokens * 0.005::DOUBLE + output_tokens * 0.4::DOUBLE) / 1e6 ELSE 0::DOUBLE END * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS DECIMAL(18, 9)), 6) AS DOUBLE)"""


@query(
    "stage_costs",
    T("runs", f"""SELECT coalesce(stage, '_all') AS stage, count(*) AS runs, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens,
                    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum({_COST}), 4) AS cost_usd FROM runs GROUP BY GROUPING SETS ((stage), ())"""),
)
def stage_costs(spark: S, d: str) -> DataFrame:
    return ledger.stage_costs(st.runs(spark, d)).withColumn("cost_usd", F.round("cost_usd", 4))


@query(
    "budget_status",
    T("runs", f"""SELECT run_id, round(committed_usd, 6) AS committed_usd, over_estimate,
                    CASE WHEN committed_usd + estimate_usd > 21.0 OR over_estimate THEN 'halted_budget' ELSE 'ok' END AS status FROM (
                    SELECT *, coalesce(sum(cost) OVER (ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS committed_usd, estimate_usd > 0 AND cost > 1.5 * estimate_usd AS over_estimate
                    FROM (SELECT *, {_COST} AS cost FROM runs))"""),
)
def budget_status(spark: S, d: str) -> DataFrame:
    rows = ledger.budget_status(ledger.with_cost(st.runs(spark, d)))
    return rows.select("run_id", F.round("committed_usd", 6).alias("committed_usd"), "over_estimate", "status")


@query(
    "unaccounted_runs",
    T("runs", f"""SELECT run_id FROM (SELECT *, {_COST} AS cost FROM runs) WHERE model IS NOT NULL AND estimate_usd > 0 AND cost > 1.5 * estimate_usd AND stage <> 'collect-signup'"""),
)
def unaccounted_runs(spark: S, d: str) -> DataFrame:
    return ledger.unaccounted_runs(ledger.with_cost(st.runs(spark, d)))


@query(
    "projected_cost",
    """SELECT count(*) AS records, count(*) AS requests, CAST(sum(n) AS BIGINT) AS chars, CAST(floor(count(*) * 1200 + sum(n) / 4) AS BIGINT) AS input_tokens,
         CAST(floor(count(*) * 90.5) AS BIGINT) AS output_tokens,
         round_even((floor(count(*) * 1200 + sum(n) / 4) * 0.25 + floor(count(*) * 90.5) * 2.0) / 1e6 * 0.5, 3) AS usd FROM (SELECT length(text) AS n FROM documents)""",
)
def projected_cost(spark: S, d: str) -> DataFrame:
    return ledger.projected_cost(st.records(spark, d), "gpt-5-mini", 1200, 90.5)
