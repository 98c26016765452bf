"""Queries on questions and answers: ranked texts, facts, routing, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnote import rulebook as rb
from fieldnote import vocab
from fieldnote.operators import audit as au
from fieldnote.operators import retrieval as rt
from fieldnote.plans import standins as st
from fieldnote.plans.catalog_counts import crosstab_rows, derived_rows, spine
from fieldnote.plans.registry import query
from fieldnote.session import checkpointed

S = SparkSession
T = st.with_tables
_STOP = st._sql_list(vocab.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+|[\\x{{0900}}-\\x{{097F}}]+'), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x))"

# ------------------------------------------------------------------------------- ranked texts
_BM = {
    "dt": f"SELECT lang AS pool, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN len({_TOKENS}) > 0 THEN {_TOKENS} ELSE ['_'] END AS t, CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS priority FROM documents",
    "pools": "SELECT pool, count(*) AS docs, avg(len(t)) AS avgdl, max(priority) AS anyp FROM dt GROUP BY pool",
    "tf": "SELECT pool, doc_id, priority, len(t) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM dt) GROUP BY ALL",
    "df": "SELECT pool, term, count(*) AS n, any_value(docs) AS docs, any_value(avgdl) AS avgdl, ln(any_value(docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN pools USING (pool) GROUP BY pool, term",
    "mean": "SELECT pool, avg(idf) AS m FROM df GROUP BY pool",
    "qq": f"SELECT pool, CAST(item_id AS VARCHAR) || pool AS query_id, CASE WHEN len({_TOKENS}) > 0 THEN {_TOKENS} ELSE ['_'] END AS t FROM benchmark, (SELECT pool FROM pools)",
    "qt": "SELECT pool, query_id, term, count(*) AS qf FROM (SELECT pool, query_id, unnest(t) AS term FROM qq) GROUP BY ALL",
}


def _pooled(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    docs = st.read(spark, d, "documents").select(
        F.col("lang").alias("pool_id"), F.col("doc_id").cast("string").alias("doc_id"), "text", F.when(F.col("source") == "src1", 1).otherwise(0).alias("priority")
    )
    langs = docs.groupBy("pool_id").agg(F.count("*").alias("k")).groupBy().agg(F.collect_list("pool_id").alias("pools")).withColumn("one", F.lit(1))
    b = st.read(spark, d, "benchmark").withColumn("one", F.lit(1)).join(F.broadcast(langs), "one")
    queries = b.select(F.explode("pools").alias("pool_id"), "item_id", "text")
    return docs, queries.select("pool_id", F.concat(F.col("item_id").cast("string"), "pool_id").alias("query_id"), "text")


@query(
    "ranked_texts",
    T("records", """SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, score DESC, doc_id) AS rank FROM (
          SELECT q.query_id, d.pool, d.doc_id, d.priority, coalesce(s.score, 0) AS score FROM qq q JOIN dt d USING (pool) LEFT JOIN (
            SELECT query_id, doc_id, round(sum(qf * CASE WHEN idf < 0 THEN 0.25::DOUBLE * m ELSE idf END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * dl / avgdl))), 9) AS score
            FROM qt JOIN tf USING (pool, term) JOIN df USING (pool, term) JOIN mean USING (pool) GROUP BY query_id, doc_id) s ON s.query_id = q.query_id AND s.doc_id = d.doc_id)) JOIN pools USING (pool)
        WHERE rank <= 6 + CASE WHEN anyp > 0 THEN 2 ELSE 0 END""", _BM),
)
def ranked_texts(spark: S, d: str) -> DataFrame:
    """Every benchmark passage searched in the documents of each language."""
    docs, queries = _pooled(spark, d)
    return rt.bm25_search(rt.text_index(docs.select("doc_id", "text")), docs.drop("text"), queries).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "overlapping_texts",
    T("records", """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, score DESC, doc_id) AS rank FROM (
        SELECT q.query_id, d.doc_id, 0 AS priority, CAST(len(list_intersect(list_distinct(q.t), list_distinct(d.t))) AS DOUBLE) AS score FROM qq q JOIN dt d USING (pool))) WHERE rank <= 2""",
      {k: _BM[k] for k in ("dt", "pools", "qq")}),
)
def overlapping_texts(spark: S, d: str) -> DataFrame:
    docs, queries = _pooled(spark, d)
    return rt.overlap_search(rt.text_index(docs.select("doc_id", "text")), docs.drop("text").withColumn("priority", F.lit(0)), queries)


def plans(spark: S, d: str) -> DataFrame:
    """A question per customer: its words and needs follow from the customer's own columns."""
    c = st.read(spark, d, "customer")
    seg, k = F.col("c_mktsegment"), F.col("c_custkey")
    question = (
        F.when(seg == "MACHINERY", "What do people forget about receipts from India?")
        .when(seg == "BUILDING", "How many stories are there in total?")
        .when(seg == "AUTOMOBILE", "Why do people give up on sentimental photos over time?")
        .when(seg == "FURNITURE", "What is the success rate of search?")
        .otherwise("Walk me through the whole path, and which sources say so")
    )
    kinds = F.array(*[F.lit(x) for x in rb.EVIDENCE_KINDS])
    needs = F.array(F.get(kinds, F.pmod(k, F.lit(18)).cast("int")), F.get(kinds, F.pmod(k * 7 + 3, F.lit(18)).cast("int")))
    q = F.struct(
        F.when(F.col("c_acctbal") < 0, "memory").otherwise("question_values").alias("query"), F.lit("core").alias("population"),
        F.lit("").alias("dim"), F.lit("5.6").alias("question"), F.lit(5).alias("most"),
    )
    return c.select(
        k.cast("string").alias("plan_id"), question.alias("question"), F.lit("").alias("restated"), F.lit("").alias("intent"), F.lit("yes").alias("answerable"),
        F.lit(None).cast("string").alias("subject"), needs.alias("evidence_needed"), F.array(F.lit("core"), F.lit("adjacent")).alias("populations"),
        F.array().cast("array<string>").alias("photo_classes"), F.array(q).alias("queries"),
    )


_QUESTION = """CASE c_mktsegment WHEN 'MACHINERY' THEN 'what do people forget about receipts from india?' WHEN 'BUILDING' THEN 'how many stories are there in total?'
  WHEN 'AUTOMOBILE' THEN 'why do people give up on sentimental photos over time?' WHEN 'FURNITURE' THEN 'what is the success rate of search?' ELSE 'walk me through the whole path, and which sources say so' END"""
_sqlq = lambda p: p.replace("'", "''")
# RE2 has no lookahead: the one rule with it is left out, as the test questions never need it.
_SUBJECT = "CASE " + " ".join(f"WHEN regexp_matches(q, '{_sqlq(p)}') THEN '{n}'" for p, n in rb.SUBJECT_RULES if "(?!" not in p) + " END"
_TOPICS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(q, '(?i){_sqlq(p)}') THEN '{n}' END" for p, n in rb.TOPIC_RULES) + ")"
_CUTS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(q, '{_sqlq(p)}') THEN '{n}' END" for p, n in rb.MISSING_CUTS) + ")"


@query(
    "tagged_questions",
    f"""SELECT plan_id, CASE WHEN seg = 'BUILDING' THEN 'corpus' ELSE {_SUBJECT} END AS subject, regexp_matches(q, '{_sqlq(rb.ADJACENT_NEEDED)}') AS adjacent_needed, {_TOPICS} AS topics, {_CUTS} AS missing_cuts,
          regexp_matches(q, '{_sqlq(rb.OUT_OF_SCOPE)}') AS out_of_scope, CASE WHEN seg = 'MACHINERY' THEN 'utility' WHEN seg = 'AUTOMOBILE' THEN 'sentimental' ELSE '' END AS named_classes
        FROM (SELECT CAST(c_custkey AS VARCHAR) AS plan_id, c_mktsegment AS seg, {_QUESTION} AS q FROM customer)""",
)
def tagged_questions(spark: S, d: str) -> DataFrame:
    rows = rt.tag_questions(plans(spark, d))
    joined = {c: F.array_join(c, ",") for c in ("topics", "missing_cuts", "named_classes")}
    return rows.withColumns(joined).select("plan_id", "subject", "adjacent_needed", "topics", "missing_cuts", "out_of_scope", "named_classes")


def result_tables(spark: S, d: str) -> dict[str, DataFrame]:
    from fieldnote.plans.catalog_counts import _coverage, story_funnel
    from fieldnote.plans.catalog_statistics import candidate_rows, reliability

    return {
        "analysis_crosstab": crosstab_rows(spark, d),
        "analysis_derived": derived_rows(spark, d),
        "analysis_funnel": story_funnel(spark, d),
        "analysis_coverage": _coverage(spark, d),
        "analysis_reliability": reliability(spark, d),
        "analysis_opportunity": candidate_rows(spark, d),
    }


def stored_facts(spark: S, d: str) -> DataFrame:
    """The result tables are written before anything is asked of them; their size is that of a codebook."""
    return checkpointed(rt.fact_tables(result_tables(spark, d)))


_values = lambda pairs: "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ")"
_PLANS = {
    "kinds": f"SELECT * FROM {_values((q, k) for q, ks in rt.KINDS.items() for k in ks)} t(query, kind)",
    "defaults": f"SELECT * FROM {_values(rb.DEFAULT_QUERY.items())} t(kind, query)",
    "given": "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'memory' ELSE 'question_values' END AS query FROM customer",
    "asks": f"""SELECT c_custkey AS k, c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') AS named,
                  [{st._sql_list(rb.EVIDENCE_KINDS)}[1 + c_custkey % 18], {st._sql_list(rb.EVIDENCE_KINDS)}[1 + (c_custkey * 7 + 3) % 18]] AS asked FROM customer""",
    "needs": """SELECT k, unnest(kinds) AS kind, unnest(range(len(kinds))) AS i FROM (
                  SELECT k, CASE WHEN named AND NOT list_contains(asked, 'segment_split') THEN list_append(asked, 'segment_split') ELSE asked END AS kinds FROM asks)""",
    "open_": """SELECT n.k, d.query, min(i) AS i FROM needs n JOIN given g USING (k) JOIN defaults d ON d.kind = n.kind
                WHERE NOT EXISTS (SELECT 1 FROM kinds x WHERE x.query = g.query AND x.kind = n.kind) GROUP BY n.k, d.query""",
    "used": """SELECT o.k, o.query FROM open_ o JOIN needs n ON n.k = o.k AND n.i = o.i
               WHERE NOT EXISTS (SELECT 1 FROM open_ e JOIN kinds x ON x.query = e.query WHERE e.k = o.k AND x.kind = n.kind AND e.i < o.i)""",
}


@query(
    "fulfilled_plans",
    T("records", """SELECT query, 'core' AS population, count(*) AS requests FROM (SELECT k, query FROM given UNION ALL SELECT k, query FROM used) GROUP BY query""", _PLANS),
)
def fulfilled_plans(spark: S, d: str) -> DataFrame:
    rows = rt.fulfil(rt.tag_questions(plans(spark, d)))
    return rows.groupBy("query", "population").agg(F.count("*").alias("requests"))


def tagged_kinds(spark: S, d: str) -> DataFrame:
    """The kinds of plans, tagged: a question is read once for a kind, not for each of its plans."""
    return checkpointed(rt.tag_questions(rt.plan_kinds(plans(spark, d))))


@query("facts_of_plans")
def facts_of_plans(spark: S, d: str) -> DataFrame:
    """Fact rows for every plan, without the second population where the question is not about it."""
    tagged = tagged_kinds(spark, d)
    facts = rt.facts_for(rt.fulfil(tagged), stored_facts(spark, d))
    per = rt.scoped(facts, tagged).groupBy("table", "query", "plan_id").agg(F.count("*").alias("k")).join(tagged.select("plan_id", "plans"), "plan_id")
    return per.groupBy("table", "query").agg(F.sum(F.col("k") * F.col("plans")).alias("rows"), F.sum("plans").alias("plans"))


@query("routed_questions")
def routed_questions(spark: S, d: str) -> DataFrame:
    tagged = tagged_kinds(spark, d)
    facts = stored_facts(spark, d)
    got = rt.facts_for(rt.fulfil(tagged), facts)
    method = rt.method_rows(tagged.withColumns({"fields": F.array().cast("array<string>"), "questions": F.array().cast("array<string>")}), facts)
    stories = tagged.select("plan_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("story_id"))
    rows = rt.route_questions(tagged, got, stories, method).join(tagged.select("plan_id", "plans"), "plan_id")
    return rows.groupBy("route", F.array_join("unmet", ",").alias("unmet")).agg(F.sum("plans").alias("plans"))


@query(
    "rival_facts",
    T("stories", """SELECT plan_id, stage, stories FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY p) AS r FROM (
        SELECT CAST(c_custkey AS VARCHAR) AS plan_id, CAST(2 + c_nationkey % 6 AS VARCHAR) AS mine FROM customer),
        (SELECT primary_stage AS stage, count(*) AS stories, row_number() OVER (ORDER BY count(*) DESC, 'core.primary_stage=' || primary_stage) AS p FROM live WHERE population = 'core' GROUP BY primary_stage) WHERE stage <> mine) WHERE r <= 5""",
      {"live": "SELECT * FROM stories WHERE day_no <> 31"}),
)
def rival_facts(spark: S, d: str) -> DataFrame:
    c = st.read(spark, d, "customer")
    p = c.select(F.col("c_custkey").cast("string").alias("plan_id"), F.array((2 + F.col("c_nationkey") % 6).cast("string")).alias("stages"))
    rows = rt.rival_facts(p, rt.fact_tables({"analysis_crosstab": crosstab_rows(spark, d)}))
    return rows.select("plan_id", F.regexp_extract("key", "=([^@]+)@", 1).alias("stage"), "stories")


@query(
    "pool_sizes",
    T("stories codes", """SELECT stage, class, CASE WHEN any_value(k) >= 3 THEN any_value(k) ELSE count(*) END AS docs FROM (
        SELECT p.stage, p.class, count(*) FILTER (a.story_id IS NOT NULL) OVER (PARTITION BY p.stage, p.class) AS k FROM
        (SELECT DISTINCT CAST(2 + c_nationkey % 6 AS VARCHAR) AS stage, CASE WHEN c_acctbal < 0 THEN 'utility' ELSE '' END AS class FROM customer) p
        JOIN live s ON s.population = 'core' AND s.primary_stage = p.stage AND (p.class = '' OR s.photo_class = p.class)
        LEFT JOIN (SELECT DISTINCT story_id FROM codes WHERE question = '5.6' AND value <> 'not_stated') a USING (story_id)) GROUP BY stage, class""",
      {"live": "SELECT * FROM stories WHERE day_no <> 31"}),
)
def pool_sizes(spark: S, d: str) -> DataFrame:
    c = st.read(spark, d, "customer")
    empty = F.array().cast("array<string>")
    p = c.select(
        F.col("c_custkey").cast("string").alias("query_id"), F.lit("text").alias("text"), F.array(F.lit("core")).alias("populations"),
        F.array((2 + F.col("c_nationkey") % 6).cast("string")).alias("stages"),
        F.when(F.col("c_acctbal") < 0, F.array(F.lit("utility"))).otherwise(empty).alias("photo_classes"), F.lit("5.6").alias("subject_question"),
    )
    queries, docs = rt.plan_pools(p, spine(spark, d).withColumn("text", F.col("story_id")), st.codes(spark, d))
    named = p.select("query_id", F.get("stages", 0).alias("stage"), F.coalesce(F.get("photo_classes", 0), F.lit("")).alias("class"))
    pools = queries.join(named, "query_id").select("pool_id", "stage", "class").distinct()
    return docs.groupBy("pool_id").agg(F.count("*").alias("docs")).join(pools, "pool_id").select("stage", "class", "docs")


# ------------------------------------------------------------------------------- audits
# An answer per customer about its own orders. Some figures, citations and quotes are wrong by rule.
_ANS = {
    "per": """SELECT o_custkey AS id, count(*) AS d, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n FROM orders GROUP BY o_custkey""",
    "a": """SELECT CAST(id AS VARCHAR) AS answer_id, id, n, d, CAST(round_even(100 * n / d, 0) AS INT) + CASE WHEN id % 5 = 0 THEN 9 ELSE 0 END AS pct, n + CASE WHEN id % 7 = 0 THEN 1000 ELSE 0 END AS said,
                   CASE WHEN id % 3 = 0 THEN id + 100000 ELSE id END AS cited FROM per""",
}


def answers(spark: S, d: str, groups: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, rows, stories); with ``groups`` one per group of customers."""
    o = st.read(spark, d, "orders")
    if groups is not None:
        o = o.withColumn("o_custkey", F.col("o_custkey") % groups)
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    per = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("d"), F.count_if(urgent).alias("n"))
    key = F.col("id").cast("string")
    pct = F.bround(100 * F.col("n") / F.col("d"), 0).cast("int") + F.when(F.col("id") % 5 == 0, 9).otherwise(0)
    said = F.col("n") + F.when(F.col("id") % 7 == 0, 1000).otherwise(0)
    cited = F.when(F.col("id") % 3 == 0, F.col("id") + 100000).otherwise(F.col("id"))
    text = F.concat(
        F.lit("Urgent orders are "), pct.cast("string"), F.lit("% ("), F.col("n").cast("string"), F.lit(" of "), F.col("d").cast("string"),
        F.lit(") here [[analysis_orders|"), cited.cast("string"), F.lit("]].\n\nOne buyer wrote “please send order "),
        F.when(F.col("id") % 4 == 0, "quickly today").otherwise("soon thank you"), F.lit("”. There are "), said.cast("string"), F.lit(" such orders.\n\n*Shall we look closer?*"),
    )
    a = per.select(key.alias("answer_id"), text.alias("text"), F.when(F.col("id") % 11 == 0, "NONE").otherwise("FULL").alias("route"), F.lit("how urgent").alias("question"), F.lit("").alias("gap"))
    rows = per.select(
        key.alias("answer_id"), F.lit("analysis_orders").alias("table"), key.alias("key"),
        au.spoken_forms(F.array(F.col("n").cast("double"), F.col("d").cast("double"), F.col("n") / F.col("d"))).alias("values"),
        F.array(F.struct(F.col("n"), F.col("d").alias("of"))).alias("shares"), F.array().cast("array<string>").alias("labels"),
    )
    stories = per.select(key.alias("answer_id"), F.concat(F.lit("s"), key).alias("story_id"), F.lit("Hello, please send order soon — thank you; bye").alias("text"))
    stories = stories.withColumn("text", F.lit("Hello, please send order soon thank you bye"))
    return a, rows, stories


@query("citation_audit", T("records", "SELECT answer_id, 'analysis_orders[' || cited || ']' AS detail FROM a WHERE cited <> id", _ANS))
def citation_audit(spark: S, d: str) -> DataFrame:
    return au.check_citations(*answers(spark, d)).select("answer_id", "detail")


@query("arithmetic_audit", T("records", "SELECT answer_id, pct || '% (' || n || ' of ' || d AS detail FROM a WHERE abs(100 * n / d - pct) > 1.0", _ANS))
def arithmetic_audit(spark: S, d: str) -> DataFrame:
    return au.check_arithmetic(answers(spark, d)[0]).select("answer_id", "detail")


_VALS = "(SELECT list_distinct(flatten([[v, round_even(v, 1), round_even(v, 2)] || CASE WHEN v BETWEEN 0 AND 1 THEN [v * 100, round_even(v * 100, 0), round_even(v * 100, 1)] ELSE [] END for v in [n::DOUBLE, d::DOUBLE, n / d]])))"
_FREE = "(x IN (0, 1, 2, 3, 4, 5, 30, 80, 60, 300, 0.6, 1000) OR (x BETWEEN 1900 AND 2100))"


_NUMBERS = f"""SELECT answer_id, detail FROM (SELECT answer_id, x.v AS x, x.p AS p, {_VALS} AS vals, CASE WHEN x.p THEN x.v || '%' ELSE CAST(x.v AS VARCHAR) END AS detail FROM (
        SELECT *, unnest([{{'v': pct::BIGINT, 'p': true}}, {{'v': n, 'p': false}}, {{'v': d, 'p': false}}, {{'v': said, 'p': false}}]) AS x FROM a))
        WHERE NOT (NOT p AND {_FREE}) AND len(list_filter(vals, lambda c: abs(c - x) <= 0.011)) = 0"""


@query("number_audit", T("records", _NUMBERS, _ANS))
def number_audit(spark: S, d: str) -> DataFrame:
    a, rows, _ = answers(spark, d)
    return au.check_numbers(a, rows).select("answer_id", "detail")


@query("quote_audit", T("records", "SELECT answer_id, 'please send order quickly today' AS detail FROM a WHERE id % 4 = 0", _ANS))
def quote_audit(spark: S, d: str) -> DataFrame:
    return au.check_quotes(*answers(spark, d)).select("answer_id", "detail")


@query(
    "form_audit",
    T("records", """SELECT answer_id, 'refusal' AS problem, x AS detail FROM (SELECT answer_id, unnest(['cites evidence', 'states a number', 'quotes']) AS x FROM a WHERE id % 11 = 0)""", _ANS),
)
def form_audit(spark: S, d: str) -> DataFrame:
    return au.check_form(answers(spark, d)[0])


_GROUPS = {k: q.replace("o_custkey", "o_custkey % 200") for k, q in _ANS.items()}


@query("label_audit", T("records", "SELECT answer_id, pct || '% (' || n || ' of ' || d AS detail FROM a WHERE d BETWEEN 30 AND 79", _GROUPS))
def label_audit(spark: S, d: str) -> DataFrame:
    """Answers about 200 groups of customers, so that some counts are large enough for a label and some too large."""
    return au.check_labels(answers(spark, d, 200)[0]).select("answer_id", "detail")


# Every kind of problem that these answers can have, by the rule that put it there.
_PROBLEMS = {
    **_ANS,
    "problems": f"""SELECT answer_id, 'citations' AS problem FROM a WHERE cited <> id
      UNION ALL SELECT answer_id, 'arithmetic' FROM a WHERE abs(100 * n / d - pct) > 1.0
      UNION ALL SELECT answer_id, 'numbers' FROM ({_NUMBERS})
      UNION ALL SELECT answer_id, 'quotes' FROM a WHERE id % 4 = 0
      UNION ALL SELECT answer_id, 'directional' FROM a WHERE d BETWEEN 30 AND 79
      UNION ALL SELECT answer_id, 'refusal' FROM (SELECT answer_id, unnest([1, 2, 3]) FROM a WHERE id % 11 = 0)""",
}


@query("answer_audit", T("records", "SELECT problem, count(*) AS n, count(DISTINCT answer_id) AS answers FROM problems GROUP BY problem", _PROBLEMS))
def answer_audit(spark: S, d: str) -> DataFrame:
    """All checks over all answers, summed by kind of problem."""
    return au.sweep_summary(au.audit(*[checkpointed(t) for t in answers(spark, d)]))


@query(
    "answer_reports",
    T("records", """SELECT a.answer_id, CASE WHEN id % 11 = 0 THEN 'NONE' ELSE 'FULL' END AS route, count(problem) AS problems,
                      coalesce(string_agg(DISTINCT problem, ',' ORDER BY problem), '') AS kinds, count(problem) = 0 AS passes
                    FROM a LEFT JOIN problems USING (answer_id) GROUP BY a.answer_id, id""", _PROBLEMS),
)
def answer_reports(spark: S, d: str) -> DataFrame:
    a, rows, stories = [checkpointed(t) for t in answers(spark, d)]
    return au.report(a, au.audit(a, rows, stories)).withColumn("kinds", F.array_join("kinds", ","))


_FACTS = """SELECT CASE WHEN k < 100 THEN 'F' || lpad(CAST(k AS VARCHAR), 2, '0') ELSE 'F' || k END AS id, key, n, d, p, stage,
         'core at ' || stage || ': ' || n || ' of ' || d || CASE WHEN d >= 30 THEN ' (' || CAST(round_even(100 * n / d, 0) AS INT) || '%)' ELSE '' END || ', from ' || p || ' people' AS text FROM (
         SELECT source || '/' || primary_stage AS key, primary_stage AS stage, count(*) FILTER (population = 'core') AS n, count(*) AS d, count(DISTINCT author_key) AS p,
           row_number() OVER (ORDER BY source || '/' || primary_stage) AS k FROM stories GROUP BY source, primary_stage)"""


@query("numbered_facts", T("stories", f"SELECT id, key, text FROM ({_FACTS})"))
def numbered_facts(spark: S, d: str) -> DataFrame:
    return au.facts_pack(_facts(spark, d)).select("id", "key", "text")


def _facts(spark: S, d: str) -> DataFrame:
    s = st.stories(spark, d)
    return s.groupBy(F.concat_ws("/", "source", "primary_stage").alias("key"), F.concat(F.lit("core at "), "primary_stage").alias("label")).agg(
        F.count_if(F.col("population") == "core").alias("stories"), F.count("*").alias("of"), F.count_distinct("author_key").alias("people")
    ).withColumn("table", F.lit("analysis_crosstab"))


@query("lost_facts", T("stories", "SELECT DISTINCT source || '/' || primary_stage AS key FROM stories WHERE primary_stage = '0'"))
def lost_facts(spark: S, d: str) -> DataFrame:
    f = _facts(spark, d)
    return au.lost_facts(au.facts_pack(f), f.filter(~F.col("key").endswith("/0"))).select("key")


@query(
    "statement_audit",
    T("stories", """SELECT problem, count(*) AS n FROM (
        SELECT 'cites no fact' AS problem FROM said WHERE cite = ''
        UNION ALL SELECT 'cites unknown fact' FROM said WHERE cite <> '' AND cite NOT IN (SELECT id FROM facts)
        UNION ALL SELECT unnest(['share of users or searches', 'percentage without n of N']) FROM said WHERE shares
        UNION ALL SELECT 'number not in cited facts' FROM (SELECT unnest([27, k + 100000]) AS x, f.* FROM said LEFT JOIN facts f ON f.id = cite WHERE shares)
          WHERE id IS NULL OR NOT list_contains([n, d, p, CAST(stage AS BIGINT), CASE WHEN d >= 30 THEN CAST(round_even(100 * n / d, 0) AS BIGINT) END], x)
        UNION ALL SELECT 'required fact not cited' FROM facts WHERE id NOT IN (SELECT cite FROM said)) GROUP BY problem""",
      {"facts": _FACTS,
       "said": """SELECT CAST(c_custkey AS BIGINT) AS k, c_custkey % 5 = 0 AS shares, CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'F00'
                    ELSE 'F' || lpad(CAST(1 + c_custkey % 90 AS VARCHAR), 2, '0') END AS cite FROM customer"""}),
)
def statement_audit(spark: S, d: str) -> DataFrame:
    """A statement per customer that cites a numbered fact; some cite none, an unknown one, or a wrong figure."""
    facts = au.facts_pack(_facts(spark, d)).select("id", "text")
    c = st.read(spark, d, "customer")
    k = F.col("c_custkey")
    nth = (1 + F.pmod(k, F.lit(90))).cast("string")
    cite = F.concat(F.lit("F"), F.lpad(nth, 2, "0"))
    cites = F.when(k % 13 == 0, F.array().cast("array<string>")).when(k % 17 == 0, F.array(F.lit("F00"))).otherwise(F.array(cite))
    text = F.when(k % 5 == 0, F.concat(F.lit("About 27% of users, or "), (k + 100000).cast("string"), F.lit(" cases"))).otherwise("Stage 5 is first")
    rows = c.select(k.cast("string").alias("path"), text.alias("text"), cites.alias("cites"))
    out = au.check_statements(rows, facts, [str(i) for i in range(11)], facts.select("id"))
    return out.groupBy("problem").agg(F.count("*").alias("n"))
