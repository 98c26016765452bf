"""Queries on text: cleaning columns, gates, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnote import vocab
from fieldnote.functions import html as hx
from fieldnote.functions import text as tx
from fieldnote.operators import clean, dedupe, funnel
from fieldnote.operators import marks as mk
from fieldnote.plans import standins as st
from fieldnote.plans.registry import query

S = SparkSession
T = st.with_tables
WORDS = "regexp_extract_all(lower({0}), '[a-z0-9'']+')"
_STOP = st._sql_list(vocab.STOP_WORDS)


@query(
    "normalised_text",
    """SELECT doc_id, md5(t) AS digest, length(t) AS n_chars_clean FROM (
         SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v\\x{A0}]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'),
           '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM documents)""",
)
def normalised_text(spark: S, d: str) -> DataFrame:
    t = tx.normalise(F.col("text"))
    return st.read(spark, d, "documents").select("doc_id", t.alias("t")).select(
        "doc_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars_clean")
    )


@query("personal_data_scrubbed")
def personal_data_scrubbed(spark: S, d: str) -> DataFrame:
    """Documents with personal data per source and kind, and the characters its removal took."""
    rows = clean.scrub_columns(st.records(spark, d).select("record_id", "source", "text_clean", F.length("text_clean").alias("before")), ["text_clean"])
    return (
        rows.select("source", (F.col("before") - F.length("text_clean")).alias("less"), F.explode("text_clean_kinds").alias("kind"))
        .groupBy("source", "kind")
        .agg(F.count("*").alias("documents"), F.sum("less").alias("characters_less"))
    )


@query(
    "email_leaks",
    """SELECT doc_id FROM documents
       WHERE regexp_matches(text, '\\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+\\b')""",
)
def email_leaks(spark: S, d: str) -> DataFrame:
    docs = st.read(spark, d, "documents")
    return docs.filter(F.array_contains(tx.leaks(F.col("text")), "email")).select("doc_id")


@query("leak_audit")
def leak_audit(spark: S, d: str) -> DataFrame:
    rows = st.read(spark, d, "documents").select("text", F.lower("text").alias("lowered"))
    return clean.leak_audit(rows, ["text", "lowered"])


@query(
    "record_ids",
    "SELECT doc_id, sha1(source || '‖' || CAST(doc_id AS VARCHAR)) AS record_id FROM documents",
)
def record_ids(spark: S, d: str) -> DataFrame:
    return st.read(spark, d, "documents").select("doc_id", tx.record_id(F.col("source"), F.col("doc_id")).alias("record_id"))


@query(
    "author_keys",
    """SELECT c_custkey, CASE WHEN lower(trim(h)) IN ('', '[deleted]') THEN NULL
              ELSE substr(sha256('salt::' || CAST(c_nationkey AS VARCHAR) || '::' || lower(trim(h))), 1, 32) END AS author_key
       FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN '[deleted]' ELSE '  ' || c_name || ' ' END AS h FROM customer)""",
)
def author_keys(spark: S, d: str) -> DataFrame:
    handle = F.when(F.col("c_acctbal") < 0, "[deleted]").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    key = tx.author_key(F.col("c_nationkey").cast("string"), handle, st.SALT)
    return st.read(spark, d, "customer").select("c_custkey", key.alias("author_key"))


@query(
    "timestamps_read",
    "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events",
)
def timestamps_read(spark: S, d: str) -> DataFrame:
    """Each event's time written in one of the five forms collectors meet, and read back."""
    e = st.read(spark, d, "events")
    seconds = F.unix_seconds(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', date_trunc('SECOND', ts)::timestamp_ntz)")
    day = F.date_format("ts", "EEE")
    said = (
        F.when(F.col("event_type") == "view", seconds.cast("string"))
        .when(F.col("event_type") == "click", (seconds * 1000).cast("string"))
        .when(F.col("event_type") == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_type") == "signup", F.concat(day, F.date_format("ts", " MMM d HH:mm:ss '+0000' yyyy")))
        .otherwise(F.date_format("ts", "M/d/yyyy, h:mm:ss a"))
    )
    return e.select("event_id", said.alias("said")).select("event_id", tx.to_iso(F.col("said")).alias("iso"))


_HINGLISH = st._sql_list(vocab.HINGLISH_MARKERS)
_STRONG = st._sql_list([w for w in vocab.HINGLISH_MARKERS if w not in vocab.HINGLISH_WEAK])
_OTHER = "[\\x{0980}-\\x{0DFF}\\x{0E00}-\\x{0E7F}\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{0600}-\\x{06FF}\\x{0400}-\\x{04FF}\\x{AC00}-\\x{D7AF}]"


@query(
    "language_tags",
    f"""SELECT record_id, CASE WHEN trim(text_clean) = '' THEN 'unknown'
          WHEN regexp_matches(text_clean, '[\\x{{0900}}-\\x{{097F}}]') THEN CASE WHEN regexp_matches(text_clean, '[A-Za-z]') AND n > 3 THEN 'mixed' ELSE 'hi' END
          WHEN regexp_matches(text_clean, '{_OTHER}') THEN 'other'
          WHEN n = 0 THEN 'unknown'
          WHEN strong >= 2 OR (strong >= 1 AND marked >= 2) OR (strong = 1 AND n <= 8) THEN 'hi-Latn' ELSE 'en' END AS lang
        FROM (SELECT CAST(doc_id AS VARCHAR) AS record_id, text AS text_clean, len(w) AS n,
                     len(list_filter(w, lambda x: list_contains({_STRONG}, x))) AS strong,
                     len(list_filter(w, lambda x: list_contains({_HINGLISH}, x))) AS marked
              FROM (SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))""",
)
def language_tags(spark: S, d: str) -> DataFrame:
    return clean.tag_language(st.records(spark, d)).select("record_id", "lang")


@query(
    "word_counts",
    f"""SELECT doc_id, len({WORDS.format('text')}) AS words,
               len(list_distinct({WORDS.format('text')})) AS distinct_words,
               len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+|[\\x{{0900}}-\\x{{097F}}]+'),
                   lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x))) AS terms
        FROM documents""",
)
def word_counts(spark: S, d: str) -> DataFrame:
    t = F.col("text")
    return st.read(spark, d, "documents").select(
        "doc_id", F.size(tx.words(t)).alias("words"), F.size(dedupe.word_set(t)).alias("distinct_words"),
        F.size(tx.search_terms(t)).alias("terms"),
    )


@query("short_texts", T("marks", "SELECT record_id, source, reason FROM marks"))
def short_texts(spark: S, d: str) -> DataFrame:
    return clean.short_marks(st.records(spark, d), "r").select("record_id", "source", "reason")


def gate_sql(column: str, terms: list[str] | None = None) -> str:
    """The relevance gate as a CASE expression, in rule order."""
    q = lambda p: p.replace("'", "''")
    cases = " ".join(
        f"WHEN regexp_matches({column}, '(?i){q(p)}') THEN '{q('lexicon:' + p[:40])}'"
        for p in tx.lexicon_patterns(terms or clean.all_terms())
    )
    return (
        f"CASE {cases} WHEN regexp_matches({column}, '{q(vocab.STRONG_PHRASE)}') THEN 'strong retrieval phrase' "
        f"WHEN regexp_matches({column}, '{q(vocab.THING_WORD)}') OR regexp_matches({column}, '{vocab.THING_DEVANAGARI}') "
        "THEN 'photo-like thing' ELSE 'no photo-like thing' END"
    )


@query("relevance_gate", f"SELECT CAST(doc_id AS VARCHAR) AS record_id, {gate_sql('text')} AS why FROM documents")
def relevance_gate(spark: S, d: str) -> DataFrame:
    return clean.with_gate(st.records(spark, d)).select("record_id", "why")


@query(
    "browse_totals",
    T("records", """SELECT count(*) AS n, count(DISTINCT author_key) AS n_authors FROM records
                    WHERE source IN ('src1', 'src7', 'src13') AND text_clean ILIKE '%tion the%'"""),
)
def browse_totals(spark: S, d: str) -> DataFrame:
    return clean.browse(st.records(spark, d), ["src1", "src7", "src13"], "tion the")[0]


@query(
    "browse_newest",
    T("records", """SELECT record_id, created_at FROM records
                    WHERE source IN ('src1', 'src7', 'src13') AND text_clean ILIKE '%tion the%'
                    ORDER BY created_at DESC NULLS LAST, record_id LIMIT 60"""),
)
def browse_newest(spark: S, d: str) -> DataFrame:
    return clean.browse(st.records(spark, d), ["src1", "src7", "src13"], "tion the")[1].select("record_id", "created_at")


@query(
    "excluded_sample",
    T("exact", """SELECT record_id, 'duplicate of ' || winner AS detail FROM exact ORDER BY record_id LIMIT 30"""),
)
def excluded_sample(spark: S, d: str) -> DataFrame:
    r = st.records(spark, d)
    marks = mk.mark(dedupe.exact_duplicates(r), "clean", "exact_duplicate", F.concat(F.lit("duplicate of "), "winner"), "r")
    return clean.excluded_sample(r, marks, "exact_duplicate").select("record_id", "detail")


@query(
    "snippets",
    """SELECT doc_id, CASE WHEN length(text) > 700 THEN
          CASE WHEN lo > 0 THEN '… ' ELSE '' END || substr(text, lo + 1, 700) || ' …[cut]' ELSE text END AS shown
       FROM (SELECT doc_id, text, CASE WHEN spot > 450 THEN greatest(0, spot - 250) ELSE 0 END AS lo
             FROM (SELECT doc_id, text, instr(text, substr(text, 900, 25)) - 1 AS spot FROM documents))""",
)
def snippets(spark: S, d: str) -> DataFrame:
    docs = st.read(spark, d, "documents")
    return docs.select("doc_id", tx.snippet(F.col("text"), F.substring("text", 900, 25)).alias("shown"))


@query(
    "page_markup_removed",
    """SELECT page_id, md5(t) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(html,
         '(?i)</?(p|br|li|pre|blockquote|h[0-9])[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM pages)""",
)
def page_markup_removed(spark: S, d: str) -> DataFrame:
    return st.read(spark, d, "pages").select("page_id", F.md5(hx.strip_tags(F.col("html"))).alias("digest"))


@query("page_texts")
def page_texts(spark: S, d: str) -> DataFrame:
    return st.read(spark, d, "pages").select("page_id", hx.html_to_text(F.col("html")).alias("text")).select(
        "page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest")
    )


# ------------------------------------------------------------------------------- duplicates
@query("exact_duplicates", T("exact", "SELECT * FROM exact"))
def exact_duplicates(spark: S, d: str) -> DataFrame:
    return dedupe.exact_duplicates(st.records(spark, d))


_SETS = f"""SELECT source, key, min(record_id) AS name, count(*) AS n, any_value(w) AS w FROM (
              SELECT record_id, source, list_sort(list_distinct({WORDS.format('text_clean')})) AS w,
                     list_aggregate(list_sort(list_distinct({WORDS.format('text_clean')})), 'string_agg', ' ') AS key,
                     length(text_clean) AS n_chars
              FROM records) WHERE len(w) > 0 GROUP BY source, key"""
_SIM = "len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))"


@query(
    "similar_texts",
    T("records", f"""SELECT x.source, least(x.name, y.name) AS a, greatest(x.name, y.name) AS b, round({_SIM}, 6) AS similarity
                     FROM sets x JOIN sets y ON x.source = y.source AND x.key < y.key AND len(x.w) > 0.85 * len(y.w) AND len(y.w) > 0.85 * len(x.w)
                     WHERE {_SIM} > 0.85""", {"sets": _SETS}),
)
def similar_texts(spark: S, d: str) -> DataFrame:
    rows = dedupe.similar_texts(st.records(spark, d))
    return rows.select("source", "a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "echo_pairs",
    T("records", """SELECT x.source, count(*) AS echo_pairs FROM rows x JOIN rows y
                    ON x.source = y.source AND x.record_id < y.record_id AND x.author_key <> y.author_key
                    WHERE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) > 0.85
                    GROUP BY x.source""",
      {"rows": f"SELECT record_id, source, author_key, list_distinct({WORDS.format('text_clean')}) AS w FROM records WHERE len({WORDS.format('text_clean')}) > 0"}),
)
def echo_pairs(spark: S, d: str) -> DataFrame:
    return dedupe.cross_author_echoes(st.records(spark, d)).filter("echo_pairs > 0")


# One author per language, so that authors have enough texts to repeat themselves. Texts are gone through in order:
# ``kept`` grows by a text when none of the kept ones is similar to it, else the earliest similar one wins.
_NEAR = {
    "near_rows": f"""SELECT '_all' AS source, collect_query AS author_key, record_id, coalesce(created_at, '9999') AS created,
                       list_sort(list_distinct({WORDS.format('text_clean')})) AS w FROM {{0}}""",
    "near_sets": """SELECT source, author_key, w, first(record_id ORDER BY created, record_id) AS id, first(created ORDER BY created, record_id) AS created
                    FROM near_rows WHERE len(w) > 0 GROUP BY source, author_key, w""",
    "near_links": """SELECT x.source, x.author_key, x.id AS late, y.id AS early, y.created AS early_at FROM near_sets x JOIN near_sets y
                       ON x.source = y.source AND x.author_key = y.author_key AND (y.created, y.id) < (x.created, x.id)
                      AND len(x.w) > 0.85 * len(y.w) AND len(y.w) > 0.85 * len(x.w)
                     WHERE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) > 0.85""",
    "near_asked": """SELECT source, author_key, id, list(early ORDER BY early_at, early) AS earlier,
                       row_number() OVER (PARTITION BY source, author_key ORDER BY any_value(created), id) AS step
                     FROM near_sets JOIN near_links USING (source, author_key) WHERE late = id GROUP BY source, author_key, id""",
    "near_lost": """SELECT source, author_key, 0::bigint AS step, []::varchar[] AS lost, NULL::varchar AS id, NULL::varchar AS winner
                    FROM (SELECT DISTINCT source, author_key FROM near_asked)
                    UNION ALL
                    SELECT l.source, l.author_key, a.step, CASE WHEN len(list_filter(a.earlier, lambda e: NOT list_contains(l.lost, e))) > 0 THEN list_append(l.lost, a.id) ELSE l.lost END,
                      a.id, list_filter(a.earlier, lambda e: NOT list_contains(l.lost, e))[1]
                    FROM near_lost l JOIN near_asked a ON l.source = a.source AND l.author_key = a.author_key AND a.step = l.step + 1""",
    "near_out": """SELECT r.record_id, coalesce(l.winner, s.id) AS winner, r.source FROM near_rows r
                   JOIN near_sets s ON s.source = r.source AND s.author_key = r.author_key AND s.w = r.w
                   LEFT JOIN near_lost l ON l.source = s.source AND l.author_key = s.author_key AND l.id = s.id
                   WHERE r.record_id <> coalesce(l.winner, s.id)""",
}


def near_sql(table: str) -> dict[str, str]:
    return {**_NEAR, "near_rows": _NEAR["near_rows"].replace("{0}", table)}


def by_language(records: DataFrame) -> DataFrame:
    return records.withColumns({"source": F.lit("_all"), "author_key": F.col("collect_query")})


@query("near_duplicates", T("records", "SELECT * FROM near_out", near_sql("records")))
def near_duplicates(spark: S, d: str) -> DataFrame:
    """All texts of a language as those of one author."""
    return dedupe.near_duplicates_same_author(by_language(st.records(spark, d)))


@query(
    "dedupe_pass",
    T("records", """SELECT record_id, 'clean' AS stage, 'exact_duplicate' AS reason, 'duplicate of ' || winner AS detail FROM exact_all
                    UNION ALL SELECT record_id, 'clean', 'near_duplicate_same_author', 'same-author near-duplicate of ' || winner FROM near_out""",
      {"all_records": "SELECT * REPLACE ('_all' AS source, collect_query AS author_key) FROM records",
       "exact_all": st.SQL["exact"].replace("FROM records)", "FROM all_records)"),
       "rest_records": "SELECT * FROM all_records WHERE record_id NOT IN (SELECT record_id FROM exact_all)", **near_sql("rest_records")}),
)
def dedupe_pass(spark: S, d: str) -> DataFrame:
    """Exact copies, then near copies of one author among the rest, as marks."""
    marks = dedupe.dedupe_marks(by_language(st.records(spark, d)), st.no_marks(spark), "r")
    return marks.select("record_id", "stage", "reason", "detail")


# ------------------------------------------------------------------------------- the cleaning pass and its funnel
# The test texts are invented words, so the pass runs with terms that occur in some of them.
TERMS = ["heon", "que le", "nicht und"]


def cleaning_marks(spark: S, d: str) -> DataFrame:
    """Short texts, then exact copies, then texts the relevance gate rejects; each stage sees what is live."""
    r = st.records(spark, d)
    out = mk.add_marks(st.no_marks(spark), clean.short_marks(r, "r"))
    copies = dedupe.exact_duplicates(mk.live_records(r, out))
    out = mk.add_marks(out, mk.mark(copies, "clean", "exact_duplicate", F.concat(F.lit("duplicate of "), "winner"), "r"))
    return mk.replace_stage_marks(out, "prefilter", clean.gate_marks(r, out, "r", TERMS))


_CLEANING = {
    "short_ids": "SELECT record_id FROM marks",
    "live1": "SELECT * FROM records WHERE record_id NOT IN (SELECT record_id FROM short_ids)",
    "exact1": st.SQL["exact"].replace("FROM records)", "FROM live1)"),
    "live2": "SELECT * FROM live1 WHERE record_id NOT IN (SELECT record_id FROM exact1)",
    "gated": f"SELECT record_id FROM live2 WHERE {gate_sql('text_clean', TERMS)} = 'no photo-like thing'",
    "ex": """SELECT record_id, 'too_short' AS reason FROM short_ids UNION ALL SELECT record_id, 'exact_duplicate' FROM exact1
             UNION ALL SELECT record_id, 'lexicon_rejected' FROM gated""",
    "both_": "SELECT r.record_id, r.source, r.author_key, e.reason FROM records r LEFT JOIN ex e USING (record_id)",
    "wide": "SELECT record_id, source, author_key, reason FROM both_ UNION ALL SELECT record_id, '_all', author_key, reason FROM both_",
    "tot": "SELECT source, count(DISTINCT record_id) AS denom FROM wide GROUP BY source",
}
FUNNEL_SQL = T(
    "records marks",
    """SELECT step, step_order, source, n, denom, n_authors FROM (
         SELECT 'collected' AS step, 0 AS step_order, source, count(DISTINCT record_id) AS n, count(DISTINCT author_key) AS n_authors FROM wide GROUP BY source
         UNION ALL SELECT 'kept', 99, source, count(DISTINCT CASE WHEN reason IS NULL THEN record_id END), count(DISTINCT CASE WHEN reason IS NULL THEN author_key END) FROM wide GROUP BY source
         UNION ALL SELECT 'excluded:' || reason, 9 + row_number() OVER (PARTITION BY source ORDER BY n DESC, reason), source, n, n_authors FROM (
           SELECT reason, source, count(DISTINCT record_id) AS n, count(DISTINCT author_key) AS n_authors FROM wide WHERE reason IS NOT NULL GROUP BY reason, source))
       JOIN tot USING (source)""",
    _CLEANING,
)


@query("record_funnel", FUNNEL_SQL)
def record_funnel(spark: S, d: str) -> DataFrame:
    rows = funnel.record_funnel(st.records(spark, d), cleaning_marks(spark, d), "r")
    return rows.select("step", "step_order", "source", "n", "denom", "n_authors")


@query("cleaning_marks", T("records marks", "SELECT record_id, reason FROM ex", {k: v for k, v in _CLEANING.items() if k in ("short_ids", "live1", "exact1", "live2", "gated", "ex")}))
def cleaning_marks_query(spark: S, d: str) -> DataFrame:
    return cleaning_marks(spark, d).select("record_id", "reason")


@query(
    "live_records",
    T("records marks", "SELECT record_id, source FROM live2", {k: v for k, v in _CLEANING.items() if k in ("short_ids", "live1", "exact1", "live2")}),
)
def live_records(spark: S, d: str) -> DataFrame:
    """Records live before the relevance gate: its own marks are left out of account."""
    return mk.live_records(st.records(spark, d), cleaning_marks(spark, d), before_stage="prefilter").select("record_id", "source")
