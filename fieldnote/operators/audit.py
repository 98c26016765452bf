"""Audits of written answers against the rows and stories they rest on.

Tables: ``answers`` (answer_id, text, route, question, gap); ``rows`` (answer_id, table, key, and numbers:
``values`` array<double> of every number the row states, ``shares`` array of struct<n, of>, ``labels``
array<string>); ``stories`` (answer_id, story_id, text). An answer has a handful of rows and stories, and
everything about one answer is worked out within it; no check compares one answer with another.

Each check returns ``answer_id, problem, detail``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote import rulebook as rb
from fieldnote import vocab
from fieldnote.functions import text as tx
from fieldnote.operators.numbering import numbered

EMPTY = "array<string>"


def _none() -> Column:
    return F.array().cast(EMPTY)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _number(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit("")).try_cast("double")


def uncited(text: Column) -> Column:
    """An answer's own words: citations and quotations blanked."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rb.CITATION, " "), rb.QUOTE, " ")


def claims(text: Column) -> Column:
    """Own words without structure such as stage and question numbers."""
    t = uncited(text)
    for p in rb.STRUCTURE:
        t = F.regexp_replace(t, p, " ")
    return t


def numbers(text: Column) -> Column:
    """``array<struct<value, pct, before>>``: each number, whether it is a percentage, and what precedes it."""
    hits = _all(text, rb.NUMBER, 1)
    pcts = _all(text, rb.NUMBER, 2)
    gaps = F.split(text, rb.NUMBER, -1)
    joined = F.arrays_zip(hits.alias("h"), pcts.alias("p"), F.slice(gaps, 1, F.size(hits)).alias("g"))
    full = F.transform(
        joined,
        lambda x: F.struct(_number(x["h"]).alias("value"), (x["p"] == "%").alias("pct"), F.right(x["g"], F.lit(14)).alias("before")),
    )
    return F.filter(full, lambda x: x["value"].isNotNull())


def number_values(*columns: Column) -> Column:
    """Every number some columns state, in the forms an answer may repeat it."""
    stated = F.array().cast("array<double>")
    for c in columns:
        stated = F.concat(stated, F.transform(numbers(F.coalesce(c.cast("string"), F.lit(""))), lambda x: x["value"]))
    return spoken_forms(stated)


def spoken_forms(values: Column) -> Column:
    """A number as it may be said: itself, rounded, and a share also as a percentage."""
    def forms(v: Column) -> Column:
        plain = F.array(v, F.bround(v, 1), F.bround(v, 2))
        as_pct = F.array(v * 100, F.bround(v * 100, 0), F.bround(v * 100, 1))
        return F.when(v.between(0, 1), F.concat(plain, as_pct)).otherwise(plain)

    return F.array_distinct(F.flatten(F.transform(values, forms)))


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\\n\\s*\\n")


def citations(text: Column) -> Column:
    """``array<struct<table, key>>`` in order."""
    return F.transform(
        F.arrays_zip(_all(text, rb.CITATION, 1).alias("t"), _all(text, rb.CITATION, 2).alias("k")),
        lambda x: F.struct(x["t"].alias("table"), F.trim(x["k"]).alias("key")),
    )


def _problem(df: DataFrame, name: str, detail: Column) -> DataFrame:
    """One row per entry of an array column of findings."""
    found = df.select("answer_id", detail.alias("found"))
    return found.select("answer_id", F.lit(name).alias("problem"), F.explode("found").alias("detail"))


# ------------------------------------------------------------------------------- citations
def check_citations(answers: DataFrame, rows: DataFrame, stories: DataFrame) -> DataFrame:
    """Citations of rows or stories that were not retrieved for the answer."""
    cited = answers.select("answer_id", F.explode(citations(F.col("text"))).alias("c")).select("answer_id", "c.table", "c.key")
    have = rows.select("answer_id", "table", "key").unionByName(
        stories.select("answer_id", F.lit("story").alias("table"), F.col("story_id").alias("key"))
    )
    return cited.join(have, ["answer_id", "table", "key"], "left_anti").select(
        "answer_id", F.lit("citations").alias("problem"), F.concat("table", F.lit("["), "key", F.lit("]")).alias("detail")
    )


def _with_rows(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """Answers with their retrieved rows as one array (``rows``)."""
    packed = rows.groupBy("answer_id").agg(
        F.collect_list(
            F.struct(
                F.concat("table", F.lit("|"), "key").alias("cite"),
                F.col("table"),
                F.coalesce("values", F.array().cast("array<double>")).alias("values"),
                F.coalesce("shares", F.array().cast("array<struct<n:bigint,of:bigint>>")).alias("shares"),
            )
        ).alias("rows")
    )
    none = F.array().cast("array<struct<cite:string,table:string,values:array<double>,shares:array<struct<n:bigint,of:bigint>>>>")
    return answers.join(packed, "answer_id", "left").withColumn("rows", F.coalesce("rows", none))


def _cited_rows(text: Column, rows: Column) -> Column:
    keys = F.transform(citations(text), lambda c: F.concat(c["table"], F.lit("|"), c["key"]))
    return F.filter(rows, lambda r: F.array_contains(keys, r["cite"]))


# ------------------------------------------------------------------------------- numbers
def _unsupported(text: Column, allowed: Column) -> Column:
    """Numbers of a text that no allowed value supports."""
    def approx(x: Column) -> Column:
        word = F.lower(F.regexp_extract(x["before"], rb.APPROXIMATELY, 1))
        v = x["value"]

        def near(c: Column) -> Column:
            side = (
                F.when(word.isin("over", "more than", "just over"), c >= v)
                .when(word.isin("nearly", "almost", "under", "just under"), c <= v)
                .otherwise(True)
            )
            return (F.abs(c - v) <= 0.05 * c) & side

        return (word != "") & (v >= 1000) & (v % 100 == 0) & F.exists(allowed, near)

    def bad(x: Column) -> Column:
        v = x["value"]
        year = v.between(1900, 2100) & (v == F.floor(v))
        free = ~x["pct"] & (v.isin(rb.STRUCTURAL_NUMBERS) | year | approx(x))
        return ~free & ~F.exists(allowed, lambda c: F.abs(v - c) <= rb.NUMBER_TOLERANCE)

    shown = lambda x: F.concat(
        F.regexp_replace(x["value"].cast("string"), "\\.0$", ""), F.when(x["pct"], "%").otherwise("")
    )
    return F.transform(F.filter(numbers(claims(text)), bad), shown)


def check_numbers(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbers a paragraph states without a cited row that holds them.

    A paragraph that cites no retrieved row is held to all of the answer's rows. Corpus totals and the
    numbers of a stated gap are allowed everywhere.
    """
    flat = lambda rs: F.flatten(F.transform(rs, lambda r: r["values"]))
    df = _with_rows(answers, rows)
    stated = F.concat(
        number_values(F.col("gap")), flat(F.filter("rows", lambda r: r["table"] == "analysis_funnel"))
    )
    df = df.select("answer_id", "rows", "text", stated.alias("stated")).select(
        "answer_id", "rows", "stated", F.explode(paragraphs(F.col("text"))).alias("para")
    )
    df = df.withColumn("cited", _cited_rows(F.col("para"), F.col("rows")))
    allowed = F.concat(flat(F.when(F.size("cited") > 0, F.col("cited")).otherwise(F.col("rows"))), "stated")
    df = df.withColumn("allowed", allowed)
    return _problem(df, "numbers", _unsupported(F.col("para"), F.col("allowed")))


def check_percentages(answers: DataFrame) -> DataFrame:
    """Percentages without their count close by."""
    t = uncited(F.col("text"))
    near = lambda x: F.substring(t, F.greatest(x["at"] - 45, F.lit(0)) + 1, F.least(x["at"], F.lit(45)) + F.length(x["h"]) + 30)
    bad = F.filter(tx.matches(t, "\\d+(?:\\.\\d+)?%"), lambda x: ~near(x).rlike(rb.COUNT_OF))
    return _problem(answers, "percentages", F.transform(bad, lambda x: x["h"]))


def shares_in(text: Column) -> Column:
    """``array<struct<hit, pct, n, of>>``: each percentage that stands with its count."""
    g = [_all(text, rb.SHARE, i) for i in range(7)]
    zipped = F.arrays_zip(*[c.alias(f"g{i}") for i, c in enumerate(g)])
    pick = lambda x, a, b: _number(F.coalesce(F.nullif(x[a], F.lit("")), x[b]))
    return F.transform(
        zipped,
        lambda x: F.struct(
            x["g0"].alias("hit"), pick(x, "g1", "g6").alias("pct"), pick(x, "g2", "g4").alias("n"), pick(x, "g3", "g5").alias("of")
        ),
    )


def check_arithmetic(answers: DataFrame) -> DataFrame:
    """Percentages that are not what their own count gives, within one point."""
    off = F.filter(
        shares_in(uncited(F.col("text"))),
        lambda s: (s["of"] == 0) | (s["n"] > s["of"]) | (F.abs(100 * s["n"] / F.nullif(s["of"], F.lit(0.0)) - s["pct"]) > 1.0),
    )
    return _problem(answers, "arithmetic", F.transform(off, lambda s: s["hit"]))


def check_floor_claims(answers: DataFrame) -> DataFrame:
    """Counts called too few that are not below the floor they name."""
    t = uncited(F.col("text"))
    hits = F.arrays_zip(_all(t, rb.FLOOR_CLAIM, 0).alias("h"), _all(t, rb.FLOOR_CLAIM, 1).alias("n"), _all(t, rb.FLOOR_CLAIM, 2).alias("f"))
    bad = F.filter(hits, lambda x: _number(x["n"]) >= _number(x["f"]))
    return _problem(answers, "floor_claim", F.transform(bad, lambda x: x["h"]))


def check_proportions(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """Fractions and majorities in words that no share the sentence rests on supports.

    A group under the floor gives no share. A sentence rests on the rows it cites, else on those of its
    paragraph, else on all rows of the answer. Refusals are not held to this.
    """
    tol = vocab.PROPORTION_TOLERANCE
    df = _with_rows(answers.filter("route <> 'NONE'"), rows)
    df = df.select("answer_id", "rows", F.explode(paragraphs(F.col("text"))).alias("para"))
    df = df.withColumn("in_para", _cited_rows(F.col("para"), F.col("rows")))
    df = df.select("answer_id", "rows", "in_para", F.explode(_all(F.col("para"), rb.CITED_SENTENCE)).alias("sent"))
    df = df.withColumn("cited", _cited_rows(F.col("sent"), F.col("rows")))
    used = F.when(F.size("cited") > 0, F.col("cited")).when(F.size("in_para") > 0, F.col("in_para")).otherwise(F.col("rows"))
    big = F.filter(used, lambda r: F.exists(r["shares"], lambda s: s["of"] >= vocab.FLOOR))
    values = F.flatten(
        F.transform(big, lambda r: F.transform(F.filter(r["shares"], lambda s: s["of"] > 0), lambda s: s["n"] / F.nullif(s["of"], F.lit(0).cast("bigint"))))
    )
    df = df.select("answer_id", values.alias("shares"), uncited(F.col("sent")).alias("own"))
    names = "|".join(sorted(rb.FRACTIONS, key=len, reverse=True))
    pattern = f"(?i)\\b(?:({rb.FRACTION_MODIFIERS})\\s+)?({names})\\b(?=((?s:.{{0,20}})))"
    hits = F.arrays_zip(
        _all(F.col("own"), pattern, 0).alias("h"), _all(F.col("own"), pattern, 1).alias("m"),
        _all(F.col("own"), pattern, 2).alias("f"), _all(F.col("own"), pattern, 3).alias("after"),
    )
    value_of = F.create_map(*[F.lit(x) for kv in rb.FRACTIONS.items() for x in kv])

    def fits(x: Column) -> Column:
        v, m = F.try_element_at(value_of, F.lower(x["f"])), F.lower(x["m"])
        above = F.exists("shares", lambda s: s.between(v, v + 2 * tol))
        below = F.exists("shares", lambda s: s.between(v - 2 * tol, v + 0.01))
        near = F.exists("shares", lambda s: F.abs(s - v) <= tol)
        half_formed = (F.lower(x["f"]) == "half") & F.concat(x["f"], x["after"]).rlike(rb.HALF_FORMED)
        return half_formed | F.when(m.isin(rb.FRACTION_ABOVE), above).when(m.isin(rb.FRACTION_BELOW), below).otherwise(near)

    wrong = F.transform(F.filter(hits, lambda x: ~fits(x)), lambda x: x["h"])
    most = F.when(~F.exists("shares", lambda s: s > 0.5), _all(F.col("own"), rb.MAJORITY)).otherwise(_none())
    return _problem(df, "proportions", F.concat(wrong, most))


# ------------------------------------------------------------------------------- labels
def _sentences(text: Column) -> Column:
    return F.split(text, "(?<=[.!?])(?=\\s|\\z)|\\n")


def check_labels(answers: DataFrame) -> DataFrame:
    """Shares of 30-79 that are not labelled rough, and labels on shares of 80 or more."""
    df = answers.select("answer_id", F.explode(_sentences(uncited(F.col("text")))).alias("s"))
    df = df.withColumns({"shares": shares_in(F.col("s")), "labelled": F.col("s").rlike(rb.ROUGH_LABEL)})
    bare = F.filter("shares", lambda x: ~F.col("labelled") & (x["of"] >= vocab.FLOOR) & (x["of"] < vocab.COMPARABLE))
    all_big = ~F.exists("shares", lambda x: x["of"] < vocab.COMPARABLE)
    tail = f"(?:{rb.SHARE})\\)?(?=[^.;%]{{0,20}}?·?\\s*(?:directional|— a small group))"
    followed = _all(F.col("s"), tail, 0)
    claimed = F.filter(
        "shares",
        lambda x: (x["of"] >= vocab.COMPARABLE)
        & ((F.col("labelled") & all_big) | F.exists(followed, lambda f: F.startswith(f, x["hit"]))),
    )
    return _problem(df, "directional", F.transform(bare, lambda x: x["hit"])).unionByName(
        _problem(df, "directional_claimed", F.transform(claimed, lambda x: x["hit"]))
    )


# ------------------------------------------------------------------------------- quotes
def _plain(text: Column) -> Column:
    """Typography levelled: one quote mark, no space around it, single spaces, lower case."""
    t = F.regexp_replace(text, "[\"'‘’“”`´]", "'")
    t = F.regexp_replace(t, "(?U)\\s*'\\s*", "'")
    return F.lower(F.trim(F.regexp_replace(t, "(?U)\\s+", " ")))


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "(?U)\\s+"), lambda w: w != ""))


def check_quotes(answers: DataFrame, rows: DataFrame, stories: DataFrame) -> DataFrame:
    """Quotations that are in no retrieved story (nor in the question).

    Fewer than three words is a term; up to four that nobody is said to have said too; up to six may be a
    category's own name. A quote cut by an ellipsis must be found part by part.
    """
    heard = stories.groupBy("answer_id").agg(F.collect_list(_plain(F.col("text"))).alias("heard"))
    labels = rows.select("answer_id", F.explode("labels").alias("l")).groupBy("answer_id").agg(
        F.collect_set(_plain(F.replace(F.col("l"), F.lit("_"), F.lit(" ")))).alias("names")
    )
    df = answers.join(heard, "answer_id", "left").join(labels, "answer_id", "left")
    hay = F.concat(F.coalesce("heard", _none()), F.array(_plain(F.coalesce("question", F.lit("")))))
    df = df.select(
        "answer_id", hay.alias("hay"), F.coalesce("names", _none()).alias("names"),
        F.explode(_sentences(F.col("text"))).alias("s"),
    ).select("answer_id", "hay", "names", F.col("s").rlike(rb.SAID).alias("said"), F.explode(_all(F.col("s"), rb.QUOTE, 1)).alias("quote"))
    q = F.regexp_replace(_plain(F.col("quote")), "^[ .,;:!?…]+|[ .,;:!?…]+$", "")
    df = df.withColumn("q", q).withColumn("n", _word_count(F.col("q")))
    named = (F.col("n") <= rb.LABEL_WORDS) & F.exists("names", lambda x: F.contains(x, F.col("q")))
    df = df.filter((F.col("n") >= 3) & ~((F.col("n") <= rb.TERM_WORDS) & ~F.col("said")) & ~named)
    parts = F.filter(F.split("q", "\\s*(?:…|\\.\\.\\.)\\s*"), lambda p: _word_count(p) >= 3)
    df = df.withColumn("parts", F.when(F.size(parts) > 0, parts).otherwise(F.array("q")))
    found = F.forall("parts", lambda p: F.exists("hay", lambda h: F.contains(h, p)))
    return df.filter(~found).select("answer_id", F.lit("quotes").alias("problem"), F.col("quote").alias("detail"))


# ------------------------------------------------------------------------------- rules on wording
def _in_context(text: Column, pattern: str, window: int) -> Column:
    """Each match of a pattern with up to ``window`` characters before it: ``array<struct<h, b>>``."""
    before = lambda x: F.substring(text, F.greatest(x["at"] - window, F.lit(0)) + 1, F.least(x["at"], F.lit(window)))
    return F.transform(tx.matches(text, pattern), lambda x: F.struct(x["h"].alias("h"), before(x).alias("b")))


def check_proxy(answers: DataFrame) -> DataFrame:
    """Counts of stories stated as rates of users or searches, unless the clause denies them."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), rb.QUOTE, " ")
    hits = _in_context(t, rb.PROXY, rb.NEGATION_WINDOW)
    clause = lambda b: F.regexp_extract(b, "([^.\\n;?]*)\\z", 1)
    return _problem(
        answers, "proxy", F.transform(F.filter(hits, lambda x: ~clause(x["b"]).rlike(rb.NEGATION)), lambda x: x["h"])
    )


def check_label_colon(answers: DataFrame) -> DataFrame:
    """"Caveat:" and the like: a form, not an answer. What introduces someone's words is no label."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), rb.CITATION, " ")
    look = f"{rb.LABEL_COLON}(?=((?s:.{{0,6}})))"
    hits = F.arrays_zip(_all(t, look, 1).alias("l"), _all(t, look, 2).alias("after"))
    bad = F.filter(
        hits,
        lambda x: (F.lower(F.trim(x["l"])) != "interpretation")
        & (_word_count(x["l"]) <= 5)
        & ~x["l"].rlike(rb.SPEECH_END)
        & ~x["after"].rlike("^\\s*[*_]*[\"“‘']"),
    )
    return _problem(answers, "label_colon", F.transform(bad, lambda x: F.concat(F.trim(x["l"]), F.lit(":"))))


def check_codes(answers: DataFrame) -> DataFrame:
    """Code names in the answer's own words."""
    return _problem(answers, "codes", F.array_sort(F.array_distinct(_all(uncited(F.col("text")), rb.CODE_NAME))))


def check_jargon(answers: DataFrame) -> DataFrame:
    """Internal words a reader cannot know, unless the question used them."""
    found = F.transform(
        _all(uncited(F.col("text")), rb.JARGON), lambda w: F.when(w == F.upper(w), w).otherwise(F.lower(w))
    )
    asked = F.regexp_replace(F.lower(F.coalesce("question", F.lit(""))), "[-_]", " ")
    known = lambda w: F.forall(
        F.filter(F.split(F.lower(w), "\\s+"), lambda x: x != ""), lambda x: F.contains(asked, F.regexp_replace(x, "s+$", ""))
    )
    return _problem(answers, "jargon", F.array_sort(F.filter(F.array_distinct(found), lambda w: ~known(w))))


def check_comparison(answers: DataFrame) -> DataFrame:
    """Claims that kinds of photo differ. A question, a denial, or a kind that is only the scope is none."""
    df = answers.select("answer_id", F.explode(_sentences(uncited(F.col("text")))).alias("s"))
    question = F.regexp_replace("s", "[ *_]+$", "").endswith("?")
    denied = "(?i)\\b(?:whether|cannot|can.t|not|no)\\b[^—;]*$"
    compare = F.filter(_in_context(F.col("s"), rb.KIND_COMPARE, 50), lambda x: ~question & ~x["b"].rlike(denied))
    lead, hit = _all(F.col("s"), rb.KIND_SUPERLATIVE, 1), _all(F.col("s"), rb.KIND_SUPERLATIVE, 0)
    ranks = F.filter(F.arrays_zip(hit.alias("h"), lead.alias("l")), lambda x: ~x["l"].rlike(rb.SCOPE))
    differ = F.when(
        ~question & ~F.col("s").rlike(rb.NEGATION) & ~F.col("s").rlike("(?i)\\bwhether\\b"), _all(F.col("s"), rb.KIND_DIFFER)
    ).otherwise(_none())
    cut = F.trim
    return _problem(
        df, "comparison",
        F.concat(F.transform(compare, lambda x: cut(x["h"])), F.transform(ranks, lambda x: cut(x["h"])), F.transform(differ, cut)),
    )


def check_backing(answers: DataFrame) -> DataFrame:
    """Vague quantities without a figure or a quote beside them.

    The figure may stand in the sentence before or after; after the opening claim, up to three later.
    """
    t = F.regexp_replace(F.coalesce("text", F.lit("")), rb.CITATION, " ")
    sents = F.filter(F.transform(F.split(t, "(?<=[.!?])[\"”’*_)]*\\s+"), tx.strip), lambda s: s != "")
    names = "|".join(sorted(rb.FRACTIONS, key=len, reverse=True))
    fraction = f"(?i)\\b(?:{names})\\b"
    df = answers.filter("route <> 'NONE'").select("answer_id", sents.alias("all")).select(
        "answer_id", "all", F.posexplode("all").alias("i", "s")
    )
    bare = F.regexp_replace("s", "^[*_ ]+|[*_ ]+$", "")
    near = F.when(F.col("i") == 0, F.slice("all", 1, 4)).otherwise(F.slice("all", F.col("i"), 3))
    backed = F.exists(near, lambda x: x.rlike(rb.SUPPORT) | x.rlike(fraction))
    bad = ~F.endswith(bare, F.lit("?")) & bare.rlike(rb.VAGUE) & ~bare.rlike(rb.REASONING) & ~backed
    return df.filter(bad).select("answer_id", F.lit("unbacked").alias("problem"), bare.alias("detail"))


def check_form(answers: DataFrame) -> DataFrame:
    """Length, closing question, what a refusal may hold, and what a full answer must cite."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = _word_count(F.regexp_replace(text, rb.CITATION, " "))
    refusal = F.col("route") == "NONE"
    lines = F.filter(F.transform(F.split(text, "\\n"), tx.strip), lambda ln: ln != "")
    last = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))
    cited = citations(text)
    bad_number = F.size(_unsupported(text, F.array().cast("array<double>"))) > 0
    quoted = F.exists(_all(text, rb.QUOTE, 1), lambda q: _word_count(q) >= 3)
    item = lambda cond, name, detail: F.when(cond, F.struct(F.lit(name).alias("problem"), detail.alias("detail")))
    found = F.array_compact(
        F.array(
            item(count > rb.MAX_WORDS, "length", F.concat(count.cast("string"), F.lit(" words"))),
            item(refusal & (F.size(cited) > 0), "refusal", F.lit("cites evidence")),
            item(refusal & bad_number, "refusal", F.lit("states a number")),
            item(refusal & quoted, "refusal", F.lit("quotes")),
            item(~refusal & ~last.rlike(rb.CLOSING_QUESTION), "closing", F.lit("no italic closing question")),
            item((F.col("route") == "FULL") & ~F.exists(cited, lambda c: F.startswith(c["table"], F.lit("analysis_"))), "evidence", F.lit("cites no counted row")),
        )
    )
    return answers.select("answer_id", F.explode(found).alias("x")).select("answer_id", "x.problem", "x.detail")


# ------------------------------------------------------------------------------- report
def audit(answers: DataFrame, rows: DataFrame, stories: DataFrame) -> DataFrame:
    """All checks: ``answer_id, problem, detail``."""
    parts = [
        check_numbers(answers, rows),
        check_arithmetic(answers),
        check_floor_claims(answers),
        check_proportions(answers, rows),
        check_backing(answers),
        check_percentages(answers),
        check_quotes(answers, rows, stories),
        check_citations(answers, rows, stories),
        check_proxy(answers),
        check_label_colon(answers),
        check_codes(answers),
        check_labels(answers),
        check_comparison(answers),
        check_jargon(answers),
        check_form(answers),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(answers: DataFrame, problems: DataFrame) -> DataFrame:
    """One row per answer: how many problems of how many kinds, and whether it passes."""
    per = problems.groupBy("answer_id").agg(
        F.count("*").alias("problems"), F.array_sort(F.collect_set("problem")).alias("kinds")
    )
    return answers.select("answer_id", "route").join(per, "answer_id", "left").select(
        "answer_id", "route", F.coalesce("problems", F.lit(0)).alias("problems"), F.coalesce("kinds", _none()).alias("kinds"),
        F.col("problems").isNull().alias("passes"),
    )


def sweep_summary(problems: DataFrame) -> DataFrame:
    """Problems by kind, and how many answers show each."""
    return problems.groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("answer_id").alias("answers"))


# ------------------------------------------------------------------------------- statements
def check_statements(statements: DataFrame, facts: DataFrame, free_numbers: Sequence[str], required: DataFrame | None = None) -> DataFrame:
    """Statements against the numbered facts they cite: ``path, problem, detail``.

    ``statements``: path, text, cites (array of fact ids). ``facts``: id, text. ``required``: column id of facts
    that some statement must cite.
    """
    cited = statements.select("path", F.explode("cites").alias("id")).join(facts, "id", "left")
    known = cited.groupBy("path").agg(
        F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), " ").alias("cited_text"),
        F.array_sort(F.collect_list(F.when(F.col("text").isNull(), F.col("id")))).alias("unknown"),
    )
    df = statements.join(known, "path", "left").withColumns(
        {
            "cited_text": F.regexp_replace(F.coalesce("cited_text", F.lit("")), "(?<=\\d),(?=\\d{3})", ""),
            "unknown": F.coalesce("unknown", _none()),
            "text": F.coalesce("text", F.lit("")),
        }
    )
    said = F.transform(_all(F.col("text"), rb.STATEMENT_NUMBER), lambda n: F.replace(n, F.lit(","), F.lit("")))
    held = F.transform(_all(F.col("cited_text"), "(?<![\\d.])\\d+(?:\\.\\d+)?(?![\\d])"), lambda n: n)
    stray = F.filter(said, lambda n: ~n.isin(list(free_numbers)) & ~F.array_contains(held, n))
    alone = F.filter(_in_context(F.col("text"), "\\d+(?:\\.\\d+)?%", 60), lambda x: ~x["b"].rlike(rb.STATEMENT_DENOMINATOR))
    one = lambda cond, name: F.when(cond, F.array(F.struct(F.lit(name).alias("problem"), F.lit("").alias("detail"))))
    many = lambda arr, name: F.transform(arr, lambda d: F.struct(F.lit(name).alias("problem"), d.alias("detail")))
    none = F.array().cast("array<struct<problem:string,detail:string>>")
    found = F.concat(
        F.coalesce(one(tx.strip(F.col("text")) == "", "empty text"), none),
        F.coalesce(one(F.size("cites") == 0, "cites no fact"), none),
        many(F.col("unknown"), "cites unknown fact"),
        many(stray, "number not in cited facts"),
        F.coalesce(one(F.col("text").rlike(rb.STATEMENT_PROXY), "share of users or searches"), none),
        many(F.transform(alone, lambda x: x["h"]), "percentage without n of N"),
        F.coalesce(one(F.col("text").rlike(rb.STATEMENT_MOVES_SHARE), "share of stories as an outcome"), none),
    )
    out = df.select("path", F.explode(found).alias("x")).select("path", "x.problem", "x.detail")
    if required is not None:
        used = statements.select(F.explode("cites").alias("id")).distinct()
        out = out.unionByName(
            required.join(used, "id", "left_anti").select(F.lit("").alias("path"), F.lit("required fact not cited").alias("problem"), F.col("id").alias("detail"))
        )
    return out


def facts_pack(facts: DataFrame) -> DataFrame:
    """Result rows as numbered facts: ``id, table, key, text``.

    ``facts``: table, key, label, stories, of, people (result rows). Numbered by table and key, in ranges.
    """
    share = F.concat(
        F.col("stories").cast("string"), F.lit(" of "), F.col("of").cast("string"),
        F.when(F.col("of") >= vocab.FLOOR, F.concat(F.lit(" ("), F.bround(100 * F.col("stories") / F.col("of"), 0).cast("int").cast("string"), F.lit("%)"))).otherwise(""),
    )
    text = F.concat(F.col("label"), F.lit(": "), F.coalesce(share, F.col("stories").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(", from "), F.col("people").cast("string"), F.lit(" people")), F.lit("")))
    return numbered(facts, ["table", "key"]).select(
        F.concat(F.lit("F"), F.when(F.col("nth") < 100, F.lpad(F.col("nth").cast("string"), 2, "0")).otherwise(F.col("nth").cast("string"))).alias("id"),
        "table", "key", text.alias("text"),
    )


def lost_facts(pack: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts whose row can no longer be selected by its key."""
    return pack.join(facts.select("table", "key"), ["table", "key"], "left_anti").select("id", "table", "key")
