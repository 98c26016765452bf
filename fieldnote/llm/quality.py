"""Quality rules and distribution divergence of texts, in DataFrame expressions only.

A text is compared with the other texts of its language by two histograms: character classes, and common words
(function words of the language, each its own bin, all other words one bin). The reference of a language is the
sum over all its texts that pass the base rules. The distance is Jensen-Shannon (base 2, square root), in 0..1.
Short texts have noisy histograms and would be far from any reference: below a minimum length a distance is null
and decides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote.llm.store import stored

SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Common words of each language, from public stop-word lists.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "at", "this", "from", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
CLASSES = {"lower": "[^a-z]+", "upper": "[^A-Z]+", "digit": "[^0-9]+", "symbol": "[^#*$%&|<>]+", "mark": r"[^!-~]+|[0-9A-Za-z#*$%&|<>]+"}

MIN_CHARS = 200
MIN_WORDS = 40
MAX_CHAR_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.55
MIN_WORDS_TOGETHER = 100
MAX_TOGETHER = 0.48


def _without(c: Column, chars: str) -> Column:
    return F.length(F.translate(c, chars, ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS)), " ", -1), lambda w: w != "")


def counted(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Per row: base counts, and the two histograms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"))
    n_space = F.length("text") - _without(F.col("text"), SPACE_CHARS)
    d = d.withColumn("n_chars", F.length("text")).withColumn("word_chars", F.length("text") - n_space)
    d = d.withColumn("w", words_of(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_words", F.size("w")).withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    last = F.col("n_words") - 5
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("hw", i + j) for j in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("windows", windows)
    sorted_windows = F.sort_array("windows")
    d = d.withColumn("ordered", sorted_windows).withColumn("again", F.exists(F.transform("ordered", lambda h, i: h == F.get("ordered", i - 1)), lambda x: x))
    ranked = F.when(F.col("again"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("ranked", ranked)
    d = d.withColumn("at", F.sort_array(F.transform(F.filter("ranked", lambda x, j: (x["h"] == F.get("ranked", j - 1)["h"]) | (x["h"] == F.get("ranked", j + 1)["h"])), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda x, j: F.least(F.lit(5), F.coalesce(F.get("at", j + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    known = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = list(dict.fromkeys(x for v in COMMON_WORDS.values() for x in v))
    d = d.withColumn("common", F.filter(F.transform("w", lambda x: F.lower(x)), lambda x: x.isin(every)))
    d = d.withColumn("list", F.coalesce(F.element_at(known, F.col("lang")), F.array(*map(F.lit, every))))
    hist = F.transform("list", lambda c: F.size(F.filter("common", lambda x: x == c)).cast("double"))
    chars = [F.length(F.regexp_replace("text", p, "")).cast("double") for p in CLASSES.values()]
    d = d.select(
        "id", "lang", "n_chars", "n_words", "word_chars",
        (F.col("n_chars") - _without(F.col("text"), SYMBOLS)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
        F.array(*chars).alias("chars"), hist.alias("words"),
    )
    rest = lambda total, h: F.greatest(total.cast("double") - F.aggregate(h, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return d.withColumn("chars", F.concat("chars", F.array(rest(F.col("n_chars"), F.col("chars"))))).withColumn("words", F.concat("words", F.array(rest(F.col("n_words"), F.col("words")))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null where one is empty."""

    def total(h: Column) -> Column:
        return F.aggregate(h, F.lit(0.0), lambda a, x: a + x)

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    pairs = F.transform(F.arrays_zip(p.alias("p"), q.alias("q")), lambda x: F.struct((x["p"] / total(p)).alias("p"), (x["q"] / total(q)).alias("q")))
    divergence = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + term(x["p"], (x["p"] + x["q"]) / 2) / 2 + term(x["q"], (x["p"] + x["q"]) / 2) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, base counts, ``base_failed``, ``char_distance``, ``word_distance``, ``kept``.

    A text is kept if it passes the base rules, neither distance is above its limit, and in a text of enough words
    their sum is not above a third limit; a null distance (too short, or no reference) passes. Null texts have no words and fail the base rules. Rows without a language are compared
    with each other over all common words. Empty tables give none.
    """
    d = counted(docs, id_col, text_col, lang_col)
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words").cast("long") > 20 * F.col("n_words").cast("long")))
    d = stored(d, "counts")
    sums = lambda c, n: F.array(*[F.sum(F.get(c, i)) for i in range(n)])
    every = len(dict.fromkeys(x for v in COMMON_WORDS.values() for x in v))
    refs = d.filter("not base_failed").groupBy(F.coalesce("lang", F.lit("")).alias("ref")).agg(sums("chars", len(CLASSES) + 1).alias("ref_chars"), sums("words", every + 1).alias("ref_words"))
    refs = refs.withColumn("ref_words", F.filter("ref_words", lambda x: x.isNotNull()))
    j = d.join(refs, F.coalesce(d["lang"], F.lit("")) == refs["ref"], "left")
    char_distance = F.when(F.col("n_chars") >= MIN_CHARS, js_distance(F.col("chars"), F.col("ref_chars")))
    word_distance = F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("words"), F.col("ref_words")))
    j = j.withColumn("char_distance", char_distance).withColumn("word_distance", word_distance)
    good = ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    far_together = (F.col("n_words") >= MIN_WORDS_TOGETHER) & (F.coalesce("char_distance", F.lit(0.0)) + F.coalesce("word_distance", F.lit(0.0)) > MAX_TOGETHER)
    good = good & ~far_together
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return j.select(F.col("id").alias(id_col), *longs, "base_failed", good.alias("kept"), "char_distance", "word_distance")
