"""Text columns. Every function takes and returns Spark columns and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldnote import vocab

def let(value: Column, body) -> Column:
    """Work a value out once and hand it to ``body``, which may use it many times."""
    return F.get(F.transform(F.array(value), body), 0)


def _bits(n: Column) -> Column:
    return F.length(F.bin(n))


def running_sums(numbers: Column) -> Column:
    """Sums up to and with each number of a list, by doubling: as many passes as the length has binary digits.

    A fold that appends to its state would copy the whole list at each step.
    """

    def add(acc: Column, k: Column) -> Column:
        return let(F.pow(F.lit(2), k).cast("int"), lambda d: F.transform(acc, lambda v, i: v + F.coalesce(F.get(acc, i - d), F.lit(0))))

    return F.aggregate(F.sequence(F.lit(0), _bits(F.size(numbers)) - 1), numbers, add)


def chain(items: Column, after: Callable[[Column, Column], Column]) -> Column:
    """The first item, then always the first later one that comes ``after`` the last taken: greedy, in n log n steps.

    ``after(taken, item)`` must stay true for all later items once it is true. The next item of each is found by
    halving; jumps over 1, 2, 4, ... items then lead to the m-th taken item without walking there.
    """

    def of(xs: Column, n: Column) -> Column:
        def next_of(x: Column, i: Column) -> Column:
            def halve(acc: Column, _: Column) -> Column:
                mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
                hit = let(mid, lambda m: F.struct(m.alias("m"), after(x, F.get(xs, m)).alias("yes")))
                moved = let(hit, lambda h: F.when(h["yes"], F.struct(acc["lo"].alias("lo"), h["m"].alias("hi"))).otherwise(F.struct((h["m"] + 1).alias("lo"), acc["hi"].alias("hi"))))
                return F.when(acc["lo"] < acc["hi"], moved).otherwise(acc)

            return F.aggregate(F.sequence(F.lit(0), _bits(n)), F.struct((i + 1).alias("lo"), n.alias("hi")), halve, lambda acc: acc["lo"])

        first = F.array(F.concat(F.transform(xs, next_of), F.array(n)))

        def twice(acc: Column, _: Column) -> Column:
            return let(F.element_at(acc, -1), lambda last: F.concat(acc, F.array(F.transform(last, lambda j: F.get(last, j)))))

        def taken(jumps: Column) -> Column:
            top = F.size(jumps) - 1

            def leap(acc: Column, k: Column) -> Column:
                goal = F.get(F.get(jumps, k), acc["at"])
                return F.when(goal < n, F.struct(goal.alias("at"), (acc["m"] + F.pow(F.lit(2), k).cast("int")).alias("m"))).otherwise(acc)

            most = F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.struct(F.lit(0).alias("at"), F.lit(0).alias("m")), leap, lambda acc: acc["m"])

            def place(m: Column) -> Column:
                return F.aggregate(F.sequence(F.lit(0), top), F.lit(0), lambda at, k: F.when(F.getbit(m, k) == 1, F.get(F.get(jumps, k), at)).otherwise(at))

            return let(most, lambda last: F.transform(F.sequence(F.lit(0), last), lambda m: F.get(xs, place(m))))

        return let(F.aggregate(F.sequence(F.lit(1), _bits(n)), first, twice), taken)

    return let(items, lambda xs: F.when(F.size(xs) > 0, let(F.size(xs), lambda n: of(xs, n))).otherwise(xs))


def matches(text: Column, pattern: str) -> Column:
    """Every match and where it starts, in characters: ``array<struct<h, at>>``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(hits.alias("h"), F.slice(gaps, 1, F.size(hits)).alias("g"))
    placed = let(pairs, lambda ps: F.arrays_zip(ps.alias("p"), running_sums(F.transform(ps, lambda x: F.length(x["g"]) + F.length(x["h"]))).alias("end")))
    return F.transform(placed, lambda x: F.struct(x["p"]["h"].alias("h"), (x["end"] - F.length(x["p"]["h"])).alias("at")))


# Every character that counts as white space when a line or a text is trimmed, newline apart.
_SPACE = "\\t\\x0B\\f\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def strip(text: Column) -> Column:
    """Trim white space, new lines included, at both ends."""
    return F.regexp_replace(text, f"^[\\n{_SPACE}]+|[\\n{_SPACE}]+\\z", "")


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[\\n{_SPACE}]+", " "))


def normalise(text: Column) -> Column:
    """White space only: one line-break form, single spaces, trimmed lines, no run of blank lines."""
    t = F.regexp_replace(text, "\\r\\n?", "\n")
    t = F.regexp_replace(t, "[ \\t\\f\\x0B\\xa0]+", " ")
    t = F.regexp_replace(t, f"(?md)^[{_SPACE}]+|[{_SPACE}]+$", "")
    return strip(F.regexp_replace(t, "\\n{3,}", "\n\n"))


def is_deleted(text: Column) -> Column:
    return text.isNull() | F.lower(strip(text)).isin(vocab.DELETED_MARKERS)


def is_bot(author: Column) -> Column:
    name = F.regexp_replace(F.lower(strip(F.coalesce(author, F.lit("")))), "^u/", "")
    return name.isin(vocab.BOT_AUTHORS) | name.rlike("[-_]bot$")


def record_id(source: Column, native_id: Column) -> Column:
    return F.sha1(F.concat(source, F.lit("‖"), native_id.cast("string")))


def author_key(source: Column, handle: Column, salt: str) -> Column:
    """A salted pseudonym, scoped to the source; NULL where there is no author."""
    if not salt:
        raise ValueError("a salt is required before author keys are written")
    name = F.lower(strip(handle))
    key = F.substring(F.sha2(F.concat_ws("::", F.lit(salt), source, name), 256), 1, 32)
    return F.when(handle.isNull() | name.isin(vocab.DELETED_MARKERS), F.lit(None)).otherwise(key)


def to_iso(value: Column) -> Column:
    """UTC ISO seconds from an epoch (s or ms), ISO text, or the two long date forms; NULL if bad.
    A time without an offset is UTC, whatever the session's own zone is."""
    v = strip(value.cast("string"))
    number = v.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    seconds = F.when(seconds.between(-62135596800, 253402300799), F.floor(seconds))
    iso = F.regexp_replace(v, "Z$", "+00:00")
    iso = F.when(iso.rlike("[+-]\\d{2}:?\\d{2}$") & iso.rlike(":"), iso).otherwise(
        F.concat(F.when(iso.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.concat(iso, F.lit("T00:00:00"))).otherwise(iso), F.lit("+00:00"))
    )
    # The name of the day carries no information and is dropped before parsing.
    long_form = F.regexp_replace(v, "^[A-Za-z]{3} ", "")
    clock = F.concat(F.regexp_replace(v, "\\x{202F}", " "), F.lit(" +0000"))
    stamp = F.coalesce(
        F.when(v.rlike("^\\d{4}-\\d{2}-\\d{2}"), iso.try_cast("timestamp")),
        F.when(
            v.rlike("^[A-Za-z]{3} [A-Za-z]{3} \\d"),
            F.try_to_timestamp(long_form, F.lit("MMM d HH:mm:ss xx yyyy")),
        ),
        F.when(
            v.rlike("^\\d{1,2}/\\d{1,2}/\\d{4}, "),
            F.try_to_timestamp(clock, F.lit("M/d/yyyy, h:mm:ss a xx")),
        ),
    )
    total = F.coalesce(seconds, F.unix_seconds(stamp))
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=total.cast("decimal(18,6)"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def words(text: Column) -> Column:
    """ASCII word tokens, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def search_terms(text: Column) -> Column:
    """Retrieval tokens: ASCII or Devanagari runs of two or more characters, stop words removed."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+|[\\u0900-\\u097F]+"), F.lit(0))
    return F.filter(runs, lambda w: ~w.isin(vocab.STOP_WORDS) & (F.length(w) > 1))


def exact_key(text: Column) -> Column:
    return F.sha1(F.array_join(words(text), " "))


def detect_language(text: Column) -> Column:
    """``en | hi | hi-Latn | mixed | other | unknown`` from scripts and marker words."""
    latin = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    n = F.size(latin)
    strong_words = [w for w in vocab.HINGLISH_MARKERS if w not in vocab.HINGLISH_WEAK]
    strong = F.size(F.filter(latin, lambda w: w.isin(strong_words)))
    marked = F.size(F.filter(latin, lambda w: w.isin(vocab.HINGLISH_MARKERS)))
    hinglish = (strong >= 2) | ((strong >= 1) & (marked >= 2)) | ((strong == 1) & (n <= 8))
    return (
        F.when(text.isNull() | (strip(text) == ""), "unknown")
        .when(text.rlike(vocab.DEVANAGARI), F.when(text.rlike("[A-Za-z]") & (n > 3), "mixed").otherwise("hi"))
        .when(text.rlike(vocab.OTHER_SCRIPT), "other")
        .when(n == 0, "unknown")
        .when(hinglish, "hi-Latn")
        .otherwise("en")
    )


def too_short(text: Column, floor: int = vocab.MIN_CHARS) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9\\u0900-\\u097F]", "")) < floor


def _scrub_phones(text: Column) -> Column:
    """Replace phone candidates by digit count. The text is cut at its candidates and put together
    again, so a kept and a replaced candidate with the same spelling are never confused."""
    low, high = vocab.PHONE_DIGITS
    hits = F.regexp_extract_all(text, F.lit(vocab.PHONE_CANDIDATE), F.lit(0))
    gaps = F.split(text, vocab.PHONE_CANDIDATE, -1)
    shown = F.transform(
        hits,
        lambda h: F.when(F.length(F.regexp_replace(h, "(?U)\\D", "")).between(low, high), "[PHONE]").otherwise(h),
    )
    rebuilt = F.array_join(
        F.zip_with(gaps, shown, lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit("")))), ""
    )
    return F.when(F.size(hits) == 0, text).otherwise(rebuilt)


# A rule is only tried on texts that hold what every match of it must hold.
_HINT = {
    "URL": "(?i)https?://|www\\.",
    "EMAIL": "@",
    "HANDLE": "@|u/",
    "PAN": "(?U)\\d{4}",
    "AADHAAR": "(?U)\\d{4}",
    "CARD": "(?U)\\d",
    "PHONE": "(?U)\\d",
}


def _rules():
    def replace(pattern: str, placeholder: str):
        return lambda t: F.regexp_replace(t, pattern, placeholder)

    return [*[(kind, replace(p, r)) for kind, r, p in vocab.SCRUB_RULES], ("PHONE", _scrub_phones)]


def scrubbed(text: Column) -> Column:
    """``struct(text, kinds)``: the text with personal data replaced, and the kinds found, in rule order."""
    none = F.array().cast("array<string>")
    state = F.struct(text.alias("text"), none.alias("kinds"))
    for kind, rule in _rules():
        state = let(state, _step(kind, rule))
    return state


def _step(kind: str, rule):
    def step(s: Column) -> Column:
        def note(new: Column) -> Column:
            kinds = F.when(new != s["text"], F.concat(s["kinds"], F.array(F.lit(kind)))).otherwise(s["kinds"])
            return F.struct(new.alias("text"), kinds.alias("kinds"))

        return F.when(s["text"].rlike(_HINT[kind]), let(rule(s["text"]), note)).otherwise(s)

    return step


def scrub(text: Column) -> Column:
    """Personal data replaced by typed placeholders, rule by rule."""
    return scrubbed(text)["text"]


def scrub_kinds(text: Column) -> Column:
    """The kinds a scrub replaces, in rule order."""
    return scrubbed(text)["kinds"]


def leaks(text: Column) -> Column:
    """Kinds of personal data still present."""
    low, high = vocab.PHONE_DIGITS
    pattern = {kind: p for kind, _, p in vocab.SCRUB_RULES}
    phones = F.regexp_extract_all(text, F.lit(vocab.PHONE_CANDIDATE), F.lit(0))
    phone = F.exists(phones, lambda h: F.length(F.regexp_replace(h, "(?U)\\D", "")).between(low, high))
    return F.array_compact(
        F.array(
            F.when(text.rlike(pattern["EMAIL"]), "email"),
            F.when(text.rlike(pattern["HANDLE"]), "handle"),
            F.when(phone, "phone"),
        )
    )


def lexicon_patterns(terms: Sequence[str]) -> list[str]:
    """Search terms as patterns: literal text, any white space between words."""
    special = "\\.[]{}()*+?^$|#&~-"
    return ["\\s+".join("".join("\\" + c if c in special else c for c in w) for w in t.split(" ")) for t in terms]


def gate_reason(text: Column, patterns: Sequence[str]) -> Column:
    """The first rule that lets a text through the relevance gate; NULL when none does."""
    rule = None
    for p in patterns:
        hit = text.rlike("(?iu)" + p)
        rule = F.when(hit, f"lexicon:{p}") if rule is None else rule.when(hit, f"lexicon:{p}")
    any_term = text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))
    return (
        F.when(any_term, rule)
        .when(text.rlike(vocab.STRONG_PHRASE), "strong retrieval phrase")
        .when(text.rlike(vocab.THING_WORD) | text.rlike(vocab.THING_DEVANAGARI), "photo-like thing")
    )


def snippet(text: Column, span: Column, size: int = vocab.SNIPPET_CHARS) -> Column:
    """At most ``size`` characters of a text, moved to show ``span`` when it lies far in."""
    at = F.coalesce(F.instr(text, span), F.lit(0)) - 1
    low = F.when(at > 450, F.greatest(F.lit(0), at - 250)).otherwise(F.lit(0))
    cut = F.concat(F.when(low > 0, "… ").otherwise(""), F.substring(text, low + 1, F.lit(size)), F.lit(" …[cut]"))
    return F.when(F.length(text) > size, cut).otherwise(text)
