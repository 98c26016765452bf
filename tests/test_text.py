"""Text columns on literal rows."""

import pytest
from pyspark.sql import functions as F

from fieldnote.functions import html as hx
from fieldnote.functions import shares as sh
from fieldnote.functions import spans as sf
from fieldnote.functions import text as tx


def values(spark, rows, column, kind="t string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], kind).select(column).collect()]


def test_normalise_keeps_lines_and_case(spark):
    assert values(spark, [" A \tB!! \r\n\r\n\r\n\r\n c \r"], tx.normalise(F.col("t"))) == ["A B!!\n\nc"]


@pytest.mark.parametrize(
    "text, scrubbed, kinds",
    [
        ("call +91 98765 43210 now", "call [PHONE] now", ["PHONE"]),
        ("2019 or 2020", "2019 or 2020", []),
        ("1234 5678 9012", "[ID_NUMBER]", ["AADHAAR"]),
        ("é@bob hi @al_x u/some_one", "é@bob hi [HANDLE] [HANDLE]", ["HANDLE"]),
        ("see https://a.b/c?d and me@x.co.uk", "see [URL] and [EMAIL]", ["URL", "EMAIL"]),
        ("ABCDE1234F", "[ID_NUMBER]", ["PAN"]),
        ("card 41111111111111 ok", "card [LONG_NUMBER]ok", ["CARD"]),
        ("no data here", "no data here", []),
    ],
)
def test_scrub(spark, text, scrubbed, kinds):
    row = spark.createDataFrame([(text,)], "t string").select(tx.scrub(F.col("t")), tx.scrub_kinds(F.col("t"))).first()
    assert (row[0], row[1]) == (scrubbed, kinds)


def test_a_kept_and_a_replaced_number_are_not_confused(spark):
    text = "12 34 56 78 9 and 98765 43210 and 12 34 56 78 9"
    assert values(spark, [text], tx.scrub(F.col("t"))) == ["12 34 56 78 9 and [PHONE] and 12 34 56 78 9"]


@pytest.mark.parametrize(
    "text, lang",
    [
        ("", "unknown"), ("!!! 123", "unknown"), ("photo nahi mil rahi yaar", "hi-Latn"), ("मेरी फोटो", "hi"),
        ("मेरी फोटो and some more english words", "mixed"), ("写真が見つからない", "other"), ("I cannot find my photo", "en"),
    ],
)
def test_language(spark, text, lang):
    assert values(spark, [text], tx.detect_language(F.col("t"))) == [lang]


@pytest.mark.parametrize(
    "value, iso",
    [
        ("1700000000", "2023-11-14T22:13:20+00:00"), ("1700000000000", "2023-11-14T22:13:20+00:00"), ("2024-05-01T01:02:03-07:00", "2024-05-01T08:02:03+00:00"),
        ("2024-05-01", "2024-05-01T00:00:00+00:00"), ("Sat Sep 26 10:11:12 +0000 2026", "2026-09-26T10:11:12+00:00"), ("9/21/2026, 2:51:13 AM", "2026-09-21T02:51:13+00:00"),
        ("yesterday", None), ("", None),
    ],
)
def test_timestamps(spark, value, iso):
    assert values(spark, [value], tx.to_iso(F.col("t"))) == [iso]


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        got = values(spark, ["2024-05-01T01:02:03", "9/21/2026, 2:51:13 AM"], tx.to_iso(F.col("t")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-05-01T01:02:03+00:00", "2026-09-21T02:51:13+00:00"]


def test_no_salt_no_author_keys(spark):
    with pytest.raises(ValueError):
        tx.author_key(F.lit("s"), F.lit("h"), "")


def test_html(spark):
    assert values(spark, ["<p>a &lt; b</p><b>c</b>&eacute;<br>d"], hx.html_to_text(F.col("t"))) == ["a < b\ncé\nd"]


def test_gate_order_and_white_space(spark):
    p = tx.lexicon_patterns(["had to scroll", "ask photos"])
    got = values(spark, ["I HAD  to\nscroll", "what to type", "an old photo", "tax question", "मेरी फोटो"], tx.gate_reason(F.col("t"), p))
    assert got == ["lexicon:had\\s+to\\s+scroll", "strong retrieval phrase", "photo-like thing", None, "photo-like thing"]


def test_quotes_are_found_through_white_space_and_curly_marks_only(spark):
    region = F.array(F.struct(F.lit(0).alias("start"), F.lit(10).alias("end")), F.struct(F.lit(10).alias("start"), F.lit(80).alias("end")))
    text = "intro 12345 I can’t   find\nthat “old” picture 😀 of mine"
    quotes = ["I can't find that \"old\" picture", "i can't find that old picture", "find that", "picture 😀 of mine"]
    df = spark.createDataFrame([(text, q) for q in quotes], "text string, q string")
    got = [r[0] for r in df.select(sf.verify(F.col("text"), F.col("q"), region)).collect()]
    assert got == ["I can’t   find\nthat “old” picture", None, None, "picture 😀 of mine"]


def test_locate_counts_characters_not_bytes(spark):
    df = spark.createDataFrame([("😀😀 first words here and last words there",)], "text string")
    posts = F.array(F.struct(F.lit("a").alias("author_key"), F.lit(0).alias("start"), F.length("text").alias("end")))
    at = df.select(sf.locate(F.col("text"), posts, F.lit(1), F.lit("first words"), F.lit("last words"))).first()[0]
    assert (at["start"], at["end"]) == (3, 34)


def test_shares(spark):
    df = spark.createDataFrame([(5, 20), (13, 48), (31, 115), (0, 200)], "n int, d int")
    rows = sh.with_share(df, "n", "d").collect()
    assert [r["tier"] for r in rows] == ["insufficient", "directional", "comparable", "comparable"]
    assert rows[0]["share"] == "5 of 20" and rows[0]["pct"] is None
    assert rows[2]["share"] == "27% (31 of 115)"
    words = [r[0] for r in df.select(sh.in_words(F.col("n"), F.col("d"))).collect()]
    assert words == [None, "about a quarter", "about a quarter", "only a handful"]


def test_fisher_matches_exact_sums(spark):
    from math import comb

    cases = [(3, 100, 20, 90), (31, 115, 40, 200), (0, 80, 0, 80), (80, 80, 0, 80), (500, 1000, 560, 1000)]

    def exact(na, da, nb, db):
        row, col, total = da, na + nb, da + db
        p = [comb(col, x) * comb(total - col, row - x) / comb(total, row) for x in range(max(0, row + col - total), min(row, col) + 1)]
        seen = comb(col, na) * comb(total - col, row - na) / comb(total, row)
        return min(1.0, sum(x for x in p if x <= seen * (1 + 1e-9)))

    df = spark.createDataFrame(cases, "a int, b int, c int, d int")
    got = [r[0] for r in df.select(sh.fisher_p(*[F.col(c) for c in "abcd"])).collect()]
    for g, c in zip(got, cases, strict=True):
        assert g == pytest.approx(exact(*c), rel=1e-6)
