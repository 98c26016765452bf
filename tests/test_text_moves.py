"""Texts are worked on once, and only their entity references go to Python."""

import html

from pyspark.sql import functions as F

from fieldnote.functions import html as hx
from fieldnote.plans import registry

from .conftest import SF

TEXTS = ["&lt;a&gt; &amp;amp; &notit; &#x41;&#66 &#128; &bad &", "&&lt", "no reference", "", None, "é&eacute;&copy2 😀&#128512;&#0;"]


def test_references_are_decoded_as_by_the_library(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    want = [t if t is None else html.unescape(t) for t in TEXTS]
    assert [r["x"] for r in rows.select("i", hx.unescape(F.col("t")).alias("x")).orderBy("i").collect()] == want
    lists = spark.createDataFrame([(0, TEXTS), (1, []), (2, None)], "i int, t array<string>")
    assert [r["x"] for r in lists.select("i", hx.unescape_each(F.col("t")).alias("x")).orderBy("i").collect()] == [want, [], None]


def test_no_text_goes_to_python(spark):
    plan = hx.unescape(F.col("text"))
    text = spark.createDataFrame([("a",)], "text string").select(plan)._jdf.queryExecution().optimizedPlan().toString()
    assert "_decoded(text" not in text and "_decoded(" in text


def test_texts_are_scrubbed_once(spark):
    for name in ("store_feed_texts", "answer_texts", "store_feed_records"):
        plan = registry.load()[name].job(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert not any("[PHONE]" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter"))
