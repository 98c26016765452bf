"""Lists inside a row: scans in linear time, interval matching, spans of short posts."""

import random
import time

from pyspark.sql import functions as F

from fieldnote.functions import text as tx
from fieldnote.operators import spans as sp

LONG = 100_000


def seconds(df):
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


def test_running_sums_and_chains(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 7, 8, 9, 31, 32, 33, 300])] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, x array<int>")
    # a chain over the sorted numbers: the next one is at least 3 larger
    out = df.select("x", tx.running_sums(F.col("x")).alias("sums"), tx.chain(F.array_sort("x"), lambda a, b: b >= a + 3).alias("chain"))
    for r in out.collect():
        if r["x"] is None:
            assert r["sums"] is None and r["chain"] is None
            continue
        want = []
        for v in sorted(r["x"]):
            if not want or v >= want[-1] + 3:
                want.append(v)
        assert r["sums"] == [sum(r["x"][: i + 1]) for i in range(len(r["x"]))] and r["chain"] == want


def test_records_of_very_many_posts_take_linear_time(spark):
    posts = spark.range(LONG).select(F.lit("t").alias("thread_id"), F.col("id").cast("int").alias("ordinal"), F.lit("a").alias("author_key"), F.lit("some words").alias("text"))
    threads = sp.assemble_threads(posts)
    row = threads.select(F.size("posts").alias("n"), F.get("posts", LONG - 1)["start"].alias("at")).first()
    assert (row["n"], row["at"]) == (LONG, 12 * (LONG - 1))
    assert seconds(threads) < 10
    records = threads.withColumnRenamed("thread_id", "record_id")
    assert sp.chunk_threads(records, 1000).count() == LONG / 100
    assert seconds(sp.chunk_threads(records, 1000)) < 10
    spans = spark.range(LONG).select(F.lit("t").alias("record_id"), (F.col("id") * 10).cast("int").alias("char_start"), (F.col("id") * 10 + 7 + 10 * (F.col("id") % 2)).cast("int").alias("char_end"))
    merged = sp.merge_spans(spans)
    assert merged.select("n_kept").first()[0] >= LONG / 2
    assert seconds(merged) < 10
    ids = spans.filter("char_start % 20 = 0").withColumn("id", F.col("char_start").cast("string"))
    assert seconds(sp.match_intervals(ids, ids)) < 10


def brute_matches(xs, ys):
    used, out = set(), []
    for s, e, i in sorted(xs):
        for t, f, j in sorted(ys):
            common = min(e, f) - max(s, t)
            if j not in used and common > 0 and common >= 0.5 * min(e - s, f - t):
                used.add(j)
                out.append((i, j))
                break
    return out


def test_matched_intervals_equal_brute_force(spark):
    rng = random.Random(8)
    first, second, want = [], [], []
    for r in range(40):
        sides = []
        for side in "xy":
            at, own = 0, []
            for k in range(rng.randrange(25)):
                at += rng.randrange(12)
                end = at + rng.choice([1, 3, 8, 20, 60])
                own.append((at, end, f"{side}{k}"))
                at = end
            sides.append(own)
        first += [(f"r{r}", *x) for x in sides[0]]
        second += [(f"r{r}", *x) for x in sides[1]]
        want += [(f"r{r}", *m) for m in brute_matches(*sides)]
    schema = "record_id string, char_start int, char_end int, id string"
    a, b = spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    for bucket in (4096, 7):
        assert sorted(tuple(r) for r in sp.match_intervals(a, b, bucket).collect()) == sorted(want)
    assert sp.match_intervals(a.limit(0), b).count() == 0


def test_short_posts_are_located(spark):
    records = spark.createDataFrame([("r", "a\n\nword\n\ntwo words", "z")], "record_id string, text_clean string, author_key string").withColumn(
        "posts", F.expr("array(named_struct('author_key', 'p', 'start', 0, 'end', 1), named_struct('author_key', 'q', 'start', 3, 'end', 7), named_struct('author_key', 'p', 'start', 9, 'end', 18))")
    )
    asked = [("r", 1, "a", "a"), ("r", 2, "word", "rd"), ("r", 3, "two", "words"), ("r", 3, " ", "words"), ("r", 4, "a", "a")]
    rows = spark.createDataFrame([(*x, "core", "", 1.0, 3) for x in asked], "record_id string, post int, start string, end string, bucket string, reason string, confidence double, reaches_stage int")
    got = sorted(((r["post"], r["char_start"], r["char_end"], r["author_key"]) for r in sp.locate_stories(rows, records).collect()), key=str)
    assert got == [(1, 0, 1, "p"), (2, 3, 7, "q"), (3, 9, 18, "p"), (3, None, None, "p"), (4, None, None, None)]


def test_slices_of_text_keep_their_quotation_marks(spark, tmp_path):
    """A slice that begins or ends with a mark gives the row that the SQL gives; a search that someone typed loses its marks."""
    from fieldnote.plans import registry

    text = "x" * 49 + '" Whble thsh an' + " and so on"
    folder = str(tmp_path)
    spark.createDataFrame([(1, text, "src1"), (2, "y" * 50 + "ae8bf92c95a35\" end", "src2")], "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    q = registry.load()["queries_in_text"]
    got = {tuple(r) for r in q.job(spark, folder).select("story_id", "query_text", "attempt_no", "in_text").collect()}
    import duckdb

    own = duckdb.connect()
    own.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert got == set(own.execute(q.sql).fetchall()) and ("1", '" whble thsh an', 1, True) in got
