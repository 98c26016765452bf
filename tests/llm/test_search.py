"""Exact search, main text, toxicity."""

import html
import re

import numpy as np
from pyspark.sql import functions as F

from fieldnote.llm.html_main import blocks, main_texts
from fieldnote.llm.mtree import nearest
from fieldnote.llm.toxicity import BLOCK, PRIOR_WEIGHT, Index, fitted_index, toxicity
from tests.conftest import SF

from .helpers import documents, none, odd


def test_search_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6)).round(1)
    x[100:400] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd_rows = [(5001, None), (5002, [1.0, None]), (5003, [float("nan")] * 6), (5004, [float("inf")] * 6), (5005, []), (None, [1.0] * 6), (5050, [1e6] * 2), (5051, [3.0, -1e6])]
    df = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(x * 256).astype(np.int64)
    for q in range(0, 3000, 50):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
        assert sorted(got[q]) == [(k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    assert set(got) == {*range(0, 3000, 50), 5050}


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(df, df).count() == 0


def test_block_index_is_exact():
    rng = np.random.default_rng(4)
    dense = rng.random((500, 40)) * (rng.random((500, 40)) < 0.1)
    dense[dense.sum(1) == 0, 0] = 1
    dense[100:200] = dense[rng.integers(0, 12, 100)]
    dense /= np.sqrt((dense**2).sum(1))[:, None]
    labels = rng.integers(0, 2, 500).astype(float)
    vectors = [(np.flatnonzero(r), r[r > 0]) for r in dense]
    index = Index(np.arange(40, dtype=np.uint64), np.ones(40), prior=0.3)
    index.fill(list(range(500)), labels, vectors)
    different = len({r.tobytes() for r in dense})
    assert len(index.n) == different < 420 and index.most.shape == (40, -(-different // BLOCK)) and index.n.sum() == 500
    entry = {t.tobytes() + w.tobytes(): g for g, (t, w) in enumerate(index.entries)}
    for i in range(0, 500, 7):
        s = dense @ dense[i]
        s[i] = -1
        last = np.sort(s)[::-1][24]
        near = (s > 0) & (s >= last - 1e-9)  # the 25 nearest of the others, and all as near as the last
        own = entry[vectors[i][0].tobytes() + vectors[i][1].tobytes()]
        found, scores = index.nearest(*vectors[i], 25, without=own)
        assert (index.n[found] - (found == own)).sum() == near.sum()
        want = ((s * labels)[near].sum() + PRIOR_WEIGHT * 0.3) / (s[near].sum() + PRIOR_WEIGHT)
        assert np.isclose(index.vote(found, scores, own, int(labels[i])), want)


def test_toxicity_on_held_out_rows(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = [(r["predicted"], r["toxic"]) for r in rows]
    toxic = [p for p, t in hit if t]
    clean = [p for p, t in hit if not t]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.05 * len(clean)
    flipped = toxicity(docs, labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert {r["doc_id"]: r["score"] for r in flipped.collect() if r["held_out"]} == {r["doc_id"]: r["score"] for r in toxicity(docs, labels).collect() if r["held_out"]}


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    rows = toxicity(odd(spark), labels, carry=("x", "text")).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows) and {r["x"] for r in rows} == {"c", None, ""}
    assert toxicity(none(spark), labels).count() == 0
    assert toxicity(documents(spark), labels.limit(0)).filter("predicted = 1").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "</p><article>";</script></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use</div><main><article><header><h1>T &amp; x</h1></header><p>one <a href=x>two</a><span class="ad">buy</span>
three<!-- c --><p>four&nbsp;4 &#x41;&eacute;<ul><li>i<li>ii</ul><table><tr><td>a<td>b<tr><td>c</table>
<section class="comments"><p>hey</p></section></article></main><aside>s</aside><form>q<input></form><footer>f</footer>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "http://a/x", PAGE, 0), (2, None, None, 0), (3, "", "", 0), (4, "//b", "plain <b>te</b>xt\n\n two &lt;", 0), (4, "//b", "plain <b>te</b>xt\n\n two &lt;", 0), (None, "x", "<p>a<br>b", 0)]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6
    assert by == {1: "T & x\none two three\nfour 4 Aé\ni\nii\na\nb\nc", 2: "", 3: "", 4: "plain text two <", None: "a b"}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_site_tree_removes_what_pages_repeat(spark):
    rows = [(i, f"https://h.example/{i}", f'<div class="top">Home of all</div><div class="body"><p>text number {i} alone</p></div><div>Read on</div>') for i in range(12)]
    rows += [(100 + i, f"https://one{i}.example/", '<div class="top">Home of all</div>') for i in range(3)]
    rows += [(200 + i, "https://copies.example/", "<div>always this</div>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text number {i} alone" for i in range(12))
    assert all(got[100 + i] == "Home of all" for i in range(3)) and all(got[200 + i] == "always this" for i in range(9))


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_texts(pages).collect()}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r["html"] or "", re.S)
        parts = re.split(r"</?(?:p|h1)[^>]*>", m.group(1) if m else "")
        lines = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)
    assert blocks("") == []


def _texts(spark, pages):
    rows = [(i, f"https://{host}.example/{i}", page) for i, (host, page) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_site_tree_decides_inside_and_outside_articles(spark):
    inside = [("in", f'<article><p>own words {i}</p><div class="box">Tell a friend</div><p>Written by our desk</p></article>') for i in range(12)]
    outside = [("out", f'<div class="top">Home</div><h1>Title {i}</h1><div class="text">{f"long {i} " * 30}</div><article><p>see also {i}</p></article>') for i in range(12)]
    single = [("one", f'<div>{"long " * 9}</div><article>card</article>'), ("two", f"<div>card</div><article>{'long ' * 9}</article>")]
    got = _texts(spark, inside + outside + single)
    assert got[:12] == [f"own words {i}" for i in range(12)]
    assert got[12:24] == ["\n".join([f"Title {i}", " ".join(f"long {i} ".split() * 30), f"see also {i}"]) for i in range(12)]
    assert got[24:] == [" ".join(["long"] * 9) + "\ncard", " ".join(["long"] * 9)]


def test_presentation_counts_beside_content(spark):
    # the same words everywhere, marked up differently on every page of one host and alike on the other
    tags = [[("b", "i", "em", "u", "s", "q")[(i >> (j % 4)) * (j + 1) % 6] for j in range(8)] for i in range(12)]
    page = lambda i, t: f"<div><p>text {i}</p></div><section>{' '.join(f'<{x}>w</{x}>' for x in t)}</section>"
    assert len({tuple(t) for t in tags}) == 12
    got = _texts(spark, [("varied", page(i, t)) for i, t in enumerate(tags)] + [("alike", page(i, tags[0])) for i in range(12)])
    assert got[12:] == [f"text {i}" for i in range(12)]
    assert got[:12] == [f"text {i}\nw w w w w w w w" for i in range(12)]


def test_names_are_weighed(spark):
    text = "word " * 40
    for page in (
        f'<body class="has-sidebar"><p>{text}',
        f'<body class="sidebar"><p>{text}',
        f'<div class="content no-comments"><p>{text}</div>',
        f'<main id="search-result"><p>{text}</main>',
        f'<article class="related-topic"><p>{text}</article>',
        f'<div class="widget"><main><p>{text}</main></div>',
        f'<form id="login"><p>{text}</form><div class="sidebar">small</div>',
        f'<div class="search"><div class="search-item">{"word " * 20}</div> <div class="search-item">{"word " * 20}</div></div>',
        f'<article><div class="post share">{text}</div><div class="share">now</div></article><div class="comments">{"hey " * 99}</div>',
    ):
        assert " ".join(" ".join(b.text for b in blocks(page)).split()) == text.strip(), page
    got = _texts(spark, [("h", f'<div class="menu">{text}</div><p>own {i}') for i in range(9)])
    assert got == [f"own {i}" for i in range(9)]


def test_terms_of_large_samples_and_many_terms_are_all_indexed(spark):
    def index(rows):
        d = spark.createDataFrame(rows, "id long, text string, label int")
        return fitted_index(d.select("id", "text"), d.select("id", "label"))

    # 16,000 examples; a word that 45 toxic ones hold, another that the rest of them share
    rows = [(i, f"x{i} y{i} z{i} " + ("" if i % 2 else "rareslur" if i < 90 else "slur"), 1 - i % 2) for i in range(16_000)]
    assert len(index(rows).terms) == 2
    rng = np.random.default_rng(1)
    many = [(i, " ".join(f"{'t' if i % 2 else 'c'}{j}" for j in rng.permutation(1_100)), i % 2) for i in range(80)]
    assert len(index(many).terms) == 2_200
