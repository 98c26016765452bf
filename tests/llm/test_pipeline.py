"""The pipeline's stages: what they keep, on the test documents and on odd rows."""

import corpus_pipeline as pipeline
from fieldnote.llm.store import stored
from tests.conftest import SF

from .helpers import WORD, brute_components, brute_repeats, documents, none, odd


def test_stages_against_brute_force(spark):
    docs = documents(spark).cache()
    clean = stored(pipeline.drop_toxic(spark, docs, SF), "clean")
    assert clean.columns == pipeline.COLUMNS and clean.exceptAll(docs.select(*pipeline.COLUMNS)).count() == 0
    assert 0.7 * docs.count() < clean.count() <= docs.count()

    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    group = brute_components(list(rows.items()), 5, 80)
    first = stored(pipeline.drop_near_copies(spark, clean, SF), "first")
    assert sorted(r["doc_id"] for r in first.collect()) == sorted(set(group.values()))

    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    want = brute_repeats(list(texts.items()))
    cut = stored(pipeline.cut_repeats(spark, first, SF), "cut")
    got = {r["doc_id"]: r for r in cut.collect()}
    for i, t in texts.items():
        whole = len(WORD.findall(t or ""))
        if len(want[i]) == whole:
            assert got[i]["text"] == t
        elif want[i]:
            assert got[i]["text"] == " ".join(want[i]) and got[i]["n_chars"] == len(got[i]["text"])
        else:
            assert i not in got

    mixed = stored(pipeline.mix(spark, cut, SF), "mixed")
    words = sum(len(WORD.findall(r["text"] or "")) for r in cut.collect())
    taken = sum(len(WORD.findall(r["text"])) for r in mixed.collect())
    assert mixed.columns == pipeline.COLUMNS and abs(taken - 1.5 * words) < 0.1 * words
    packed = pipeline.pack(spark, mixed, SF)
    assert packed.filter("piece = 0").count() == mixed.count()


def test_pipeline_of_odd_rows_and_of_nothing(spark):
    for rows in (odd(spark), none(spark)):
        docs = rows.select(*pipeline.COLUMNS)
        for name, stage in pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
        assert (docs.count() > 0) == (rows.count() > 0)
