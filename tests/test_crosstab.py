"""Cross-tabs: different people are counted by bits, whatever part, word or slice they fall into."""

import random
import re
from collections import defaultdict

import pytest

from fieldnote.operators import crosstab as ct


def rows_of():
    rng = random.Random(3)
    spine = [(f"s{i}", rng.choice(["core", "core", "adjacent", "irrelevant"]), rng.choice([None, "hot"] + [f"a{k}" for k in range(600)]) if i % 3 else "hot", rng.choice("12"), rng.choice(["x", None])) for i in range(1500)]
    codes = [(s[0], q, rng.choice(["u", "v", "not_stated"])) for s in spine for q in ("3.2", "5.6") for _ in range(rng.randrange(3))]
    return spine, codes


def tables(spark):
    spine, codes = rows_of()
    return spark.createDataFrame(spine, "story_id string, population string, author_key string, primary_stage string, photo_class string"), spark.createDataFrame(codes, "story_id string, question string, value string")


@pytest.mark.parametrize("parts, slice_", [(1024, 1_000_000), (1, 100)])
def test_people_are_counted_once(spark, monkeypatch, parts, slice_):
    monkeypatch.setattr(ct, "PARTS", parts)
    monkeypatch.setattr(ct, "SLICE", slice_)
    spine, codes = rows_of()
    who = {s[0]: s for s in spine}
    cells, asked = defaultdict(list), defaultdict(set)
    for key in {(s[0], "primary_stage", s[3]) for s in spine} | {(i, f"q:{q}", v) for i, q, v in codes}:
        _, population, author, _, klass = who[key[0]]
        if population != "irrelevant":
            for seg in ("_all", klass or "None"):
                asked[(f"{population}.{key[1]}", seg)].add(key[0])
                if key[2] != "not_stated" or key[1] == "primary_stage":
                    cells[(f"{population}.{key[1]}", key[2], seg)].append(author)
    want = {(a, v, seg, len(x), len(asked[(a, seg)]), len({w for w in x if w is not None})) for (a, v, seg), x in cells.items()}
    got = ct.crosstab(*tables(spark), "r", fields=["primary_stage"], extra=[])
    assert {(r.dim_a, r.val_a, r.val_b, r.n, r.denom, r.n_authors) for r in got.collect()} == want


def test_no_rows_per_person_are_shuffled(spark):
    plan = ct.crosstab(*tables(spark), "r", fields=["primary_stage"], extra=[])._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in re.findall(r"hashpartitioning\([^)]*\)", plan) if "author_key" in x]
