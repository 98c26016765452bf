"""Coverage, cross-tabs and the derived measures, from one long table of story values.

The long table has one row per story and value: ``story_id, population, source, author_key, dim, value``.
A story contributes a bounded number of values, so every table here is a group-by over it; nothing
joins a story's rows with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldnote import vocab
from fieldnote.operators import marks as mk


def live_spine(spine: DataFrame, stories: DataFrame, records: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Live coded stories with population, author and source beside the spine."""
    live = mk.live_stories(stories, exclusions).select(
        "story_id", "record_id", "author_key", F.col("bucket").alias("population")
    )
    return (
        spine.join(live, "story_id")
        .join(records.select("record_id", "source"), "record_id")
        .drop("record_id")
    )


# ------------------------------------------------------------------------------- coverage
def coverage(codes: DataFrame, story_sources: DataFrame, dim_question: DataFrame, run_id: str) -> DataFrame:
    """Per question, pooled and per source: asked, answered, rate and where the question goes.

    ``codes``: story_id, question, value. ``story_sources``: story_id, source of the live stories.
    """
    stated = F.when(F.col("value") != "not_stated", F.col("story_id"))
    per = (
        # One row per story and question before the join: answered if any of its values states something.
        codes.groupBy("story_id", "question")
        .agg(F.count(stated).alias("said"))
        .join(story_sources, "story_id")
        .groupingSets([["question", "source"], ["question"]], "question", "source")
        .agg(
            F.grouping("source").alias("pooled"),
            F.count("*").alias("asked"),
            F.count_if(F.col("said") > 0).alias("n_coded"),
        )
        .withColumn("source", F.when(F.col("pooled") == 1, "_all").otherwise(F.col("source")))
        .drop("pooled")
    )
    dims = dim_question.select("question", "stage", "block")
    # a question that nobody was asked has no row there; one join finds both, so the codes are gone through once
    none = F.lit(0).cast("bigint")
    rows = dims.join(per, "question", "left").select(
        "question", "stage", "block", F.when(F.col("asked").isNull(), "_all").otherwise(F.col("source")).alias("source"),
        F.coalesce("asked", none).alias("asked"), F.coalesce("n_coded", none).alias("n_coded"),
    )
    silent = F.col("asked") - F.col("n_coded")
    kept = (F.col("asked") > 0) & (
        (F.col("block") == "S") | (silent / F.when(F.col("asked") > 0, F.col("asked")) <= vocab.REGISTER_ABOVE)
    )
    return rows.select(
        "question",
        "source",
        "stage",
        "block",
        "n_coded",
        silent.alias("n_not_stated"),
        (F.col("n_coded") / F.when(F.col("asked") > 0, F.col("asked"))).alias("coverage"),
        F.when(kept, "coded").otherwise("register").alias("disposition"),
        F.lit(run_id).alias("run_id"),
    )


def concentration(codes: DataFrame) -> DataFrame:
    """Per question: the commonest stated value, its share of stated values, and whether it is all."""
    counts = codes.filter("value <> 'not_stated'").groupBy("question", "value").agg(F.count("*").alias("n"))
    # The least of (-n, value) is the largest count, ties to the smallest value.
    return (
        counts.groupBy("question")
        .agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("top"))
        .select(
            "question",
            F.col("top.value").alias("top_value"),
            F.bround(-F.col("top.neg") / F.col("total"), 3).alias("top_share"),
            (-F.col("top.neg") / F.col("total") > vocab.DEGENERATE).alias("degenerate"),
        )
    )


# ------------------------------------------------------------------------------- cross-tabs
def crosstab(
    spine: DataFrame,
    codes: DataFrame | None,
    run_id: str,
    fields: Sequence[str] = tuple(vocab.CROSSTAB_FIELDS),
    extra: Sequence[tuple[str, str]] = tuple(vocab.CROSSTAB_EXTRA),
    default_b: str = "photo_class",
) -> DataFrame:
    """``dim_a, val_a, dim_b, val_b, n, denom, n_authors`` of every registered pair.

    Every field and question is split by ``default_b``; ``extra`` names more pairs; ``default_b`` itself is
    counted against the pool only. Each split carries its pooled ``_all`` segment. The denominator of a
    question is the stories asked it in that segment. ``codes`` has a row per code, or one per story with its ``codes`` as
    an array; None leaves the questions out.
    """
    # the pooled segment of a split is added up from its segments, not from the stories
    def seg(b: str) -> Column:
        return F.array(F.struct(F.lit(b).alias("b"), _shown(b).alias("v")))

    def splits_of(dim: str) -> list[str]:
        return [b for a, b in extra if a == dim]

    base = [default_b]
    segment_fields = sorted({default_b, *[b for _, b in extra]})
    people = spine.select("story_id", "population", "author_key", *dict.fromkeys([*fields, *segment_fields]))

    # Spine fields: one array of (dim, value, segments) per story, exploded once.
    cells = []
    for f in fields:
        if f == default_b:
            segs = F.array(F.struct(F.lit("_all").alias("b"), F.lit("_all").alias("v")))
        else:
            segs = F.flatten(F.array(*[seg(b) for b in base + splits_of(f)]))
        cells.append(F.struct(F.lit(f).alias("dim"), _shown(f).alias("val"), segs.alias("segs")))

    # Questions: the stated values of a story; a NULL value of each question beside them counts who was asked.
    stated = lambda q, v: F.struct(q.alias("question"), F.when(v != "not_stated", v).alias("value"))
    asked_too = F.array_union("said", F.transform("said", lambda x: F.struct(x["question"].alias("question"), F.lit(None).cast("string").alias("value"))))
    stories = _author_bits(people.filter(F.col("population").isin(vocab.POPULATIONS)))
    if codes is None:
        stories = stories.withColumn("said", F.array().cast("array<struct<question:string,value:string>>"))
    else:
        if "codes" in codes.columns:
            said = codes.select("story_id", F.transform("codes", lambda c: stated(c["question"], c["value"])).alias("said"))  # the union below leaves each once
        else:
            said = codes.groupBy("story_id").agg(F.collect_set(stated(F.col("question"), F.col("value"))).alias("said"))
        # The short side is hashed, so that the long rows pass through the join unsorted.
        stories = stories.hint("shuffle_hash").join(said.select("story_id", asked_too.alias("said")), "story_id", "left")

    def segments_of(question: Column) -> Column:
        out = F.flatten(F.array(seg(default_b)))
        for q in sorted({a for a, _ in extra if a.startswith("q:")}):
            out = F.when(question == q[2:], F.flatten(F.array(*[seg(b) for b in base + splits_of(q)]))).otherwise(out)
        return out

    from_codes = F.transform("said", lambda x: F.struct(F.concat(F.lit("q:"), x["question"]).alias("dim"), x["value"].alias("val"), segments_of(x["question"]).alias("segs")))
    # The stories of an author meet here, one short row each; they become cells in their task.
    every = F.concat(F.array(*cells), F.coalesce(from_codes, F.array()))
    long = (
        stories.repartition("part", "slice")
        .select("part", "slice", "word", *BITS, "population", F.explode(every).alias("c"))
        .select("part", "slice", "word", *BITS, F.concat("population", F.lit("."), "c.dim").alias("dim_a"), F.col("c.val").alias("val_a"), F.explode("c.segs").alias("s"))
        .select("part", "slice", "word", *BITS, "dim_a", "val_a", F.col("s.b").alias("dim_b"), F.col("s.v").alias("val_b"))
    )
    split = ["dim_a", "val_a", "dim_b", "val_b"]
    bits = [F.bit_or(b).alias(b) for b in BITS]
    by_word = long.groupBy("part", "slice", "word", *split).agg(F.count("*").alias("k"), *bits)
    pooled = F.when(F.col("dim_b") == "_all", F.array("val_b")).otherwise(F.array("val_b", F.lit("_all")))
    by_word = by_word.withColumn("val_b", F.explode(pooled)).groupBy("part", "word", *split).agg(F.sum("k").alias("k"), *bits)
    different = sum((F.bit_count(b) for b in BITS[1:]), F.bit_count(BITS[0]))
    cell = by_word.groupBy(*split).agg(F.sum("k").alias("n"), F.sum(different).cast("bigint").alias("n_authors"))
    counted = ~F.col("dim_a").contains(".q:") | F.col("val_a").isNull()
    denom = F.sum(F.when(counted, F.col("n"))).over(W.partitionBy("dim_a", "dim_b", "val_b"))
    return cell.withColumn("denom", denom).filter(F.col("val_a").isNotNull()).select("dim_a", "val_a", "dim_b", "val_b", "n", "denom", "n_authors", F.lit(run_id).alias("run_id"))


PARTS, SLICE = 1024, 1_000_000
BITS = ["b0", "b1", "b2", "b3"]


def _author_bits(people: DataFrame) -> DataFrame:
    """``people`` with a bit of its own for each author: bit ``b0`` to ``b3`` of ``word``, in one of ``PARTS`` parts.

    Authors are numbered inside their part, 256 to a word, so different people are counted exactly by or-ing bits, and a
    cell has one row per word, not one per person. A part of more than ``SLICE`` rows goes to several tasks, in slices.
    """
    known = F.col("author_key").isNotNull()
    part = F.pmod(F.xxhash64(F.when(known, F.col("author_key")).otherwise(F.col("story_id").cast("string"))), F.lit(PARTS)).cast("int")
    rows = people.withColumn("part", part)
    in_order = W.partitionBy("part").orderBy("author_key")
    rows = rows.withColumns({"nth": F.dense_rank().over(in_order), "slice": F.floor(F.row_number().over(in_order) / SLICE).cast("int")})
    own = F.expr("shiftleft(1L, nth % 64)")
    bit = {b: F.when(known & (F.floor(F.col("nth") / 64) % 4 == i), own).otherwise(F.lit(0).cast("bigint")) for i, b in enumerate(BITS)}
    return rows.withColumns({"word": F.floor(F.col("nth") / 256).cast("int"), **bit}).drop("nth", "author_key")


def _shown(field: str) -> Column:
    return F.coalesce(F.col(field).cast("string"), F.lit("None"))


# ------------------------------------------------------------------------------- derived measures
ANSWERED = {"2.1": "v21", "2.4": "v24", "2.2": "v22", "9.4": "v94", "6.5": "v65", "10.2": "v102"}
MEASURED = ["6.7", "7.2", "9.1", *ANSWERED]


def story_answers(codes: DataFrame, spine: DataFrame) -> DataFrame:
    """One row per story: the values of each question that the measures need (NULL: not asked), and whether it pivots.

    Of question 2.2 only what was certain and wrong is kept. ``codes`` has a row per code, or one per story with its
    ``codes`` as an array, which are then looked at where they are.
    """
    def pivots(q: Column, v: Column) -> Column:
        return (
            ((q == "6.7") & ~v.isin("not_stated", "ignore_it"))
            | ((q == "7.2") & (v == "anchor_and_pivot"))
            | ((q == "9.1") & (v == "path:anchor_and_pivot"))
        )

    def held(k: str, v: Column, accuracy: Callable[[], Column]) -> Column:
        return F.when(accuracy() == "certain_wrong", v) if k == "2.2" else v

    if "codes" in codes.columns:
        asked = lambda k: F.exists("codes", lambda c: c["question"] == k)
        own = lambda k: F.transform(F.filter("codes", lambda c: c["question"] == k), lambda c: held(k, c["value"], lambda: c["accuracy"]))
        per = codes.select(
            "story_id", F.coalesce(F.exists("codes", lambda c: pivots(c["question"], c["value"])), F.lit(False)).alias("pivot"),
            *[F.when(asked(k), F.array_distinct(F.array_compact(own(k)))).alias(name) for k, name in ANSWERED.items()],
        )
    else:
        q, v = F.col("question"), F.col("value")
        per = codes.filter(q.isin(MEASURED)).groupBy("story_id").agg(
            F.max(pivots(q, v)).alias("pivot"),
            *[F.when(F.max(F.coalesce(q == k, F.lit(False))), F.collect_set(F.when(q == k, held(k, v, lambda: F.col("accuracy"))))).alias(name) for k, name in ANSWERED.items()],
        )
    return spine.select("story_id", "population", "author_key", "workaround").join(per, "story_id", "left")


def _rates(stories: DataFrame, measures: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """``metric, key, population, n, denom, n_authors`` of (metric, key, asked, hit): per person first, then per population."""
    sums, counts = [], []
    for i, (_, _, asked, hit) in enumerate(measures):
        sums += [F.count_if(asked & hit).alias(f"n{i}"), F.count_if(asked).alias(f"d{i}")]
        counts += [F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"d{i}").alias(f"d{i}"), F.count_if((F.col(f"n{i}") > 0) & F.col("author_key").isNotNull()).alias(f"a{i}")]
    totals = stories.groupBy("population", "author_key").agg(*sums).groupBy("population").agg(*counts)
    rows = [
        F.struct(F.lit(m).alias("metric"), F.lit(k).alias("key"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("denom"), F.col(f"a{i}").alias("n_authors"))
        for i, (m, k, _, _) in enumerate(measures)
    ]
    return totals.select("population", F.explode(F.array(*rows)).alias("r")).select("r.metric", "r.key", "population", "r.n", "r.denom", "r.n_authors").filter("denom > 0")


def _cue_measures() -> list[tuple[str, str, Column, Column]]:
    lost = F.create_map(*[F.lit(x) for kv in vocab.FORGOTTEN_FAMILY.items() for x in kv])
    head = lambda v: F.split_part(v, F.lit(":"), F.lit(1))
    families = {
        "cue_remembered": ("v21", head),
        "cue_forgotten": ("v24", lambda v: F.try_element_at(lost, v)),
        "cue_wrong": ("v22", head),
    }

    def one(metric: str, name: str, family: Callable[[Column], Column], key: str) -> tuple[str, str, Column, Column]:
        hit = F.exists(name, lambda v: F.coalesce(family(v) == key, F.lit(False)))
        return metric, key, F.col(name).isNotNull(), F.coalesce(hit, F.lit(False))

    out = [one(metric, name, family, key) for metric, (name, family) in families.items() for key in vocab.CUE_FAMILIES]
    return [*out, ("certain_wrong", "_all", F.col("v22").isNotNull(), F.size("v22") > 0)]


def _behaviour_measures() -> list[tuple[str, str, Column, Column]]:
    said = lambda name, none: F.coalesce(F.exists(name, lambda x: ~x.isin(*none)), F.lit(False))
    everyone = F.lit(True)
    return [
        ("results_as_cues", "_all", F.col("v65").isNotNull(), said("v65", ["not_stated", "nothing"])),
        ("anchor_and_pivot", "_all", everyone, F.coalesce("pivot", F.lit(False))),
        ("workaround", "_all", everyone, F.coalesce("workaround", F.lit(False))),
        ("preventive_habit", "_all", F.col("v102").isNotNull(), said("v102", ["not_stated"])),
    ]


def _fallbacks(codes: DataFrame, spine: DataFrame) -> DataFrame:
    """Each kind of fallback that any story names, in every population that was asked."""
    if "codes" in codes.columns:
        named = codes.select("story_id", F.transform(F.filter("codes", lambda c: c["question"] == "9.4"), lambda c: c["value"]).alias("values"))
        named = named.filter(F.size("values") > 0).withColumn("values", F.array_distinct(F.array_compact("values")))
    else:
        named = codes.filter("question = '9.4'").groupBy("story_id").agg(F.collect_set("value").alias("values"))
    rows = named.join(spine.select("story_id", "population", "author_key"), "story_id", "left")
    kinds = F.transform(F.filter("values", lambda v: v.startswith("fallback:")), lambda v: F.regexp_replace(v, "^fallback:", ""))
    # a NULL kind beside the named ones counts who was asked
    each = rows.select("population", "author_key", F.explode(F.concat(kinds, F.array(F.lit(None).cast("string")))).alias("key"))
    person = each.groupBy("population", "key", "author_key").agg(F.count("*").alias("k"))
    cells = person.groupBy("population", "key").agg(F.sum("k").alias("n"), F.count("author_key").alias("n_authors"))
    # a few rows from here on: kinds by populations
    all_kinds = F.array_distinct(F.flatten(F.collect_list(F.array(F.col("key"))).over(W.partitionBy(F.lit(1)))))
    by_population = cells.withColumn("kinds", all_kinds).groupBy("population").agg(
        F.first("kinds").alias("kinds"),
        F.max(F.when(F.col("key").isNull(), F.col("n"))).alias("denom"),
        F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", F.struct("n", "n_authors").alias("x"))))).alias("found"),
    )
    grid = by_population.filter(F.col("population").isNotNull()).select("population", "denom", "found", F.explode(F.array_compact("kinds")).alias("key"))
    x = F.try_element_at("found", F.col("key"))
    return grid.select(
        F.lit("fallback").alias("metric"), "key", "population", F.coalesce(x["n"], F.lit(0)).alias("n"), "denom", F.coalesce(x["n_authors"], F.lit(0)).alias("n_authors")
    )


def cue_matrix(codes: DataFrame, spine: DataFrame) -> DataFrame:
    """What stories remember, say they forgot, and were certain and wrong about, per cue family."""
    return _rates(story_answers(codes, spine), _cue_measures())


def behaviour_rates(codes: DataFrame, spine: DataFrame) -> DataFrame:
    """Results used as cues, pivots from near hits, workarounds, fallbacks and new habits."""
    return _rates(story_answers(codes, spine), _behaviour_measures()).unionByName(_fallbacks(codes, spine))


def source_divergence(spine: DataFrame, field: str = "primary_stage", at_least: int = vocab.MIN_DIVERGENCE_N) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of each source's distribution from the pooled one."""
    # each story counts for its value and, in a row of its own, for its source
    both = F.array(F.struct(F.lit(False).alias("whole"), F.col(field).alias("v")), F.struct(F.lit(True).alias("whole"), F.lit(None).cast(spine.schema[field].dataType).alias("v")))
    each = spine.select("population", "source", "author_key", F.explode(both).alias("x")).select("population", "source", "author_key", "x.*")
    person = each.groupBy("population", "source", "whole", "v", "author_key").agg(F.count("*").alias("k"))
    cells = person.groupBy("population", "source", "whole", "v").agg(F.sum("k").alias("n"), F.count("author_key").alias("people"))
    one_value = F.when(~F.col("whole"), F.col("n"))
    source = W.partitionBy("population", "source")
    cells = cells.withColumns(
        {
            "pn": F.sum(one_value).over(W.partitionBy("population", "whole", "v")),
            "denom": F.sum(one_value).over(W.partitionBy("population")),
            "sn": F.max(F.when(F.col("whole"), F.col("n"))).over(source),
            "n_authors": F.max(F.when(F.col("whole"), F.col("people"))).over(source),
        }
    )
    p = F.col("n") / F.col("sn")
    q = F.col("pn") / F.col("denom")
    m = (p + q) / 2
    term = p * F.log2(p / m) + q * F.log2(q / m)
    # a value that the source lacks adds its pooled share, and those shares are what its own values leave of one
    return (
        cells.filter(~F.col("whole"))
        .groupBy("population", "source", "sn", "denom", "n_authors")
        .agg(((F.sum(term) + 1 - F.sum(q)) / 2).alias("d"))
        .filter(F.col("sn") >= at_least)
        .select(
            F.lit("js_divergence").alias("metric"),
            F.col("source").alias("key"),
            "population",
            F.bround("d", 4).alias("value"),
            F.col("sn").alias("n"),
            "denom",
            "n_authors",
            F.lit(f"{field} vs pooled, base 2").alias("note"),
        )
    )


def derived(
    codes: DataFrame, spine: DataFrame, reliability: DataFrame | None = None, run_id: str = "", fallbacks: DataFrame | None = None
) -> DataFrame:
    """All derived measures in one table. A row nobody was asked about is left out.

    ``codes`` holds those of the questions ``MEASURED`` or more; ``fallbacks`` those of 9.4, if they are to be had for less.
    """
    named = _fallbacks(codes if fallbacks is None else fallbacks, spine)
    rates = _rates(story_answers(codes, spine), [*_cue_measures(), *_behaviour_measures()]).unionByName(named)
    rates = rates.filter("denom > 0").withColumn("value", F.col("n") / F.col("denom"))
    if reliability is None:
        rates = rates.withColumn("note", F.lit(None).cast("string"))
    else:
        weak = reliability.filter("field = 'q:2.1' and verdict = 'low_reliability'").select(
            F.lit("cue_remembered").alias("metric"), F.lit("rests on 2.1, low_reliability").alias("note")
        )
        rates = rates.join(weak, "metric", "left")
    cols = ["metric", "key", "population", "value", "n", "denom", "n_authors", "note"]
    out = rates.select(*cols).unionByName(source_divergence(spine).select(*cols))
    return out.filter(F.col("population").isin(vocab.POPULATIONS)).withColumn("run_id", F.lit(run_id))


# ------------------------------------------------------------------------------- rates over codes
def other_rate(codes: DataFrame, at_least: int = 10) -> DataFrame:
    """Share of stated values that are free text, per question with enough of them."""
    return (
        codes.filter("value <> 'not_stated' and question <> '10.3'")
        .groupBy("question")
        .agg(F.count("*").alias("answered"), F.count_if(F.col("value").startswith("other:")).alias("other"))
        .filter(F.col("answered") >= at_least)
        .withColumn("rate", F.col("other") / F.col("answered"))
    )


def block_yield(codes: DataFrame, dim_question: DataFrame) -> DataFrame:
    """Share of codes that state something, per block of questions."""
    return (
        # Counted per question first: the join sees a row per question.
        codes.filter("question <> '10.3'")
        .groupBy("question")
        .agg(F.count("*").alias("n"), F.count_if(F.col("value") != "not_stated").alias("stated"))
        .join(dim_question.select("question", "block"), "question")
        .groupBy("block")
        .agg(F.sum("n").alias("n"), F.sum("stated").alias("stated"))
        .withColumn("yield", F.col("stated") / F.col("n"))
    )


def interview_register(coverage_rows: DataFrame, dim_question: DataFrame) -> DataFrame:
    """Questions public text cannot answer, with their wording, in question order."""
    rows = coverage_rows.filter("source = '_all' and disposition = 'register'")
    asked = F.col("n_coded") + F.col("n_not_stated")
    part = lambda i: F.split_part("question", F.lit("."), F.lit(i)).cast("int")
    return (
        rows.select("question", "n_coded", "n_not_stated")
        .join(dim_question.select("question", "stage", "text", "plain"), "question")
        .select(
            "question", "stage", "text", "plain",
            F.concat(F.col("n_coded").cast("string"), F.lit(" of "), asked.cast("string")).alias("answered"),
        )
        .orderBy(part(1), part(2))
    )


def headline(crosstab_rows: DataFrame, context: Sequence[str] = ("1", "9", "10")) -> DataFrame:
    """The commonest value of each dimension, context values left out, in the pooled segment."""
    pool = crosstab_rows.filter((F.col("val_b") == "_all") & ~F.col("val_a").isin(list(context)))
    w = W.partitionBy("dim_a", "dim_b").orderBy(F.desc("n"), "val_a")
    return pool.withColumn("r", F.row_number().over(w)).filter("r = 1").select(
        "dim_a", "dim_b", "val_a", "n", "denom", "n_authors"
    )


def share_of_answered(crosstab_rows: DataFrame, coverage_rows: DataFrame) -> DataFrame:
    """A value's share among stories that answered its question, beside its share among those asked."""
    said = coverage_rows.filter("source = '_all'").select("question", F.col("n_coded").alias("of_said"))
    return (
        crosstab_rows.filter(F.col("dim_a").contains(".q:") & (F.col("val_b") == "_all"))
        .withColumn("question", F.split_part("dim_a", F.lit(".q:"), F.lit(2)))
        .join(said, "question")
        .filter((F.col("n") > 0) & (F.col("n") <= F.col("of_said")) & (F.col("of_said") < F.col("denom")))
        .select("dim_a", "val_a", "n", "denom", "of_said", (F.col("n") / F.col("of_said")).alias("share_of_said"))
    )


def claimable_differences(crosstab_rows: DataFrame) -> DataFrame:
    """Pairs of segments of one split whose shares of a value may be said to differ.

    Input is a result table: a split has few segments, so its pairs are few.
    """
    from fieldnote.functions.shares import differs

    cells = crosstab_rows.filter((F.col("val_b") != "_all") & (F.col("denom") >= vocab.COMPARABLE))
    a = cells.select("dim_a", "val_a", "dim_b", F.col("val_b").alias("seg_a"), F.col("n").alias("na"), F.col("denom").alias("da"))
    b = cells.select("dim_a", "val_a", "dim_b", F.col("val_b").alias("seg_b"), F.col("n").alias("nb"), F.col("denom").alias("db"))
    return (
        a.join(b, ["dim_a", "val_a", "dim_b"])
        .filter("seg_a < seg_b")
        .withColumn("differs", differs(F.col("na"), F.col("da"), F.col("nb"), F.col("db")))
    )
