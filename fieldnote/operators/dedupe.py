"""Duplicate marking that never erases agreement between different people.

Exact copies lose to the earliest copy: across authors for long texts, within one author for short ones.
Near copies lose only to the same author's earlier text in the same source. Similar texts by different
authors are counted, never marked.

Similarity candidates come from *part signatures*. Two word sets with Jaccard above ``t`` differ in fewer
than ``(1-t)/(1+t) * (|x|+|y|)`` words. Words are spread by hash over more parts than that, so at least
one part (or, for short texts, three parts) holds the same words in both sets, and its hash is an equal
join key. The signatures are computed row by row: no word-frequency table is shuffled.

A signature may still be a few common words, and its block grow with the corpus. A block of more than ``SPLIT`` texts is
therefore split by further signatures, of parts that another hash deals out: two similar sets agree in one of those
too. Splitting goes on until blocks are small or hardly shrink, which is when their texts are similar indeed.

Word sets are sets of 64-bit hashes; they get numbers and are written once. What is shuffled for a signature is its hash and
the number of its set. Sets that share a block meet in one task by their sketches; words move for pairs that are likely to be similar.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldnote import vocab
from fieldnote.functions import text as tx
from fieldnote.functions import wordsets as ws
from fieldnote.operators import marks as mk
from fieldnote.operators.skew import keyed_join
from fieldnote.session import stored

SPLIT = 4096
"""A block of more texts than this is split by further signatures, and compared in pieces of about this many."""

ALIKE = 0.25
"""A block is not split when this share of its texts, or more, agree in the least of their further signatures: they are similar."""

FEW = 1_000_000
"""Keys that are sent to all machines rather than shuffling the word sets to them."""

LANES = 16
"""Numbers of 64 bits in the sketch of a word set."""

LANE_WORDS = 150
"""Words for each number of the short sketch that moves with a signature."""

HEADS = 8
"""So many similar earlier texts of a block are shown to a text in the first round."""

AT_ONCE = 500_000
"""Words, or pairs, that a task works on at a time."""


def _order() -> Column:
    return F.struct(F.coalesce("created_at", F.lit("9999")).alias("at"), F.col("record_id").alias("id"))


# ------------------------------------------------------------------------------- exact copies
def exact_duplicates(records: DataFrame, text: str = "text_clean") -> DataFrame:
    """(record_id, winner, source) of every exact copy that loses to an earlier one.

    Needs ``record_id, source, author_key, created_at`` and the text column.
    """
    return _exact(word_rows(records, ["record_id", "source", "author_key", "created_at"], text))


def _exact(rows: DataFrame) -> DataFrame:
    """As ``exact_duplicates``, of ``word_rows``."""
    owner = F.when(F.col("n") >= vocab.CROSS_AUTHOR_MIN_WORDS, F.lit("")).otherwise(F.nullif("author_key", F.lit("")))
    keyed = rows.select("record_id", "source", "created_at", F.col("in_order").alias("key"), owner.alias("owner")).filter(F.col("owner").isNotNull())
    first = (
        keyed.groupBy("key", "owner")
        .agg(F.min(_order()).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("key", "owner", F.col("first.id").alias("winner"), "n")
    )
    return (
        keyed_join(keyed, first, ["key", "owner"], ["record_id"])
        .filter(F.col("record_id") != F.col("winner"))
        .select("record_id", "winner", "source")
    )


# ------------------------------------------------------------------------------- word sets
def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tx.words(text)))


def hashed(words: Column) -> Column:
    """A list of words as a set of 64-bit hashes, in order."""
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists in one run, and the size of each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes.astype(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sketches(words: pa.Array) -> pa.Array:
    flat, sizes = _flat(words)
    values = ws.sketches(flat.view(np.uint64), sizes, LANES).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * LANES), pa.array(values))


@F.arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("in_order", T.BinaryType()), T.StructField("words", T.ArrayType(T.LongType()))]))
def read_words(text: pa.Array) -> pa.Array:
    """The number of words of a text, a hash of them in order, and their set as 64-bit hashes, in order."""
    counts, digests, sets = [], [], []
    for words, n in ws.text_words(text):
        ends = np.cumsum(n)
        counts.append(n)
        for to, k in zip(ends, n, strict=True):
            own = words[to - k : to]
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            sets.append(np.unique(own.view(np.int64)))
    ends = np.cumsum([0, *[len(x) for x in sets]]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sets])))
    n = pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *counts]).astype(np.int32))
    return pa.StructArray.from_arrays([n, pa.array(digests, pa.binary()), lists], names=["n", "in_order", "words"], mask=text.is_null())


@F.arrow_udf(T.IntegerType())
def common(a: pa.Array, b: pa.Array) -> pa.Array:
    """The number of words that two sets have in common."""
    (x, n), (y, k) = _flat(a), _flat(b)
    i, j = np.cumsum(n), np.cumsum(k)
    return pa.array([len(np.intersect1d(x[i[r] - n[r] : i[r]], y[j[r] - k[r] : j[r]], assume_unique=True)) for r in range(len(n))], pa.int32())


def sketch(words: Column) -> Column:
    """``array<bigint>``: for each hash value of ``64 * LANES`` whether an odd number of words has it.

    Two sketches differ in at most as many bits as their sets in words, so a pair too far apart is known without its words.
    """
    return _sketches(hashed(words))


def short_sketch(sketch: Column, size: Column) -> Column:
    """A sketch folded to as many numbers as a set of ``size`` words needs: what holds for sketches holds for these."""
    fold = lambda k: F.array(*[functools.reduce(lambda x, y: x.bitwiseXOR(y), [F.get(sketch, F.lit(j)) for j in range(i, LANES, k)]) for i in range(k)])
    return F.when(size <= 2 * LANE_WORDS, fold(2)).when(size <= 4 * LANE_WORDS, fold(4)).when(size <= 8 * LANE_WORDS, fold(8)).otherwise(sketch)


def word_rows(records: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``id, *columns, words, set_key, sketch`` and, of the words in order, their number ``n`` and a hash ``in_order``, of all records.

    Written once: the texts are read for nothing else.
    """
    rows = records.select(*columns, read_words(F.col(text)).alias("read")).select(*columns, "read.*")
    key = F.struct(F.xxhash64("words").alias("x"), F.xxhash64(F.lit(1), "words").alias("y"))
    return stored(rows.withColumns({"set_key": key, "sketch": _sketches(F.col("words")), "id": F.monotonically_increasing_id()}))


def with_words(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("words") > 0).drop("n", "in_order")


def without_copies(rows: DataFrame, first: DataFrame, group: list[str]) -> DataFrame:
    """One of ``word_rows`` for each different set of a group. ``first`` has ``*group, set_key, n`` and the ``id`` of the row that stays."""
    many = first.filter("n > 1").select(*group, "set_key", "n", F.col("id").alias("stays"))
    copies = stored(keyed_join(rows.select("id", *group, "set_key"), many, [*group, "set_key"], ["id"]).filter("id <> stays").select("id"))
    return rows.join(F.broadcast(copies) if copies.count() <= FEW else copies, "id", "left_anti")


# ------------------------------------------------------------------------------- blocks
def _smallest_partner(t: float) -> int:
    """Sets with fewer words than this have no partner but an identical set."""
    n = 1
    while n / (n + 1) <= t:
        n += 1
    return n


def _signed(t: float, seed: int, key: str, least: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of ``grp, key, words`` a row ``sig, key`` for each signature of a set, or for its least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _flat(batch.column("words"))
            flat, ends = flat.view(np.uint64), np.cumsum(sizes)
            grp = batch.column("grp").to_numpy(zero_copy_only=False).view(np.uint64)
            at = 0
            while at < len(sizes):
                begin = ends[at] - sizes[at]
                to = max(at + 1, int(np.searchsorted(ends, begin + AT_ONCE, "right")))
                sig, whose = ws.signatures(flat[begin : ends[to - 1]], sizes[at:to], t, seed)
                sig = ws.mix(sig.view(np.uint64) + ws.mix(grp[at + whose])).view(np.int64)
                # each once
                order = np.lexsort((sig, whose))
                sig, whose = sig[order], whose[order]
                if len(sig):
                    new = np.concatenate([[True], (whose[1:] != whose[:-1]) | (False if least else sig[1:] != sig[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(sig[new]), batch.column(key).take(pa.array(at + whose[new]))], names=["sig", key])
                at = to

    return run


def signature_blocks(sets: DataFrame, group: list[str], key: str, t: float) -> DataFrame:
    """``blk, key, n``: similar sets of one group share a block; ``n`` is the number of sets in it.

    ``sets`` holds ``*group``, a ``key`` that names a set of a group, and ``words`` (or their hashes). Blocks of one set are left out.
    A block is final when it has at most ``SPLIT`` sets, or when its sets are similar: by the share ``ALIKE`` of them that
    agree in the least of their further signatures, or because it has more than half of the sets of the block it was split from.
    """
    words = F.col("words") if sets.schema["words"].dataType.elementType.typeName() == "long" else hashed(F.col("words"))
    body = sets.filter(F.size("words") >= _smallest_partner(t)).select(F.xxhash64(*group).alias("grp"), key, words.alias("words"))
    schema = f"sig bigint, {key} {sets.schema[key].dataType.simpleString()}"
    signed = lambda rows, seed, least=False: rows.select("grp", key, "words").mapInArrow(_signed(t, seed, key, least), schema)
    open_ = signed(body, 0).select(F.col("sig").alias("blk"), key)
    above, final, seed = F.lit(1 << 62), None, 0
    while True:
        # each signature moves once, with nothing but its key; only those that sets share are written
        shared = open_.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("blk"))).filter("n > 1")
        rows = stored(shared.withColumn("above", above))
        split = (F.col("n") > SPLIT) & (2 * F.col("n") <= F.col("above"))
        done = rows.filter(~split).select("blk", key, "n")
        final = done if final is None else final.unionByName(done)
        rows = rows.filter(split)
        k = rows.count()
        if k == 0:
            return final
        seed += 1
        asked = rows.select(key).distinct()
        again = stored(body.join(F.broadcast(asked) if k <= FEW else asked, key, "left_semi"))
        least = rows.join(signed(again, seed, True), key).groupBy("blk", "n", "sig").agg(F.count(F.lit(1)).alias("k"))
        alike = stored(least.groupBy("blk", "n").agg(F.max("k").alias("k")).filter(F.col("k") >= ALIKE * F.col("n")).select("blk"))
        final = final.unionByName(rows.join(alike, "blk", "left_semi").select("blk", key, "n"))
        rows = rows.join(alike, "blk", "left_anti")
        open_ = rows.join(signed(again, seed), key).select(F.xxhash64("blk", "sig").alias("blk"), key, F.col("n").alias("above"))
        above = F.col("above")


# ------------------------------------------------------------------------------- pairs of a block
def _lanes(flat: np.ndarray, sizes: np.ndarray, to: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and sketches, folded to ``to`` numbers each, of rows that agree in that."""
    start = np.cumsum(sizes) - sizes
    for k in np.unique(to):
        rows = np.flatnonzero(to == k)
        out = np.zeros((len(rows), k), dtype=np.uint64)  # bits of a negative number would be counted of its absolute value
        for n in np.unique(sizes[rows]):
            some = np.flatnonzero(sizes[rows] == n)
            held = flat[start[rows[some]][:, None] + np.arange(n)]
            out[some] = np.bitwise_xor.reduce(held.reshape(len(some), n // k, k), axis=1)
        yield rows, out


def _compared(t: float, most: int, split: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From pieces of blocks, in order of ``blk, part, key``, ``late, early`` of each pair whose sketches are not too far apart.

    Rows with ``ask`` are compared with the heads of their piece whose key is above ``ask`` and below their own, until
    ``most`` are found; where others may follow, a row ``late, blk, horizon`` says from where. ``more``: of a large block.
    """
    share = (1 - t) / (1 + t)
    names = ["late", "early", "blk", "horizon"]

    def told(late: np.ndarray, early: np.ndarray | None, blk: np.ndarray | None, horizon: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(late), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(late), *[none if x is None else pa.array(x) for x in (early, blk, horizon)]], names=names)

    def changes(table: pa.Table) -> np.ndarray:
        blk, part = table.column("blk").to_numpy(), table.column("part").to_numpy()
        return np.concatenate([[True], (blk[1:] != blk[:-1]) | (part[1:] != part[:-1])])

    def piece_by_piece(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number = lambda c: table.column(c).to_numpy()
        blk, key, size = number("blk"), number("key"), number("size").astype(np.int64)
        asks, ask = ~table.column("ask").is_null().to_numpy(), table.column("ask").fill_null(0).to_numpy()
        head, more = number("head"), number("more")
        flat, sizes = _flat(table.column("sketch"))
        flat = flat.view(np.uint64)
        new = changes(table)
        of = np.cumsum(new) - 1
        least = np.minimum.reduceat(sizes, np.flatnonzero(new))
        for rows, lanes in _lanes(flat, sizes, least[of]):
            keys, rank = np.unique(key[rows], return_inverse=True)
            wide = len(keys) + 1
            place = of[rows] * wide + rank
            heads, asking = np.flatnonzero(head[rows]), np.flatnonzero(asks[rows])
            there = place[heads]
            from_ = np.searchsorted(there, of[rows][asking] * wide + np.searchsorted(keys, ask[rows][asking], "right"))
            to = np.searchsorted(there, place[asking])
            at, found = from_.copy(), np.zeros(len(asking), dtype=np.int64)
            left, late, early, held = np.flatnonzero(at < to), [], [], 0
            while len(left):
                x, y = asking[left], heads[at[left]]
                apart = np.bitwise_count(lanes[x] ^ lanes[y]).sum(axis=1, dtype=np.int64)
                near = apart < share * (size[rows[x]] + size[rows[y]]) + 1e-6
                late.append(key[rows[x[near]]])
                early.append(key[rows[y[near]]])
                held += len(late[-1])
                if held > AT_ONCE:
                    yield told(np.concatenate(late), np.concatenate(early), None, None)
                    late, early, held = [], [], 0
                found[left] += near
                at[left] += 1
                left = left[(at[left] < to[left]) & (found[left] < most)]
            if held:
                yield told(np.concatenate(late), np.concatenate(early), None, None)
            # not all was looked at: enough were found, or a large block has more texts than it shows at a time
            begin, end = (np.searchsorted(there, (of[rows][asking] + i) * wide) for i in (0, 1))
            cut = (at < to) | (more[rows][asking] & (to == end) & (end - begin >= split))
            if cut.any():
                some = asking[cut]
                last = heads[np.maximum(at[cut] - 1, 0)] if len(heads) else some
                horizon = np.where(at[cut] > from_[cut], key[rows[last]], ask[rows[some]])
                yield told(key[rows[some]], None, blk[rows[some]], horizon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            # the last piece may go on in the next batch
            cut = int(np.flatnonzero(changes(table))[-1]) if len(table) else 0
            if cut:
                yield from piece_by_piece(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut)
        if rest is not None and len(rest):
            yield from piece_by_piece(rest.combine_chunks())

    return run


def compared(pieces: DataFrame, brief: DataFrame, t: float, most: int = 1 << 62) -> DataFrame:
    """``late, early, blk, horizon`` of ``pieces`` (see ``_compared``); ``brief`` has ``key, size`` and the short ``sketch`` of each set."""
    rows = pieces.join(brief.select("key", "size", "sketch"), "key").select("blk", "part", "key", "ask", "head", "more", "size", "sketch")
    rows = rows.repartition("blk", "part").sortWithinPartitions("blk", "part", "key")
    return rows.mapInArrow(_compared(t, most, SPLIT), "late bigint, early bigint, blk bigint, horizon bigint")


def _piece(rows: DataFrame, part: Column, ask: Column, head: bool, more: bool) -> DataFrame:
    return rows.select("blk", part.cast("bigint").alias("part"), "key", ask.cast("bigint").alias("ask"), F.lit(head).alias("head"), F.lit(more).alias("more"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Pieces that bring together any two sets of a block. A large block is compared square by square, in many tasks."""
    whole, large = blocks.filter(F.col("n") <= SPLIT), blocks.filter(F.col("n") > SPLIT)
    sides = F.ceil(F.col("n") / SPLIT).cast("int")
    both = large.withColumns({"own": F.pmod(F.xxhash64("key"), sides), "other": F.explode(F.sequence(F.lit(0), sides - 1))})
    square = lambda x, y: F.col(x).cast("bigint") * sides + F.col(y)
    return (
        _piece(whole, F.lit(0), F.lit(-1), True, False)
        .unionByName(_piece(both, square("own", "other"), F.lit(-1), False, False))
        .unionByName(_piece(both, square("other", "own"), F.lit(None), True, False))
    )


# ------------------------------------------------------------------------------- similar pairs
def linked(pairs: DataFrame, brief: DataFrame, rows: DataFrame, group: list[str], t: float) -> DataFrame:
    """``late, early, similarity`` of those ``pairs`` of keys whose sets are of one group and have a Jaccard above ``t``.

    ``brief`` has ``key, id, full`` of each set, ``full`` its whole sketch. Sketches leave out, without loss, what is too far
    apart; only the sets of the pairs left are read, from ``rows``, and moved.
    """
    side = lambda c, x: brief.select(F.col("key").alias(c), *[F.col(n).alias(n + x) for n in ("id", "grp", "size", "full")])
    apart = F.aggregate(F.zip_with("full_a", "full_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    near = (F.col("grp_a") == F.col("grp_b")) & (apart < (1 - t) / (1 + t) * (F.col("size_a") + F.col("size_b")) + 1e-6)
    likely = pairs.select("late", "early").distinct().join(side("late", "_a"), "late").join(side("early", "_b"), "early")
    likely = stored(likely.filter(near).select("late", "early", "id_a", "id_b"))
    ids = likely.select(F.col("id_a").alias("id")).union(likely.select(F.col("id_b").alias("id"))).distinct()
    held = stored(rows.join(F.broadcast(ids) if likely.count() <= FEW else ids, "id", "left_semi").select("id", F.struct(*group).alias("who"), "words"))
    words = lambda x: held.select(*[F.col(c).alias(c + x) for c in ("id", "who", "words")]).hint("merge")
    met = likely.join(words("_a"), "id_a").join(words("_b"), "id_b").filter(F.col("who_a") == F.col("who_b"))
    both = met.select("late", "early", (F.size("words_a") + F.size("words_b")).alias("all"), common("words_a", "words_b").alias("both"))
    return both.withColumn("similarity", F.col("both") / (F.col("all") - F.col("both"))).filter(F.col("similarity") > t).select("late", "early", "similarity")


def briefly(rows: DataFrame, group: list[str]) -> DataFrame:
    """``id, grp, size, full, sketch`` of ``word_rows``: what is known of a set without its words."""
    size = F.size("words").alias("size")
    return rows.select("id", F.xxhash64(*group).alias("grp"), size, F.col("sketch").alias("full"), short_sketch(F.col("sketch"), size).alias("sketch"))


def similar_sets(rows: DataFrame, first: DataFrame, group: list[str], t: float) -> DataFrame:
    """All pairs ``(*group, a, b, similarity)`` of keys of different word sets with Jaccard above ``t``.

    ``rows`` are ``word_rows``; ``first`` has one row per distinct set of a group: ``*group, set_key, n`` and the ``id`` of one of its rows.
    """
    first = first.dropna(subset=group)
    sets = without_copies(rows.dropna(subset=group), first, group)
    brief = stored(briefly(sets, group)).withColumn("key", F.col("id"))
    blocks = signature_blocks(sets, group, "id", t).withColumnRenamed("id", "key")
    pairs = compared(block_pairs(blocks), brief, t)
    names = first.select("id", *group, "set_key")
    return (
        linked(pairs, brief, sets, group, t)
        .join(names.select(F.col("id").alias("late"), *group, F.col("set_key").alias("a")), "late")
        .join(names.select(F.col("id").alias("early"), F.col("set_key").alias("b")), "early")
        .select(*group, "a", "b", "similarity")
    )


def similar_texts(
    records: DataFrame, t: float = vocab.NEAR_DUPLICATE, max_chars: int | None = None, text: str = "text_clean"
) -> DataFrame:
    """Similar texts of one source: ``source, a, b, similarity, n_a, n_b``.

    Records with equal word sets are one group, named by its smallest id and counted, so copies are
    never paired with each other.
    """
    rows = with_words(word_rows(records if max_chars is None else records.filter(F.length(text) <= max_chars), ["record_id", "source"], text))
    sets = rows.groupBy("source", "set_key").agg(F.min(F.struct("record_id", "id")).alias("first"), F.count("*").alias("n"))
    sets = stored(sets.select("source", "set_key", F.col("first.id").alias("id"), F.col("first.record_id").alias("name"), "n"))
    left = sets.select("source", F.col("set_key").alias("a"), F.col("name").alias("name_a"), F.col("n").alias("n1"))
    right = sets.select("source", F.col("set_key").alias("b"), F.col("name").alias("name_b"), F.col("n").alias("n2"))
    swap = F.col("name_a") > F.col("name_b")
    return (
        similar_sets(rows, sets, ["source"], t)
        .join(left, ["source", "a"])
        .join(right, ["source", "b"])
        .select(
            "source",
            F.least("name_a", "name_b").alias("a"),
            F.greatest("name_a", "name_b").alias("b"),
            "similarity",
            F.when(swap, F.col("n2")).otherwise(F.col("n1")).alias("n_a"),
            F.when(swap, F.col("n1")).otherwise(F.col("n2")).alias("n_b"),
        )
    )


def cross_author_echoes(
    records: DataFrame,
    t: float = vocab.NEAR_DUPLICATE,
    max_chars: int | None = None,
    text: str = "text_clean",
) -> DataFrame:
    """Pairs of different authors with similar texts, counted per source: ``source, echo_pairs``.

    All texts count; ``max_chars`` leaves longer ones out for a caller who asks for that.

    Copies are counted from per-author totals of each word set, so a large group of copies costs one
    row per author, not one row per pair.
    """
    short = F.lit(True) if max_chars is None else F.length(text) <= max_chars
    rows = with_words(word_rows(records.filter(F.col("author_key").isNotNull() & (F.col("author_key") != "") & short), ["source", "author_key"], text))
    by_author = stored(rows.groupBy("source", "set_key", "author_key").agg(F.count("*").alias("n"), F.min("id").alias("id")))
    totals = by_author.groupBy("source", "set_key").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.min("id").alias("id")
    )
    inside = totals.select("source", ((F.col("n") * F.col("n") - F.col("nn")) / 2).cast("bigint").alias("k"))
    pairs = stored(similar_sets(rows, totals, ["source"], t).select("source", "a", "b"))
    size_a = totals.select("source", F.col("set_key").alias("a"), F.col("n").alias("na"))
    size_b = totals.select("source", F.col("set_key").alias("b"), F.col("n").alias("nb"))
    author_a = by_author.select("source", F.col("set_key").alias("a"), "author_key", F.col("n").alias("xa"))
    author_b = by_author.select("source", F.col("set_key").alias("b"), "author_key", F.col("n").alias("xb"))
    all_of = pairs.join(size_a, ["source", "a"]).join(size_b, ["source", "b"]).select(
        "source", (F.col("na") * F.col("nb")).alias("k")
    )
    same_of = pairs.join(author_a, ["source", "a"]).join(author_b, ["source", "b", "author_key"]).select(
        "source", (-F.col("xa") * F.col("xb")).alias("k")
    )
    return (
        inside.unionByName(all_of).unionByName(same_of).groupBy("source").agg(F.sum("k").alias("echo_pairs"))
    )


# ------------------------------------------------------------------------------- near copies
def near_duplicates_same_author(
    records: DataFrame, t: float = vocab.NEAR_DUPLICATE, text: str = "text_clean"
) -> DataFrame:
    """(record_id, winner, source): texts that lose to an earlier kept text of the same author.

    Going through one author's texts in order, a text is kept unless an earlier *kept* text is similar; the earliest
    such text is its winner. Equal word sets are settled first by their earliest member. The rest is settled in rounds:

    * each text is shown, in each of its blocks, the ``HEADS`` earliest texts that are similar to it, in later rounds more;
    * a text without any is kept; a text similar to a kept one loses; a text all of whose similar texts lost is kept;
    * a text that was not shown all asks on, from the last it was shown, while no kept text is found before that.

    A text is not compared further once it has been shown enough: a large group of near copies is settled by its first members.
    """
    return _near(word_rows(records, ["record_id", "source", "author_key", "created_at"], text), t)


def _near(rows: DataFrame, t: float = vocab.NEAR_DUPLICATE) -> DataFrame:
    """As ``near_duplicates_same_author``, of ``word_rows``."""
    who = ["source", "author_key"]
    spark = rows.sparkSession
    rows = with_words(rows).filter(F.col("author_key").isNotNull() & (F.col("author_key") != "") & F.col("source").isNotNull())
    at = F.struct(_order().alias("ord"), "id")
    first = rows.groupBy(*who, "set_key").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    first = first.select(*who, "set_key", "n", "first.ord", "first.id")
    # keys are in the order of the texts: the upper bits are the range, the lower ones the place in it
    ranged = stored(first).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "ord").sortWithinPartitions("ord")
    first = stored(ranged.withColumn("key", F.monotonically_increasing_id()))
    sets = without_copies(rows, first, who)
    brief = stored(briefly(sets, who).join(first.select("id", "key"), "id"))
    blocks = stored(signature_blocks(sets, who, "id", t).join(first.select("id", "key"), "id").select("blk", "key", "n"))

    known = open_ = undecided = decided = asks = None
    most = HEADS
    while True:
        shown = stored(compared(_asked(blocks, asks, decided), brief, t, most))
        most *= 8
        links = linked(shown.filter("early is not null"), brief, sets, who, t).select("late", "early")
        more = shown.filter("horizon is not null").select("late", "blk", "horizon")
        if asks is None:
            links = stored(links)
            undecided = stored(links.select("late").union(more.select("late")).distinct())
            state = undecided.select(F.col("late").alias("early"), F.lit(None).cast("boolean").alias("kept"))
        else:
            state = undecided.select(F.col("late").alias("early"), F.lit(None).cast("boolean").alias("kept")).unionByName(decided.select(F.col("late").alias("early"), "kept"))
        # a text that is neither decided nor undecided has no earlier similar text: it is kept
        links = stored(links.join(state.withColumn("seen", F.lit(True)), "early", "left").select("late", "early", F.when(F.col("seen").isNull(), True).otherwise(F.col("kept")).alias("kept")))
        sure, unsure = links.filter("kept").select("late", "early"), links.filter("kept is null").select("late", "early")
        known = sure if known is None else known.unionByName(sure)
        open_ = unsure if open_ is None else open_.unionByName(unsure)
        while True:
            flag = lambda df, name: df.select("late").distinct().withColumn(name, F.lit(True))
            now = undecided.join(flag(known, "lost"), "late", "left").join(flag(open_, "waits"), "late", "left").join(flag(more, "asks"), "late", "left")
            now = stored(now.filter("lost or (waits is null and asks is null)").select("late", F.col("lost").isNull().alias("kept")))
            if now.isEmpty():
                break
            decided = now if decided is None else decided.unionByName(now)
            told = stored(open_.join(now.select(F.col("late").alias("early"), "kept"), "early", "left").select("late", "early", "kept"))
            known, open_ = stored(known.unionByName(told.filter("kept").select("late", "early"))), told.filter("kept is null").select("late", "early")
            undecided = stored(undecided.join(now, "late", "left_anti"))
        winners = known.groupBy("late").agg(F.min("early").alias("winner"))
        asks = stored(more.join(winners, "late", "left").filter("winner is null or winner > horizon").select("late", "blk", "horizon"))
        if asks.isEmpty():
            break
    names = first.select("key", "ord.id")
    settled = (
        first.select(*who, "set_key", "n", F.col("key").alias("late"), F.col("ord.id").alias("own"))
        .join(winners, "late", "left")
        .join(names.select(F.col("key").alias("winner"), F.col("id").alias("name")), "winner", "left")
        .select(*who, "set_key", "n", F.coalesce("name", "own").alias("winner"), F.col("name").isNotNull().alias("lost"))
        .filter("lost or n > 1")
    )
    return (
        keyed_join(rows.select("record_id", *who, "set_key"), settled, [*who, "set_key"], ["record_id"])
        .filter(F.col("record_id") != F.col("winner"))
        .select("record_id", "winner", "source")
    )


def _asked(blocks: DataFrame, asks: DataFrame | None, decided: DataFrame | None) -> DataFrame:
    """Pieces in which texts that ask meet the earlier texts of their blocks, all of them at first, then those not lost.

    A large block shows its ``SPLIT`` earliest texts above the least horizon to all who ask there, in many tasks.
    """
    if asks is None:
        heads = ask = blocks.filter(F.col("n") > SPLIT).withColumn("horizon", F.lit(-1))
        whole = _piece(blocks.filter(F.col("n") <= SPLIT), F.lit(0), F.lit(-1), True, False)
    else:
        about = asks.groupBy("blk").agg(F.min("horizon").alias("above"))
        heads = blocks.join(about, "blk").filter("key > above").drop("above")
        if decided is not None:
            heads = heads.join(decided.filter(~F.col("kept")).select(F.col("late").alias("key")), "key", "left_anti")
        ask = asks.withColumnRenamed("late", "key").join(blocks, ["blk", "key"])
        few = lambda df: df.filter(F.col("n") <= SPLIT)
        whole = _piece(few(heads), F.lit(0), F.lit(None), True, False).unionByName(_piece(few(ask), F.lit(0), F.col("horizon"), False, False))
        heads, ask = heads.filter(F.col("n") > SPLIT), ask.filter(F.col("n") > SPLIT)
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    ranked = heads.withColumn("r", F.row_number().over(W.partitionBy("blk").orderBy("key"))).filter(F.col("r") <= SPLIT)
    ranked = ranked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = ask.withColumn("part", F.pmod(F.xxhash64("key"), parts))
    return whole.unionByName(_piece(ranked, F.col("part"), F.lit(None), True, True)).unionByName(_piece(dealt, F.col("part"), F.col("horizon"), False, True))


# ------------------------------------------------------------------------------- the pass
def dedupe_marks(records: DataFrame, exclusions: DataFrame, run_id: str) -> DataFrame:
    """Exact copies first, near copies among the rest; only records that are still live are compared."""
    without = lambda rows, gone: rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, "record_id", "left_anti")
    live = without(records, stored(mk.record_marks(exclusions).select("record_id").distinct()))
    # both look at the same words, read once
    rows = word_rows(live, ["record_id", "source", "author_key", "created_at"], "text_clean")
    exact = stored(_exact(rows))
    near = _near(without(rows, exact.select("record_id")))
    told = F.concat(F.lit("duplicate of "), "winner")
    told_near = F.concat(F.lit("same-author near-duplicate of "), "winner")
    return mk.mark(exact, "clean", "exact_duplicate", told, run_id).unionByName(
        mk.mark(near, "clean", "near_duplicate_same_author", told_near, run_id)
    )
