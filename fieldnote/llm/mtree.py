"""Exact top-k by inner product with a paged M-tree.

Inner product becomes a metric by one more dimension: with ``m`` the largest norm, every vector x gets
``sqrt(m^2 - |x|^2)`` appended and a query gets 0; then ``|q - x|^2 = |q|^2 + m^2 - 2 q.x``, and the nearest vectors
have the largest products. Vectors lie in pages of ``PAGE``, in order of their region (nearest of a bounded sample of
pivots) and distance to its pivot. A page stores a routing vector, a covering radius and each entry's distance to
the routing vector; a group of pages, one partition's share of the tree, stores a center, a radius and each page's
distance to the center.

A query first searches the group with the best bound, best page first; the k-th score found there excludes other
groups by their radius. In the groups that are left, pages are taken in order of their bound, and a stored parent
distance excludes a page or an entry before its own distance is computed. Bounds are compared with a margin for
rounding, so scores equal to the k-th are always seen, and scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldnote.llm.store import stored

PIVOTS = 64
"""Vectors of the sample that regions are made from; every vector is indexed."""
PAGE = 128
GROUP = 8192
"""Vectors of one group, about, while that makes no more than ``MAX_GROUPS`` groups."""
MAX_GROUPS = 4096
"""The list of groups, a center and a radius each, goes to every task that routes queries."""
QUERIES = 4096
"""Queries that one task answers at a time, about."""
EXACT = float(2**53)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): ``floor(scale * x)`` per component; vectors that are null, empty or hold a null or non-finite one are left out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = rows.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).filter((F.size(vector_col) > 0) & ~bad)
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def _regions(pivots: np.ndarray, top: float):
    up = _lifted(pivots, top)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = _lifted(_matrix(b.column(1)), top)
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (up * up).sum(1)[None] - 2 * x @ up.T, 0))
            region = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(region.astype(np.int32)), pa.array(d[np.arange(len(d)), region])], names=["id", "v", "region", "d"])

    return run


def _pages(top: float):
    """One row per page of a partition: group, routing vector, radius, ids, vectors (flat) and parent distances."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vectors = TaskContext.get().partitionId(), [], []

        def page(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            up = _lifted(x, top)
            route = up.mean(0)
            d = np.sqrt(((up - route) ** 2).sum(1))
            many = lambda a, t: pa.array([a], pa.list_(t))
            return pa.RecordBatch.from_arrays(
                [pa.array([group], pa.int32()), many(route, pa.float64()), pa.array([d.max()]), many(i, pa.int64()), many(x.ravel(), pa.float64()), many(d, pa.float64())],
                names=["g", "route", "radius", "ids", "vectors", "to_route"],
            )

        for b in it:
            ids.append(b.column(0).to_numpy())
            vectors.append(_matrix(b.column(1)))
            while sum(map(len, ids)) >= PAGE:
                i, x = np.concatenate(ids), np.concatenate(vectors)
                yield page(i[:PAGE], x[:PAGE])
                ids, vectors = [i[PAGE:]], [x[PAGE:]]
        if sum(map(len, ids)):
            yield page(np.concatenate(ids), np.concatenate(vectors))

    return run


def _routes(shared, top: float):
    """Each query with all groups and the largest product that each may hold, best first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, centers, reach = shared.value
        kind = pa.list_(pa.struct([("bound", pa.float64()), ("g", pa.int32())]))
        for b in it:
            for at in range(0, len(b), 256):
                own = b.slice(at, 256)
                rows = []
                for q in _matrix(own.column(2)):
                    square = float(q @ q)
                    low = np.maximum(np.sqrt(((centers - np.append(q, 0.0)) ** 2).sum(1)) - reach, 0)
                    bound = (square + top - low * low) / 2 + 1e-6 * (square + top + 1)
                    rows.append([{"bound": float(bound[i]), "g": int(groups[i])} for i in np.argsort(-bound, kind="stable")])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(rows, kind)], names=["query_id", "mark", "v", "gs"])

    return run


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products, also where doubles would round."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < EXACT:
        return (x @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in x.tolist()], dtype=object)


def _search(k: int, top: float):
    """Best-first search of one group's pages for each of some queries."""

    def run(key: tuple, pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(pages) and len(queries):
            routes = np.stack(pages["route"].to_numpy())
            radius = pages["radius"].to_numpy()
            dim = routes.shape[1] - 1
            vectors = [np.asarray(v).reshape(-1, dim) for v in pages["vectors"]]
            ids, to_route = [np.asarray(i) for i in pages["ids"]], [np.asarray(d) for d in pages["to_route"]]
            for query, mark, v, floor in queries[["query_id", "mark", "v", "floor"]].itertuples(index=False):
                q = np.asarray(v)
                square = float(q @ q)
                margin = 1e-6 * (square + top + 1)
                d = np.sqrt(((routes - np.append(q, 0.0)) ** 2).sum(1))
                best = lambda low: (square + top - np.maximum(low, 0) ** 2) / 2 + margin
                bound = best(d - radius)
                found: list[tuple[int, int]] = []
                worst = -np.inf if floor is None or floor != floor else float(floor)
                for p in np.argsort(-bound, kind="stable"):
                    if bound[p] < worst:
                        break
                    some = np.flatnonzero(best(np.abs(d[p] - to_route[p])) >= worst)
                    some = some[ids[p][some] != query]
                    score = _products(vectors[p][some], q)
                    found += zip((-score).tolist(), ids[p][some].tolist(), strict=True)
                    if len(found) > k:
                        found = sorted(found)[:k]
                    if len(found) == k:
                        worst = max(worst, float(-max(found)[0]))
                out += [(query, mark, i, -s) for s, i in sorted(found)[:k]]
        return pd.DataFrame(out, columns=["query_id", "mark", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` the ``k`` rows with the largest integer product.

    Ties go to the smaller id; a row with the query's own id is no candidate; fewer than ``k`` candidates give all.
    Vectors that take no part (see ``whole_vectors``) are neither. Only vectors with as many components as the
    query count. Repeated rows are candidates each; a query repeated with another vector is a query of its own.
    """
    spark = rows.sparkSession
    v = stored(whole_vectors(rows, id_col, vector_col, scale), "vectors")
    q = stored(whole_vectors(queries, id_col, vector_col, scale).distinct(), "queries")
    schema = "query_id long, rank int, vec_id long, score long"
    parts = []
    for dim in sorted(r["n"] for r in q.select(F.size("v").alias("n")).distinct().collect()):  # lengths of vectors: a few
        one = _nearest(v.filter(F.size("v") == dim), q.filter(F.size("v") == dim), k)
        if one is not None:
            parts.append(one)
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.union(p)
    return out


def _nearest(v: DataFrame, q: DataFrame, k: int) -> DataFrame | None:
    n, top = v.select(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return None
    pivots = np.array([r["v"] for r in v.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()])
    placed = v.mapInArrow(_regions(pivots, top), "id long, v array<double>, region int, d double")
    groups = min(MAX_GROUPS, max(1, -(-n // GROUP)))
    ordered = placed.repartitionByRange(groups, "region", "d", "id").sortWithinPartitions("region", "d", "id").select("id", "v")
    pages = stored(ordered.mapInArrow(_pages(top), "g int, route array<double>, radius double, ids array<long>, vectors array<double>, to_route array<double>"), "pages")
    # a group's center is its first routing vector; one row per group
    centers = pages.groupBy("g").agg(F.min_by("route", F.element_at("ids", 1)).alias("center"))
    far = pages.join(centers, "g").select("g", "center", (_distance(F.col("route"), F.col("center")) + F.col("radius")).alias("reach"))
    tree = stored(far.groupBy("g").agg(F.max("reach").alias("reach"), F.first("center").alias("center")), "groups")
    near = tree.orderBy("g").collect()  # at most MAX_GROUPS rows, or one per shuffle partition
    shared = v.sparkSession.sparkContext.broadcast((np.array([r["g"] for r in near]), np.array([r["center"] for r in near]), np.array([r["reach"] for r in near])))
    asked = q.select(F.col("id").alias("query_id"), F.xxhash64("v").alias("mark"), "v")
    routed = stored(asked.mapInArrow(_routes(shared, top), "query_id long, mark long, v array<double>, gs array<struct<bound: double, g: int>>"), "routed")
    first = routed.select("query_id", "mark", "v", F.element_at("gs", 1)["g"].alias("g"), F.lit(None).cast("double").alias("floor"))
    home = stored(_searched(first, pages, k, top), "home")
    floors = home.groupBy("query_id", "mark").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    rest = routed.join(floors, ["query_id", "mark"], "left").select("query_id", "mark", "v", "floor", F.explode(F.slice("gs", 2, F.size("gs"))).alias("t"))
    rest = rest.filter(F.col("floor").isNull() | (F.col("t.bound") >= F.col("floor"))).select("query_id", "mark", "v", F.col("t.g").alias("g"), "floor")
    found = home.union(_searched(rest, pages, k, top))
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _searched(asked: DataFrame, pages: DataFrame, k: int, top: float) -> DataFrame:
    """Blocks of queries against the pages of one group at a time."""
    blocks = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
    left = pages.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(_search(k, top), "query_id long, mark long, vec_id long, score long")
