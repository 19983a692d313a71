"""Nearest neighbours by largest inner product over low-dimensional stable projections and a kd-tree.

Vectors are lifted so that the largest inner product is the nearest point, and projected by a Gaussian (2-stable)
matrix to DIMS dimensions. The upper part of a kd-tree over the projections is fitted on a bounded sample and
deals all rows into leaves; a leaf's own subtree is built where the leaf is searched. A query goes to its own leaf
first, whose k-th best distance bounds the leaves it needs to see at all; in each leaf, blocks are taken in order
of their projected distance and verified with the original vectors, until the chi-square test says that a nearer
point further out in the projection is unlikely: P(chi2_DIMS <= (r / d_k)^2) >= SURE.

Matrix products only screen rows: what may be among the best is scored again as a sum in the order of components, so
that a score depends on its two vectors alone and equal vectors tie exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, small

DIMS = 8  # even, so that the distribution has a closed form
SURE = 0.97
SAMPLE = 20_000  # rows that the upper tree is fitted on
LEAF_ROWS, MOST_LEAVES = 4096, 4096  # rows that a leaf is meant to hold; leaves of the upper tree at most (it is broadcast)
UNIT_ROWS = 8192  # rows of a leaf searched by one task; a larger leaf (equal vectors) is dealt out
UNIT_QUERIES = 4096  # queries that one task asks of a unit
UNIT_NUMBERS = 1 << 22  # components that one task holds: longer vectors, smaller units
BLOCK = 128


def chi_square_bound(sure: float, dims: int) -> float:
    """x with P(chi2_dims <= x) = sure, for even dims."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < sure else (lo, mid)
    return hi


def kd_split(points: np.ndarray, most: int) -> tuple[list, np.ndarray]:
    """A kd-tree that halves the widest dimension at its median until nodes have at most ``most`` rows.

    Nodes are (dim, cut, left, right), leaves (-1, leaf, 0, 0); also the leaf of each row.
    """
    nodes: list = []
    leaf_of = np.zeros(len(points), np.int64)
    leaves = 0
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        part = points[rows]
        dim = int(np.argmax(np.ptp(part, axis=0))) if len(rows) else 0
        cut = float(np.median(part[:, dim])) if len(rows) else 0.0
        left = part[:, dim] < cut if len(rows) else np.zeros(0, bool)
        if len(rows) <= most or not left.any():
            nodes.append([-1, leaves, 0, 0])
            leaf_of[rows] = leaves
            leaves += 1
            continue
        nodes.append([dim, cut, 0, 0])
        todo += [(rows[left], at, 0), (rows[~left], at, 1)]
    return nodes, leaf_of


def descend(nodes: list, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        dim, cut, left, right = nodes[at]
        if dim < 0:
            out[rows] = cut
            continue
        under = points[rows, dim] < cut
        todo += [(left, rows[under]), (right, rows[~under])]
    return out


class Projection:
    """Lifts and projects vectors, multiplied by ``scale``, of ``dim`` components whose largest norm is then ``radius``.

    ``scale`` is a power of two that brings the largest component below one, so that no square overflows.
    """

    def __init__(self, dim: int, scale: float, radius: float, seed: int = 7):
        self.dim, self.scale, self.radius = dim, scale, radius
        self.matrix = np.random.default_rng(seed).standard_normal((dim + 1, DIMS))

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        last = np.sqrt(np.maximum(self.radius**2 - (x * x).sum(1), 0.0))
        return x @ self.matrix[:-1] + last[:, None] * self.matrix[-1]

    def units(self, x: np.ndarray) -> np.ndarray:
        """Vectors of length one."""
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def queries(self, units: np.ndarray) -> np.ndarray:
        return (units * self.radius) @ self.matrix[:-1]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers; shorter lists are filled up with zeros."""
    flat = np.asarray(column.flatten(), np.float64)
    sizes = np.asarray(column.value_lengths())
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added up component by component: the same for a vector wherever it stands."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def _search(ids, vectors, low, q_ids, queries, units, q_low, bound, k, project, limit):
    """Best k of one unit for each query: (query index, id, score) arrays. ``bound``: squared distance known for the k-th."""
    _, block_of = kd_split(low, BLOCK)
    order = np.argsort(block_of, kind="stable")
    ids, vectors, low, block_of = ids[order], vectors[order], low[order], block_of[order]
    scaled, radius = vectors * project.scale, project.radius
    edges = np.flatnonzero(np.diff(block_of, prepend=-1, append=len(block_of) + 1))
    lows = np.array([low[a:b].min(0) for a, b in zip(edges, edges[1:], strict=False)])
    highs = np.array([low[a:b].max(0) for a, b in zip(edges, edges[1:], strict=False)])
    slack = 8 * vectors.shape[1] * np.finfo(float).eps * radius  # more than rounding can move a product of the screen
    out_q, out_id, out_s = [], [], []
    for j in range(len(q_ids)):
        gap = np.maximum(0, np.maximum(lows - q_low[j], q_low[j] - highs))
        gap = (gap * gap).sum(1)
        near, least = bound[j], -np.inf
        best_s, best_i, best_u = np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(gap, kind="stable"):
            if gap[b] >= limit * near:
                break
            cut = slice(edges[b], edges[b + 1])
            seen = scaled[cut] @ units[j]
            hit = np.flatnonzero((seen >= least - slack) & (ids[cut] != q_ids[j]))
            if not len(hit):
                continue
            exact = scores(vectors[cut][hit], queries[j])
            best_s, best_i, best_u = np.concatenate((best_s, exact)), np.concatenate((best_i, ids[cut][hit])), np.concatenate((best_u, seen[hit]))
            if len(best_s) > k:
                keep = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i, best_u = best_s[keep], best_i[keep], best_u[keep]
            if len(best_s) >= k:
                least = best_u.min()
                near = min(near, max(2 * radius**2 - 2 * radius * least, 0.0))
        keep = np.lexsort((best_i, -best_s))[:k]
        out_q.append(np.full(len(keep), j))
        out_id.append(best_i[keep])
        out_s.append(best_s[keep])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_id, np.int64), cat(out_s, np.float64)


def nearest(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, of all rows but those with its id.

    ``is_query`` is a SQL condition on ``vec_id``. Vectors that are null, all zero, or hold a null or a non-finite
    component, and rows with a null id, take no part; all others do, repeated rows too. Where lengths differ, shorter
    vectors count as filled up with zeros. Queries equal in id and vector are answered once. Ties go to the smaller
    id. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    fine = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null").where(fine)
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scale = 2.0 ** -min(max(math.frexp(top)[1], -1022), 1022)
    radius = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * scale) * (x * scale))))).first()[0]
    project = Projection(dim, scale, radius)
    unit_rows = min(UNIT_ROWS, max(BLOCK, UNIT_NUMBERS // dim))
    unit_queries = min(UNIT_QUERIES, max(BLOCK, UNIT_NUMBERS // dim))

    def projected(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(project.rows(_matrix(batch.column(0), dim))), pa.list_(pa.float64()))], ["y"])

    # DIMS numbers of each sampled row
    sample = rows.orderBy(F.xxhash64("vec_id"), F.xxhash64("v")).limit(SAMPLE).select("v").mapInArrow(projected, "y array<double>").collect()
    low = np.array(sorted(tuple(r.y) for r in sample), np.float64)
    leaves = min(MOST_LEAVES, -(-n // LEAF_ROWS))
    tree, _ = kd_split(low, max(1, -(-len(low) // leaves)))
    shared = spark.sparkContext.broadcast((tree, project))  # at most 2 * MOST_LEAVES nodes

    def place(batches):
        nodes, p = shared.value
        for batch in batches:
            y = p.rows(_matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(y), pa.list_(pa.float64())), pa.array(descend(nodes, y))], ["vec_id", "v", "y", "leaf"])

    data = scratch.table(rows.mapInArrow(place, "vec_id long, v array<double>, y array<double>, leaf long"), "rows")
    box = [f(F.col("y")[i]).alias(f"{m}{i}") for i in range(DIMS) for m, f in (("lo", F.min), ("hi", F.max))]
    boxes = data.groupBy("leaf").agg(F.count("*").alias("n"), *box).orderBy("leaf").collect()  # MOST_LEAVES rows
    leaf_ids = np.array([b.leaf for b in boxes])
    los = np.array([[b[f"lo{i}"] for i in range(DIMS)] for b in boxes])
    his = np.array([[b[f"hi{i}"] for i in range(DIMS)] for b in boxes])
    unit_table = F.broadcast(spark.createDataFrame([(int(b.leaf), -(-b.n // unit_rows)) for b in boxes], "leaf long, units int"))  # MOST_LEAVES rows
    data = data.withColumn("row", F.monotonically_increasing_id()).join(unit_table, "leaf").withColumn("unit", F.expr("cast(pmod(xxhash64(row), units) as int)"))

    # a query is one id with one vector
    asked = data.where(F.expr(is_query)).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("leaf").alias("home")).distinct()
    asked = scratch.table(asked.withColumn("query", F.xxhash64("query_id", "q")), "asked")
    limit = chi_square_bound(sure, DIMS)
    kind = "query_id long, query long, vec_id long, score double"

    def search(pairs: DataFrame) -> DataFrame:
        """``pairs(query_id, query, q, leaf, bound)``: each query in each unit of its leaf. The queries of a leaf go in
        chunks, and a unit's rows are copied once for each chunk of its own leaf."""
        counts = pairs.groupBy("leaf").agg(F.ceil(F.count("*") / unit_queries).cast("int").alias("chunks"))  # MOST_LEAVES rows
        counts = F.broadcast(scratch.table(counts, "chunks"))
        left = data.join(counts, "leaf").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).select("leaf", "unit", "chunk", "vec_id", "v", "y")
        right = pairs.join(counts, "leaf").withColumn("chunk", F.expr("cast(pmod(query, chunks) as int)"))
        right = right.join(unit_table, "leaf").withColumn("unit", F.explode(F.expr("sequence(0, units - 1)"))).select("leaf", "unit", "chunk", "query_id", "query", "q", "bound")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                who, found = np.zeros(0, np.int64), (None, np.zeros(0, np.int64), np.zeros(0))
            else:
                _, p = shared.value
                x, q = _matrix(left["v"].combine_chunks(), dim), _matrix(right["q"].combine_chunks(), dim)
                y = _matrix(left["y"].combine_chunks(), DIMS)
                u = p.units(q)
                found = _search(left["vec_id"].to_numpy(), x, y, right["query_id"].to_numpy(), q, u, p.queries(u), right["bound"].to_numpy(), k, p, limit)
                who = found[0]
            return pa.table({"query_id": right["query_id"].to_numpy()[who], "query": right["query"].to_numpy()[who], "vec_id": found[1], "score": found[2]})

        keys = ["leaf", "unit", "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, kind)

    def best(found: DataFrame) -> DataFrame:
        w = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    first = scratch.table(search(asked.select("query_id", "query", "q", F.col("home").alias("leaf"), F.lit(float("inf")).alias("bound"))), "home")
    bounds = best(first).groupBy("query_id", "query").agg(F.max("rank").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    bounds = scratch.table(bounds.select(F.col("query_id").alias("_i"), F.col("query").alias("_q"), "least"), "bounds")
    known = asked.join(small(bounds), (F.col("query_id") == F.col("_i")) & (F.col("query") == F.col("_q")), "left")

    def spread(batches):
        _, p = shared.value
        for batch in batches:
            q = _matrix(batch.column(2), dim)
            least = batch.column(4).to_numpy(zero_copy_only=False)
            units = p.units(q)
            length = np.abs(q).max(1) * np.sqrt(((q / np.abs(q).max(1, keepdims=True)) ** 2).sum(1))
            with np.errstate(all="ignore"):
                near = np.maximum(2 * p.radius**2 - 2 * p.radius * (least / length * p.scale), 0.0)
            near = np.where(np.isfinite(near), near, np.inf)
            y, home = p.queries(units), batch.column(3).to_numpy()
            for j in range(len(q)):
                gap = np.maximum(0, np.maximum(los - y[j], y[j] - his))
                hit = leaf_ids[((gap * gap).sum(1) < limit * near[j]) & (leaf_ids != home[j])]
                for a in range(0, len(hit), 1024):
                    to = pa.array(hit[a : a + 1024])
                    w = pa.array(np.full(len(to), j))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(w), batch.column(1).take(w), to, pa.array(np.full(len(to), near[j]))], ["query_id", "query", "leaf", "bound"])

    # which leaves each query goes on to, without its vector; the vector follows by a join on the query
    away = known.select("query_id", "query", "q", "home", "least").mapInArrow(spread, "query_id long, query long, leaf long, bound double")
    away = scratch.table(away, "away")
    met = away.join(asked.select(F.col("query_id").alias("_i"), F.col("query").alias("_q"), "q"), (F.col("query_id") == F.col("_i")) & (F.col("query") == F.col("_q")))
    rest = search(met.select("query_id", "query", "q", "leaf", "bound"))
    return best(first.union(rest)).select("query_id", "rank", "vec_id", "score")
