"""Orders and cuts of scored documents. Scores are rounded to twelve places before they are compared."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import portable_hash

EXACT = 12


def tie_break(seed: int | None) -> Column:
    """The id, or a pseudorandom number per id."""
    return F.col("doc_id") if seed is None else portable_hash(F.col("doc_id"), seed)


def top_k(scores: DataFrame, k: int, seed: int | None = None, positive: bool = False) -> DataFrame:
    """``scores`` with ``rank`` 1 .. k per query; the window is cut while it is filled, so no query is sorted as a whole."""
    if positive:
        scores = scores.where("score > 0")
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", EXACT)), tie_break(seed), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def many_seeds(scores: DataFrame, seeds: list[int], k: int, positive: bool = True, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rankings of one scoring pass under several tie-breaks: (seed, by…, doc_id, score, rank). Before any row is copied for
    a seed, rows go that no tie-break can bring among the first k."""
    if positive:
        scores = scores.where("score > 0")
    level = F.rank().over(W.partitionBy(*by).orderBy(F.desc(F.round("score", EXACT))))
    scores = scores.withColumn("level", level).where(F.col("level") <= k).drop("level")
    each = scores.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    tie = F.pmod(F.pmod("doc_id", F.lit(1 << 20)) * F.lit(2654435761) + F.col("seed") * 40503, F.lit(1 << 32))
    w = W.partitionBy("seed", *by).orderBy(F.desc(F.round("score", EXACT)), tie, "doc_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def _greedy(pool: list[tuple], k: int, value: Callable[[float, float, float], tuple | None]) -> list[tuple]:
    """Picks k of (id, relevance, terms) in turn: the one of the largest value(relevance, closest picked, best left)."""
    left, closest, out = list(range(len(pool))), [0.0] * len(pool), []
    while left and len(out) < k:
        best_left = max(pool[i][1] for i in left)
        pick, top = None, None
        for i in left:
            v = value(pool[i][1], closest[i], best_left)
            if v is not None and (top is None or v > top):
                pick, top = i, v
        left.remove(pick)
        out.append((pool[pick][0], pool[pick][1], closest[pick]))
        for i in left:
            closest[i] = max(closest[i], _similarity(pool[i][2], pool[pick][2]))
    return out


def _rerank(ranked: DataFrame, sets: DataFrame, k: int, value, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``ranked`` must be cut to a pool: each pool goes to one task."""
    by = list(by)
    pool = ranked.join(sets.select("doc_id", "terms"), "doc_id").select(*by, "doc_id", "score", "rank", "terms")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        picked = _greedy([(d, s, set(t)) for d, s, t in zip(frame["doc_id"], frame["score"], frame["terms"], strict=True)], k, value)
        own = [frame[c].iloc[0] for c in by]
        return pd.DataFrame([(*own, d, s, c, r + 1) for r, (d, s, c) in enumerate(picked)], columns=[*by, "doc_id", "score", "closest", "rank"])

    kind = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in by) + ", doc_id long, score double, closest double, rank int"
    return pool.groupBy(*by).applyInPandas(run, kind)


def diversified(ranked: DataFrame, sets: DataFrame, k: int, epsilon: float = 0.0, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Within epsilon of the best left, the least similar to what is picked; then relevance, then pool order."""
    return _rerank(ranked, sets, k, lambda rel, near, best: None if rel < best - epsilon - 1e-12 else (-near, rel), by)


def mmr(ranked: DataFrame, sets: DataFrame, k: int, lam: float) -> DataFrame:
    """Maximal marginal relevance; differences below 1e-12 are ties and go to pool order."""
    return _rerank(ranked, sets, k, lambda rel, near, best: (round((lam * rel - (1 - lam) * near) * 1e12),))


def resorted(top: DataFrame, by: str) -> DataFrame:
    """The rows of a result in another order ("best", "newest", "company", "location"), numbered in ``position``; ``rank`` stays."""
    keys = {"best": [], "newest": [F.col("posted").desc_nulls_last()], "company": [F.lower("company")], "location": [F.lower(F.coalesce(F.nullif("location", F.lit("")), F.lit("~")))]}[by]
    return top.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*keys, "rank")))


def browse(listings: DataFrame, k: int) -> DataFrame:
    """Without a query: newest first, then by id."""
    return listings.orderBy(F.col("posted").desc_nulls_last(), "id").limit(k)


def similar(ids: DataFrame, posts: DataFrame, listings: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, sim, rank) of the records most like each of ``ids(query_id)``: half the title's and half the skills'
    cosine. Of the first 6k, one per title and company, and none with the source's own."""
    both = posts.where("zone in ('Title', 'Skills')").select("zone", "term", "doc_id", "dw")
    mine = both.join(ids.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").select("zone", "term", F.col("doc_id").alias("query_id"), F.col("dw").alias("qw"))
    sims = both.join(mine, ["zone", "term"]).where("doc_id <> query_id").groupBy("query_id", "doc_id").agg(F.sum(0.5 * F.col("qw") * F.col("dw")).alias("sim"))
    order = [F.desc(F.round("sim", EXACT)), "doc_id"]
    pool = sims.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("r") <= 6 * k).drop("r")
    name = listings.select(F.col("id").alias("doc_id"), F.lower("title").alias("t"), F.lower("company").alias("c"))
    own = name.select(F.col("doc_id").alias("query_id"), F.col("t").alias("qt"), F.col("c").alias("qc"))
    named = pool.join(name, "doc_id").join(own, "query_id").where("not (t = qt and c = qc)")
    one = named.withColumn("r", F.row_number().over(W.partitionBy("query_id", "t", "c").orderBy(*order))).where("r = 1")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "doc_id", "sim", "rank")
