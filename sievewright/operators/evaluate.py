"""Ranking metrics, their means, and paired randomisation tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def metrics(ranked: DataFrame, qrels: DataFrame, by: list[str]) -> DataFrame:
    """P, R and AP at 5 and 10, nDCG at 10 and reciprocal rank, per ``by`` (query_id among them).

    Grade 2 is relevant; nDCG also gains from grade 1 (2**g - 1). AP is divided by the smaller of K and the number of
    relevant documents. Queries of ``qrels`` only: one without results has zeros.
    """
    rel = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") == 2).alias("nrel"))
    best = qrels.where("grade > 0").withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade")))).where("i <= 10")
    best = best.groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("i") + 1.0)).alias("ideal"))
    hits = ranked.where("rank <= 10").join(qrels, ["query_id", "doc_id"], "left").withColumn("hit", (F.coalesce("grade", F.lit(0)) == 2).cast("int"))
    hits = hits.withColumn("so_far", F.sum("hit").over(W.partitionBy(*by).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    at = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(0.0))
    gain = (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("rank") + 1.0)
    sums = hits.groupBy(*by).agg(
        at(5, F.col("hit")).alias("h5"), at(10, F.col("hit")).alias("h10"), at(5, F.col("hit") * F.col("so_far") / F.col("rank")).alias("a5"), at(10, F.col("hit") * F.col("so_far") / F.col("rank")).alias("a10"), F.sum(gain).alias("dcg"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")
    )
    both = sums.join(rel, "query_id").join(best, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        *by, (F.col("h5") / 5).alias("p5"), (F.col("h10") / 10).alias("p10"), z(F.try_divide("h5", "nrel")).alias("r5"), z(F.try_divide("h10", "nrel")).alias("r10"),
        z(F.try_divide("a5", F.least("nrel", F.lit(5)))).alias("ap5"), z(F.try_divide("a10", F.least("nrel", F.lit(10)))).alias("ap10"), z(F.try_divide("dcg", "ideal")).alias("ndcg10"), z(F.try_divide(F.lit(1.0), "first")).alias("mrr"),
    )


def recall_ceiling(qrels: DataFrame) -> DataFrame:
    """(query_id, ceiling): the best recall that five results can have."""
    return qrels.where("grade = 2").groupBy("query_id").agg((F.least(F.lit(5), F.count("*")) / F.count("*")).alias("ceiling"))


def means(scores: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means over seeds for each query, then over queries."""
    per_query = scores.groupBy(*by, "query_id").agg(*(F.avg(v).alias(v) for v in values))
    return per_query.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))


def sign_flip(diffs: DataFrame, by: list[str], trials: int = 10_000, seed: int = 7) -> DataFrame:
    """(by…, observed, p): two-sided paired test of ``diffs(by…, query_id, diff)``; no difference gives p = 1.

    Signs come from a portable hash of trial and query position, so every engine flips the same ones.
    """
    pos = diffs.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy("query_id")))
    each = pos.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    h = F.pmod((F.col("trial") * 1000 + F.col("pos")) * F.lit(2654435761) + F.lit(seed * 40503), F.lit(1 << 32))
    sign = F.when(h < (1 << 31), 1.0).otherwise(-1.0)
    flipped = each.groupBy(*by, "trial").agg(F.abs(F.avg(sign * F.col("diff"))).alias("m"))
    seen = diffs.groupBy(*by).agg(F.avg("diff").alias("observed"))
    joined = flipped.join(seen, by) if by else flipped.crossJoin(seen)
    out = joined.groupBy(*by).agg(F.any_value("observed").alias("observed"), F.count_if(F.col("m") >= F.abs("observed") - 1e-12).alias("hits"))
    return out.select(*by, "observed", F.when(F.abs("observed") < 1e-15, 1.0).otherwise((F.col("hits") + 1) / (trials + 1)).alias("p"))


def graded(listings: DataFrame, full: Column, part: Column) -> DataFrame:
    """(doc_id, grade): 2 where the full rule holds, 1 where only the part does."""
    return listings.select(F.col("id").alias("doc_id"), F.when(full, 2).when(part, 1).otherwise(0).alias("grade")).where("grade > 0")
