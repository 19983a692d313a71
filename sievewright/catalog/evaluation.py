"""Metrics and randomisation tests over the judged batch."""

from pyspark.sql import functions as F

from ..operators import evaluate, rank, score
from .ranking import _Scored
from .registry import query, rounded

VALUES = ["p5", "p10", "r5", "r10", "ap5", "ap10", "ndcg10", "mrr"]
QRELS = ", qrels AS (SELECT query_id, id AS doc_id, CASE WHEN role_family = 'SMALL' AND workplace = 'Remote' THEN 2 ELSE 1 END AS grade FROM listing, (SELECT DISTINCT query_id FROM q) WHERE role_family = 'SMALL')"


def _metric_sql(ranks: str, by: str) -> str:
    on = by.replace("query_id", "h.query_id")
    return f""", rk AS ({ranks}), nr AS (SELECT query_id, count(*) FILTER (grade = 2) AS nrel FROM qrels GROUP BY ALL),
bi AS (SELECT query_id, sum((2 ** grade - 1) / log2(i + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS i FROM qrels) WHERE i <= 10 GROUP BY ALL),
h AS (SELECT rk.*, coalesce(grade, 0) AS grade, coalesce(grade = 2, false)::INT AS hit FROM rk LEFT JOIN qrels USING (query_id, doc_id) WHERE rank <= 10),
hs AS (SELECT *, sum(hit) OVER (PARTITION BY {by} ORDER BY rank) AS so_far FROM h),
mt AS (SELECT {on.replace("h.", "hs.")}, sum(hit) FILTER (rank <= 5) / 5 AS p5, sum(hit) / 10 AS p10, coalesce(sum(hit) FILTER (rank <= 5) / nullif(any_value(nrel), 0), 0) AS r5, coalesce(sum(hit) / nullif(any_value(nrel), 0), 0) AS r10,
  coalesce(sum(hit * so_far / rank) FILTER (rank <= 5) / nullif(least(any_value(nrel), 5), 0), 0) AS ap5, coalesce(sum(hit * so_far / rank) / nullif(least(any_value(nrel), 10), 0), 0) AS ap10,
  coalesce(sum((2 ** grade - 1) / log2(rank + 1)) / any_value(ideal), 0) AS ndcg10, coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0) AS mrr FROM hs JOIN nr USING (query_id) LEFT JOIN bi USING (query_id) GROUP BY {on.replace("h.", "hs.")}) """


def _rounded_sql(by: str) -> str:
    return f"SELECT {by}, " + ", ".join(f"round_even({v}, 6) AS {v}" for v in VALUES) + " FROM mt"


def _qrels(s):
    rules = evaluate.graded(s.ix.listings, F.expr("role_family = 'SMALL' and workplace = 'Remote'"), F.expr("role_family = 'SMALL'"))
    return rules.join(F.broadcast(s.words.select("query_id")))  # a batch of queries


HYBRID = "SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 10"
SEEDS = "SELECT seed, query_id, doc_id, rank FROM (SELECT seed, query_id, doc_id, row_number() OVER (PARTITION BY seed, query_id ORDER BY round(score, 12) DESC, ((doc_id % 1048576) * 2654435761 + seed * 40503) % 4294967296, doc_id) AS rank FROM hyb, (VALUES (0), (1), (2), (3)) s(seed) WHERE score > 0) WHERE rank <= 10"
KEYWORD = "SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank FROM flatq JOIN tf USING (zone, term) GROUP BY query_id, doc_id) WHERE rank <= 10"


@query(QRELS + _metric_sql(HYBRID, "query_id") + _rounded_sql("query_id"), ("listing", "q", "ranked"))
def a10_metrics(spark, sf):
    s = _Scored(spark, sf)
    return rounded(evaluate.metrics(rank.top_k(s.hybrid, 10), _qrels(s), ["query_id"]), *VALUES)


@query(QRELS + _metric_sql(SEEDS, "seed, query_id") + ", a AS (SELECT query_id, " + ", ".join(f"avg({v}) AS {v}" for v in VALUES) + " FROM mt GROUP BY query_id) SELECT 'hybrid' AS system, " + ", ".join(f"round_even(avg({v}), 6) AS {v}" for v in VALUES) + " FROM a", ("listing", "q", "hyb"))
def a11_means(spark, sf):
    s = _Scored(spark, sf)
    scores = evaluate.metrics(rank.many_seeds(s.hybrid, [0, 1, 2, 3], 10), _qrels(s), ["seed", "query_id"]).withColumn("system", F.lit("hybrid"))
    return rounded(evaluate.means(scores, ["system"], VALUES), *VALUES)


@query(QRELS + "SELECT query_id, round_even(least(5, count(*)) / count(*), 6) AS ceiling FROM qrels WHERE grade = 2 GROUP BY query_id", ("listing", "q"))
def a12_recall_ceiling(spark, sf):
    return rounded(evaluate.recall_ceiling(_qrels(_Scored(spark, sf))), "ceiling")


FLIP = """, df AS (SELECT a.query_id, a.ndcg10 - b.ndcg10 AS diff FROM mt a JOIN mt2 b USING (query_id)), pos AS (SELECT *, row_number() OVER (ORDER BY query_id) AS pos FROM df),
fl AS (SELECT trial, abs(avg(CASE WHEN ((trial * 1000 + pos) * 2654435761 + 283521) % 4294967296 < 2147483648 THEN diff ELSE -diff END)) AS m FROM pos, range(1, 10001) t(trial) GROUP BY trial), ob AS (SELECT avg(diff) AS observed FROM df)
SELECT round_even(observed, 6) AS observed, round_even(CASE WHEN abs(observed) < 1e-15 THEN 1 ELSE ((SELECT count(*) FROM fl WHERE m >= abs(observed) - 1e-12) + 1) / 10001 END, 6) AS p FROM ob"""


@query(QRELS + _metric_sql(HYBRID, "query_id") + _metric_sql(KEYWORD, "query_id").replace(" mt AS", " mt2 AS").replace("rk AS", "rk2 AS").replace("FROM rk ", "FROM rk2 ").replace("rk.*", "rk2.*").replace(" nr AS", " nr2 AS").replace("nr USING", "nr2 USING").replace("\nbi AS", "\nbi2 AS").replace("JOIN bi ", "JOIN bi2 ").replace("\nh AS", "\nh2 AS").replace("FROM h)", "FROM h2)").replace("\nhs AS", "\nhs2 AS").replace("FROM hs ", "FROM hs2 ").replace("hs.query_id", "hs2.query_id").replace("\nmt AS", "\nmt2 AS") + FLIP, ("listing", "q", "ranked", "flatq", "tf"))
def a13_signflip(spark, sf):
    s = _Scored(spark, sf)
    qrels = _qrels(s)
    one = evaluate.metrics(rank.top_k(s.hybrid, 10), qrels, ["query_id"]).select("query_id", F.col("ndcg10").alias("x"))
    two = evaluate.metrics(rank.top_k(score.keyword(s.flat_words, s.ix.tf), 10), qrels, ["query_id"]).select("query_id", F.col("ndcg10").alias("y"))
    return rounded(evaluate.sign_flip(one.join(two, "query_id").select("query_id", (F.col("x") - F.col("y")).alias("diff")), []), "observed", "p")
