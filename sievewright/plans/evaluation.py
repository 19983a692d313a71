"""Evaluation of systems over judged queries: metrics, ablations, sensitivity, significance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Ranking
from ..operators import analyze, evaluate, filters, index, rank, score
from ..operators.index import Index
from ..storage import Tables
from .search import Search

SYSTEMS = ("keyword", "tfidf", "tfidf_jaccard", "bm25", "hybrid")
METRICS = ("p5", "p10", "r5", "r10", "ap5", "ap10", "ndcg10", "mrr")
ABLATIONS = {"no_routing": {"use_routing": False}, "no_jaccard": {"w_jaccard": 0.0}, "no_worktype": {"zone_weights": {"WorkType": 0.0}}, "no_diversity": {"diversity": False}}
TITLE_WEIGHTS = (0.2, 0.3, 0.45, 0.6, 0.75)
CUT = 10  # rows of a ranking that metrics look at


def judged_grades(listings: DataFrame, judged: list[dict]) -> DataFrame:
    """(query_id, doc_id, grade) of rules (``must`` alone: 1, with ``should``: 2; without ``should`` all are 2)."""
    parts = []
    for q in judged:
        must, should = filters.rule(q.get("must") or {}), filters.rule(q.get("should") or {})
        parts.append(evaluate.graded(listings, must & should, must).select(F.lit(q["id"]).alias("query_id"), "doc_id", "grade"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def measured(scores: DataFrame, qrels: DataFrame, seeds: list[int], spread: DataFrame, spread_names: list[str], terms: DataFrame, cfg: Ranking, by: str) -> DataFrame:
    """(by, seed, query_id, metrics…) of ``scores(by, query_id, doc_id, score)``, in one ranking of all seeds.

    ``spread(by, query_id, doc_id, score)`` are the scores of names whose near ties are spread out anew under each seed.
    """
    keys = (by, "query_id")
    ranked = rank.many_seeds(scores.where("positive and score > 0 or not positive"), seeds, CUT, False, keys).select("seed", *keys, "doc_id", "rank")
    if spread_names:
        pools = rank.many_seeds(spread, seeds, cfg.pool * CUT, False, keys)
        ranked = ranked.unionByName(rank.diversified(pools, terms, CUT, cfg.epsilon, ("seed", *keys)).select("seed", *keys, "doc_id", "rank"))
    return evaluate.metrics(ranked, qrels, [by, "seed", "query_id"]).select(by, "seed", "query_id", *METRICS)


def _named(parts: list[tuple[str, DataFrame, bool]], by: str) -> DataFrame:
    made = [p.select(F.lit(name).alias(by), "query_id", "doc_id", "score", F.lit(positive).alias("positive")) for name, p, positive in parts]
    return reduce(DataFrame.unionByName, made)


def scored_systems(ix: Index, queries: DataFrame, qrels: DataFrame, seeds: list[int], cfg: Ranking = Ranking(), systems=SYSTEMS) -> DataFrame:
    """(system, seed, query_id, metrics…): each system scores once, which is written, and is ranked under every seed."""
    s = Search(ix, queries, cfg)
    tables = Tables(ix.listings.sparkSession, "systems")
    scores = tables.written(_named([(n, s.scores if n == "hybrid" else s.baseline_scores(n), n != "hybrid") for n in systems], "system"))
    spread = [n for n in systems if n == "hybrid" and cfg.diversity]
    plain, apart = scores.where(~F.col("system").isin(spread)), scores.where(F.col("system").isin(spread))
    return tables.written(measured(plain, qrels, seeds, apart, spread, index.term_sets(ix.zoned), cfg, "system"))


def ablations(ix: Index, queries: DataFrame, qrels: DataFrame, seeds: list[int], cfg: Ranking = Ranking()) -> DataFrame:
    """(variant, metrics…, and the change of each against the full system)."""
    variants = {name: cfg.override(**change) for name, change in {"full": {}, **ABLATIONS}.items()}
    tables = Tables(ix.listings.sparkSession, "ablations")
    scores = tables.written(_named([(n, Search(ix, queries, c).scores, False) for n, c in variants.items()], "variant"))
    spread = [n for n, c in variants.items() if c.diversity]
    plain, apart = scores.where(~F.col("variant").isin(spread)), scores.where(F.col("variant").isin(spread))
    found = measured(plain, qrels, seeds, apart, spread, index.term_sets(ix.zoned), cfg, "variant")
    every = tables.written(evaluate.means(found, ["variant"], list(METRICS)))
    full = every.where("variant = 'full'").select(*(F.col(m).alias(f"_{m}") for m in METRICS))
    return every.crossJoin(F.broadcast(full)).select("variant", *METRICS, *((F.col(m) - F.col(f"_{m}")).alias(f"d_{m}") for m in METRICS))  # one row


def sensitivity(ix: Index, queries: DataFrame, qrels: DataFrame, seeds: list[int], cfg: Ranking = Ranking()) -> DataFrame:
    """(title_weight, metrics…): the other zones share what the title leaves of one, in their proportions. Zones are scored
    once; only their shares differ."""
    others = sum(w for z, w in cfg.zone_weights.items() if z != "Title")
    rows = [(t, z, t if z == "Title" else w / others * (1 - t)) for t in TITLE_WEIGHTS for z, w in cfg.zone_weights.items()]
    s = Search(ix, queries, cfg)
    spark, tables = ix.listings.sparkSession, Tables(ix.listings.sparkSession, "sensitivity")
    zoned = tables.written(score.cosine(s.vectors, ix.posts))
    weights = F.broadcast(spark.createDataFrame(rows, "title_weight double, zone string, alpha double"))
    active = s.vectors.select("query_id", "zone").distinct().join(weights, "zone")
    shares = active.withColumn("share", F.col("alpha") / F.sum("alpha").over(W.partitionBy("title_weight", "query_id"))).drop("alpha")
    cosines = zoned.join(shares, ["query_id", "zone"]).groupBy("title_weight", "query_id", "doc_id").agg(F.sum(F.col("share") * F.col("cosine")).alias("cosine"))
    flat = analyze.query_vectors(s.flat_words, ix.terms).join(active.select("query_id").distinct(), "query_id", "left_anti")
    rest = score.cosine(flat, ix.posts).select(F.explode(F.array(*map(F.lit, TITLE_WEIGHTS))).alias("title_weight"), "query_id", "doc_id", "cosine")
    both = cosines.unionByName(rest).join(score.jaccard(s.flat_words, ix.tf), ["query_id", "doc_id"], "left")
    mixed = (cfg.w_cosine * F.col("cosine") + cfg.w_jaccard * F.coalesce("jaccard", F.lit(0.0))) / (cfg.w_cosine + cfg.w_jaccard)
    scores = tables.written(both.select("title_weight", "query_id", "doc_id", mixed.alias("score"), F.lit(False).alias("positive")))
    plain, apart = (scores.limit(0), scores) if cfg.diversity else (scores, scores.limit(0))
    found = measured(plain, qrels, seeds, apart, list(TITLE_WEIGHTS) if cfg.diversity else [], index.term_sets(ix.zoned), cfg, "title_weight")
    return evaluate.means(found, ["title_weight"], list(METRICS))


def significance(scores: DataFrame, base: str = "hybrid", others=("keyword", "tfidf", "bm25"), names=("p5", "ap5", "ndcg10"), split: DataFrame | None = None, trials: int = 10_000) -> DataFrame:
    """(system, metric, split, observed, p): paired sign-flip tests of per-query means against ``base``."""
    per_query = scores.groupBy("system", "query_id").agg(*(F.avg(m).alias(m) for m in names))
    long = per_query.select("system", "query_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names))).alias("x")).select("system", "query_id", "x.*")
    mine = long.where(F.col("system") == base).select("query_id", "metric", F.col("v").alias("mine"))
    diffs = long.where(F.col("system").isin(*others)).join(mine, ["query_id", "metric"]).select("system", "metric", "query_id", (F.col("mine") - F.col("v")).alias("diff"))
    every = diffs.withColumn("split", F.lit("all"))
    if split is not None:
        every = every.unionByName(diffs.join(split.select("query_id", "split"), "query_id"))
    return evaluate.sign_flip(every, ["system", "metric", "split"], trials)


def run(ix: Index, judged: list[dict], seeds: list[int] = list(range(10)), trials: int = 10_000) -> dict[str, DataFrame]:
    """The whole evaluation of ``judged`` queries (id, query, type, split, must, should): per query, per system over all and
    by split, by type, ablations, significance over all and by split, sensitivity, and the recall ceiling."""
    spark = ix.listings.sparkSession
    queries = spark.createDataFrame([(q["id"], q["query"]) for q in judged], "query_id string, query string")
    about = F.broadcast(spark.createDataFrame([(q["id"], q.get("type"), q.get("split")) for q in judged], "query_id string, type string, split string"))  # a row for each query
    qrels = Tables(spark, "judged").written(judged_grades(ix.listings, judged))
    scores = scored_systems(ix, queries, qrels, seeds)
    per_query = scores.groupBy("system", "query_id").agg(*(F.avg(m).alias(m) for m in METRICS)).join(about, "query_id")
    over = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("queries"), *(F.avg(m).alias(m) for m in METRICS))
    return {
        "queries": per_query, "systems": over(per_query, "system"), "by_split": over(per_query.where("split is not null"), "system", "split"), "by_type": over(per_query, "system", "type"),
        "ablations": ablations(ix, queries, qrels, seeds), "significance": significance(scores, split=about.where("split is not null"), trials=trials),
        "sensitivity": sensitivity(ix, queries, qrels, seeds), "recall_ceiling": evaluate.recall_ceiling(qrels),
    }
