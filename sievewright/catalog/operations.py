"""Whole operations: search with records and reasons, transition, sensitivity, significance. Their parts have SQL of their own."""

from functools import reduce

from pyspark.sql import functions as F

from ..config import Ranking
from ..plans import evaluation, search, transition
from ..sources import tables
from .evaluation import QRELS, VALUES, _metric_sql, _qrels
from .ranking import SCORED, SCORED_PARTS, _Scored
from .registry import BATCH, batch, catalog_index, query, rounded

#: Tie-breaks that metrics are averaged over.
SEEDS = list(range(10))


@query()
def c01_search(spark, sf):
    out = search.search(catalog_index(spark, sf), "small ring economy", 10, wanted={"workplace": ["Remote"]}, sort="newest")
    return rounded(out.select("doc_id", "score", "rank", "position", "title", "company", F.array_join("reasons", "; ").alias("reasons")), "score")


@query()
def c07_transition(spark, sf):
    people = tables.profiles(spark, sf)
    return rounded(transition.transition(catalog_index(spark, sf), people, "blue bolt", k=5)["recommended"], "fit", "score")


@query()
def a15_sensitivity(spark, sf):
    s = _Scored(spark, sf)
    return rounded(evaluation.sensitivity(s.ix, batch(spark), _qrels(s), SEEDS), *VALUES)


RANKED = "SELECT {by}, seed, query_id, doc_id, rank FROM (SELECT {by}, seed, query_id, doc_id, row_number() OVER (PARTITION BY {by}, seed, query_id ORDER BY round(score, 12) DESC, ((doc_id % 1048576) * 2654435761 + seed * 40503) % 4294967296, doc_id) AS rank FROM {scores}, range(0, 10) s(seed) {where}) WHERE rank <= 10"
OTHERS = sum(w for z, w in Ranking().zone_weights.items() if z != "Title")
WEIGHTED = (
    ", tw AS (SELECT * FROM (VALUES " + ", ".join(f"({t!r}::DOUBLE, '{z}', {t if z == 'Title' else w / OTHERS * (1 - t)!r}::DOUBLE)" for t in evaluation.TITLE_WEIGHTS for z, w in Ranking().zone_weights.items()) + """) v(title_weight, zone, alpha)),
sh AS (SELECT title_weight, query_id, zone, alpha / sum(alpha) OVER (PARTITION BY title_weight, query_id) AS share FROM (SELECT DISTINCT query_id, zone FROM vec) JOIN tw USING (zone)),
cw AS (SELECT title_weight, query_id, doc_id, sum(share * cosine) AS cosine FROM zcos JOIN sh USING (query_id, zone) GROUP BY ALL
  UNION ALL SELECT title_weight, query_id, doc_id, cosine FROM fcos, (SELECT DISTINCT title_weight FROM tw) WHERE query_id NOT IN (SELECT query_id FROM sh)),
hw AS (SELECT title_weight, query_id, doc_id, (0.85 * cosine + 0.35 * coalesce(jaccard, 0)) / 1.2 AS score FROM cw LEFT JOIN jac USING (query_id, doc_id)) """
)


@query(
    QRELS + WEIGHTED + _metric_sql(RANKED.format(by="title_weight", scores="hw", where=""), "title_weight, seed, query_id")
    + ", a AS (SELECT title_weight, query_id, " + ", ".join(f"avg({v}) AS {v}" for v in VALUES) + " FROM mt GROUP BY ALL) SELECT title_weight, " + ", ".join(f"round_even(avg({v}), 6) AS {v}" for v in VALUES) + " FROM a GROUP BY title_weight",
    ("listing", "q", "vec", "zcos", "fcos", "jac"),
)
def a15_sensitivity_plain(spark, sf):
    """Without spreading near ties, which SQL cannot say."""
    s = _Scored(spark, sf)
    return rounded(evaluation.sensitivity(s.ix, batch(spark), _qrels(s), SEEDS, Ranking(diversity=False)), *VALUES)


@query()
def a16_significance(spark, sf):
    """All systems, all seeds, with near ties spread out."""
    s = _Scored(spark, sf)
    scores = evaluation.scored_systems(s.ix, batch(spark), _qrels(s), SEEDS)
    return rounded(evaluation.significance(scores), "observed", "p")


SIGNS = """, pq AS (SELECT system, query_id, avg(p5) AS p5, avg(ap5) AS ap5, avg(ndcg10) AS ndcg10 FROM mt GROUP BY ALL),
lg AS (SELECT system, query_id, unnest(['p5', 'ap5', 'ndcg10']) AS metric, unnest([p5, ap5, ndcg10]) AS v FROM pq),
dd AS (SELECT o.system, o.metric, o.query_id, h.v - o.v AS diff FROM lg o JOIN lg h ON h.system = 'hybrid' AND h.metric = o.metric AND h.query_id = o.query_id WHERE o.system IN ('keyword', 'tfidf', 'bm25')),
pos AS (SELECT *, row_number() OVER (PARTITION BY system, metric ORDER BY query_id) AS pos FROM dd),
fl AS (SELECT system, metric, trial, abs(avg(CASE WHEN ((trial * 1000 + pos) * 2654435761 + 283521) % 4294967296 < 2147483648 THEN diff ELSE -diff END)) AS m FROM pos, range(1, 10001) t(trial) GROUP BY ALL),
ob AS (SELECT system, metric, avg(diff) AS observed FROM dd GROUP BY ALL)
SELECT system, metric, 'all' AS split, round_even(any_value(observed), 6) AS observed, round_even(CASE WHEN abs(any_value(observed)) < 1e-15 THEN 1 ELSE (count(*) FILTER (m >= abs(observed) - 1e-12) + 1) / 10001 END, 6) AS p FROM ob JOIN fl USING (system, metric) GROUP BY system, metric"""


@query(QRELS + SCORED + _metric_sql(RANKED.format(by="system", scores="sc", where="WHERE system = 'hybrid' OR score > 0"), "system, seed, query_id") + SIGNS, ("listing", "q", *SCORED_PARTS))
def a16_significance_plain(spark, sf):
    """Without spreading near ties, which SQL cannot say."""
    s = _Scored(spark, sf)
    scores = evaluation.scored_systems(s.ix, batch(spark), _qrels(s), SEEDS, Ranking(diversity=False))
    return rounded(evaluation.significance(scores), "observed", "p")


@query()
def a14_ablations(spark, sf):
    s = _Scored(spark, sf)
    return rounded(evaluation.ablations(s.ix, batch(spark), _qrels(s), SEEDS), *VALUES, *(f"d_{v}" for v in VALUES))


def judged():
    """The batch as judged queries: rules over labels and skills, types by length, every third held for tests."""
    rules = {"must": {"role_family": ["SMALL", "ECONOMY", "STANDARD"]}, "should": {"role_family": ["SMALL"]}}
    return [{"id": f"q{i}", "query": text, "type": "short" if len(text.split()) < 3 else "long", "split": "test" if i % 3 == 0 else "dev", **rules} for i, text in BATCH]


@query()
def c13_evaluation(spark, sf):
    """One run over all systems, seeds, splits and types."""
    out = evaluation.run(catalog_index(spark, sf), judged(), SEEDS)
    rows = [out[name].select(F.lit(name).alias("part"), "system", (F.lit("") if by is None else F.col(by)).alias("of"), "queries", *VALUES) for name, by in (("systems", None), ("by_split", "split"), ("by_type", "type"))]
    return rounded(reduce(lambda a, b: a.unionByName(b), rows), *VALUES)
