"""Scoring, filtering and ranking queries."""

from functools import reduce

from pyspark.sql import functions as F

from ..config import Ranking
from ..operators import analyze, dedup, filters, index, rank, score
from ..plans import search
from ..plans.evaluation import SYSTEMS
from ..sources import tables
from .analysis import TEXT_TF, _analysis
from .registry import WORDS, batch, catalog_index, once, query, rounded, sql_terms, text_index

TEXT_Q = TEXT_TF + ", q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in WORDS) + f") v(query_id, query)), qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({sql_terms('query', True)}) AS term FROM q) GROUP BY ALL) "
TEXT_COS = (
    TEXT_Q
    + """, w AS (SELECT doc_id, term, (1 + log10(tf)) * idf AS w FROM tf JOIN d USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY doc_id),
v AS (SELECT query_id, term, (1 + log10(qt.tf)) * idf AS p, sqrt(sum(power((1 + log10(qt.tf)) * idf, 2)) OVER (PARTITION BY query_id)) AS n FROM qt JOIN d USING (term)),
c AS (SELECT query_id, doc_id, sum(p / v.n * w / n.n) AS score FROM v JOIN w USING (term) JOIN n USING (doc_id) WHERE v.n > 0 AND n.n > 0 GROUP BY ALL) """
)


class _Scored:
    """The batch of queries analyzed and scored over the catalog."""

    def __init__(self, spark, sf, cfg=Ranking()):
        self.ix, self.words, self.skills, self.route = _analysis(spark, sf)
        self.vectors = analyze.query_vectors(self.route, self.ix.terms)
        self.flat_words = analyze.flat_query(self.words)
        self.flat = analyze.query_vectors(self.flat_words, self.ix.terms)
        self.jaccards = score.jaccard(self.flat_words, self.ix.tf)
        make = lambda: score.hybrid(score.zone_cosine(self.vectors, self.flat, self.ix.posts, cfg), self.jaccards, cfg)
        self.hybrid = once(spark, sf, f"hybrid {cfg}", make)
        self.cosines = self.hybrid.select("query_id", "doc_id", "cosine")


def _text(spark, sf):
    ix = text_index(spark, sf)
    flat = analyze.flat_query(analyze.query_words(batch(spark, WORDS)))
    return ix, flat


@query(TEXT_COS + "SELECT query_id, doc_id, round_even(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id)::INT AS rank FROM c) WHERE rank <= 10")
def r01_cosine_topk(spark, sf):
    ix, flat = _text(spark, sf)
    found = score.cosine(analyze.query_vectors(flat, ix.terms), ix.posts).select("query_id", "doc_id", F.col("cosine").alias("score"))
    return rounded(rank.top_k(found, 10), "score")


@query("SELECT query_id, zone, doc_id, round_even(cosine, 6) AS cosine FROM zcos", ("zcos",))
def r01_zone_scores(spark, sf):
    s = _Scored(spark, sf)
    return rounded(score.cosine(s.vectors, s.ix.posts), "cosine")


@query("SELECT query_id, doc_id, round_even(cosine, 6) AS cosine FROM cos", ("cos",))
def r04_zone_cosine(spark, sf):
    return rounded(_Scored(spark, sf).cosines, "cosine")


@query("SELECT query_id, doc_id, round_even(cosine, 6) AS cosine FROM fcos", ("fcos",))
def r05_flat_fallback(spark, sf):
    return rounded(_Scored(spark, sf, Ranking(use_zones=False)).cosines, "cosine")


@query("SELECT query_id, doc_id, round_even(jaccard, 6) AS jaccard FROM jac", ("jac",))
def r06_jaccard(spark, sf):
    return rounded(_Scored(spark, sf).jaccards, "jaccard")


@query("SELECT query_id, doc_id, round_even(cosine, 6) AS cosine, round_even(jaccard, 6) AS jaccard, round_even(score, 6) AS score, rank::INT AS rank FROM ranked WHERE rank <= 20", ("ranked",))
def r07_hybrid_topk(spark, sf):
    return rounded(rank.top_k(_Scored(spark, sf).hybrid, 20), "cosine", "jaccard", "score")


@query("SELECT query_id, candidates, (SELECT n FROM total) - candidates AS never_scored, postings FROM (SELECT query_id, count(*) AS candidates FROM cos GROUP BY ALL) JOIN (SELECT query_id, count(*) AS postings FROM vec JOIN post USING (zone, term) GROUP BY ALL) USING (query_id)", ("cos", "vec", "post", "total"))
def r08_candidate_stats(spark, sf):
    s = _Scored(spark, sf)
    return score.candidate_stats(s.cosines, s.vectors, s.ix.posts, s.ix.n)


@query("SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM flatq JOIN tf USING (zone, term) GROUP BY ALL", ("flatq", "tf"))
def r09_keyword(spark, sf):
    s = _Scored(spark, sf)
    return score.keyword(s.flat_words, s.ix.tf)


@query(TEXT_Q + ", l AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id), m AS (SELECT sum(len) / (SELECT count(*) FROM documents) AS mean, (SELECT count(*) FROM documents) AS n FROM l) SELECT query_id, doc_id, round_even(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN d USING (term) JOIN tf USING (term) JOIN l USING (doc_id), m GROUP BY ALL")
def r11_bm25(spark, sf):
    ix, flat = _text(spark, sf)
    return rounded(score.bm25(flat, ix.tf, ix.n), "score")


@query("SELECT query_id, doc_id, zone, term, round_even(share * qw * dw, 6) AS contribution, post.tf, df, round_even(idf, 4) AS idf FROM vec JOIN post USING (zone, term) JOIN shares USING (query_id, zone) JOIN dict USING (zone, term) JOIN (SELECT query_id, doc_id FROM ranked WHERE rank <= 5) USING (query_id, doc_id)", ("vec", "post", "shares", "dict", "ranked"))
def r13_contributions(spark, sf):
    s = _Scored(spark, sf)
    top = rank.top_k(s.hybrid, 5).select("query_id", "doc_id")
    parts = score.contributions(s.vectors, s.ix.posts, s.ix.terms).join(top, ["query_id", "doc_id"], "left_semi")
    return rounded(parts, "contribution").withColumn("idf", F.bround("idf", 4))


@query(
    """SELECT query_id, doc_id, zone, zone || ' matches: ' || string_agg(replace(term, '_', ' '), ', ' ORDER BY r) AS reason FROM (
SELECT query_id, doc_id, zone, term, row_number() OVER (PARTITION BY query_id, doc_id, zone ORDER BY round(share * qw * dw, 12) DESC, term) AS r FROM vec JOIN post USING (zone, term) JOIN shares USING (query_id, zone) JOIN (SELECT query_id, doc_id FROM ranked WHERE rank <= 5) USING (query_id, doc_id)) WHERE r <= 5 GROUP BY query_id, doc_id, zone""",
    ("vec", "post", "shares", "ranked"),
)
def r14_reasons(spark, sf):
    s = _Scored(spark, sf)
    top = rank.top_k(s.hybrid, 5).select("query_id", "doc_id")
    return score.reasons(score.contributions(s.vectors, s.ix.posts, s.ix.terms).join(top, ["query_id", "doc_id"], "left_semi"))


@query("SELECT query_id, zone, term, round_even(share * qw * dw, 6) AS contribution FROM vec JOIN post USING (zone, term) JOIN shares USING (query_id, zone) WHERE doc_id = 3", ("vec", "post", "shares"))
def r15_evidence(spark, sf):
    s = _Scored(spark, sf)
    one = spark.createDataFrame([(3,)], "doc_id long")
    return rounded(score.contributions(s.vectors, s.ix.posts, s.ix.terms, allowed=F.broadcast(one)).select("query_id", "zone", "term", "contribution"), "contribution")


@query("SELECT query_id, zone, doc_id, round_even(sum(qw * dw), 6) AS cosine FROM (SELECT vec.*, max(idf) OVER (PARTITION BY query_id, zone) AS most, idf FROM vec JOIN dict USING (zone, term)) JOIN post USING (zone, term) WHERE idf >= 0.5 * most GROUP BY ALL", ("vec", "dict", "post"))
def r02_idf_elimination(spark, sf):
    s = _Scored(spark, sf)
    return rounded(score.cosine(s.vectors, s.ix.posts, min_idf_ratio=0.5, terms=s.ix.terms), "cosine")


@query("SELECT query_id, zone, doc_id, round_even(sum(qw * dw), 6) AS cosine FROM vec JOIN (SELECT *, row_number() OVER (PARTITION BY zone, term ORDER BY round(dw, 12) DESC, doc_id) AS r FROM post) USING (zone, term) WHERE r <= 50 GROUP BY ALL", ("vec", "post"))
def r03_champion_read(spark, sf):
    s = _Scored(spark, sf)
    return rounded(score.cosine(s.vectors, s.ix.posts, champion=index.champions(s.ix.posts, 50)), "cosine")


FILTERS = {"company": ["brand#7", "Brand#12"], "workplace": ["Remote"], "country": []}


@query("SELECT id FROM listing WHERE lower(company) IN ('brand#7', 'brand#12') AND workplace = 'Remote'", ("listing",))
def f01_filters(spark, sf):
    return tables.listings(spark, sf).where(filters.predicate(FILTERS)).select("id")


@query("SELECT query_id, doc_id, round_even(score, 6) AS score FROM hyb JOIN listing ON id = doc_id WHERE lower(company) IN ('brand#7', 'brand#12') AND workplace = 'Remote'", ("hyb", "listing"))
def j04_filtered_search(spark, sf):
    s = _Scored(spark, sf)
    allowed = s.ix.listings.where(filters.predicate(FILTERS)).select(F.col("id").alias("doc_id"))
    found = score.hybrid(score.zone_cosine(s.vectors, s.flat, s.ix.posts, allowed=allowed), s.jaccards)
    return rounded(found.select("query_id", "doc_id", "score"), "score")


@query("SELECT id FROM listing WHERE role_family IN ('SMALL', 'LARGE') AND len(list_intersect(skills, ['nation_3', 'nation_7'])) = 2", ("listing",))
def f04_rule_all(spark, sf):
    return tables.listings(spark, sf).where(filters.rule({"role_family": ["SMALL", "LARGE"], "skills_all": ["nation_3", "Nation 7"]})).select("id")


@query("SELECT id FROM listing WHERE country IN ('NATION_1', 'NATION_2') AND len(list_intersect(skills, ['nation_3', 'nation_7'])) > 0", ("listing",))
def f04_rule_any(spark, sf):
    return tables.listings(spark, sf).where(filters.rule({"country": ["NATION_1", "NATION_2"], "skills_any": ["nation_3", "Nation 7"]})).select("id")


@query("SELECT id, title, company, nullif(location, '') AS location FROM listing WHERE id = 17", ("listing",))
def s12_point_lookup(spark, sf):
    return filters.payload(filters.lookup(tables.listings(spark, sf), 17)).select("id", "title", "company", "location")


@query()
def f11_resolve_company(spark, sf):
    exact, near = filters.resolve_company(tables.listings(spark, sf), "Brnd#1")
    return spark.createDataFrame([(exact, ",".join(near))], "company string, near string")


@query("SELECT query_id, doc_id, rank::INT AS rank, row_number() OVER (PARTITION BY query_id ORDER BY posted DESC NULLS LAST, rank)::INT AS position FROM ranked JOIN listing ON id = doc_id WHERE rank <= 10", ("ranked", "listing"))
def k05_resorted(spark, sf):
    s = _Scored(spark, sf)
    top = rank.top_k(s.hybrid, 10).join(s.ix.listings.select(F.col("id").alias("doc_id"), "posted", "company", "location"), "doc_id")
    return rank.resorted(top, "newest").select("query_id", "doc_id", "rank", "position")


@query("SELECT id, posted::VARCHAR AS posted FROM listing ORDER BY posted DESC NULLS LAST, id LIMIT 25", ("listing",))
def k06_browse(spark, sf):
    return rank.browse(tables.listings(spark, sf), 25).select("id", F.col("posted").cast("string").alias("posted"))


@query(
    """, m AS (SELECT a.doc_id AS query_id, b.doc_id, sum(0.5 * a.dw * b.dw) AS sim FROM post a JOIN post b USING (zone, term) WHERE a.doc_id IN (1, 2, 3) AND zone IN ('Title', 'Skills') AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, doc_id) AS r FROM m) WHERE r <= 30),
o AS (SELECT query_id, doc_id, sim, row_number() OVER (PARTITION BY query_id, x.title, x.company ORDER BY round(sim, 12) DESC, doc_id) AS u FROM p JOIN listing x ON x.id = doc_id JOIN listing y ON y.id = query_id WHERE NOT (x.title = y.title AND x.company = y.company))
SELECT query_id, doc_id, round_even(sim, 6) AS sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, doc_id) AS rank FROM o WHERE u = 1) WHERE rank <= 5""",
    ("post", "listing"),
)
def k07_similar(spark, sf):
    ix = catalog_index(spark, sf)
    ids = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    return rounded(rank.similar(F.broadcast(ids), ix.posts, ix.listings, 5), "sim")


@query("SELECT query_id, doc_id, rank::INT AS before FROM ranked WHERE rank <= 20", ("ranked",))
def k11_prerank(spark, sf):
    return rank.top_k(_Scored(spark, sf).hybrid, 20).select("query_id", "doc_id", F.col("rank").alias("before"))


@query("SELECT query_id, title, first_rank::INT AS first_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS r FROM (SELECT query_id, title, min(rank) AS first_rank FROM ranked JOIN listing ON id = doc_id WHERE rank <= 50 GROUP BY ALL)) WHERE r <= 6", ("ranked", "listing"))
def k12_example_titles(spark, sf):
    from ..operators import fit

    s = _Scored(spark, sf)
    return fit.example_titles(rank.top_k(s.hybrid, 50), s.ix.listings)


@query(
    """SELECT seed, query_id, doc_id, rank::INT AS rank FROM (SELECT seed, query_id, doc_id, row_number() OVER (PARTITION BY seed, query_id ORDER BY round(score, 12) DESC, ((doc_id % 1048576) * 2654435761 + seed * 40503) % 4294967296, doc_id) AS rank FROM hyb, (VALUES (0), (1), (2)) s(seed) WHERE score > 0) WHERE rank <= 10""",
    ("hyb",),
)
def k14_many_seeds(spark, sf):
    return rank.many_seeds(_Scored(spark, sf).hybrid, [0, 1, 2], 10).select("seed", "query_id", "doc_id", "rank")


@query()
def k03_diversified(spark, sf):
    s = _Scored(spark, sf)
    return rank.diversified(rank.top_k(s.hybrid, 40), index.term_sets(s.ix.zoned), 10)


@query()
def k04_mmr(spark, sf):
    s = _Scored(spark, sf)
    return rank.mmr(rank.top_k(s.hybrid, 40), index.term_sets(s.ix.zoned), 10, 0.7)


SETS = f"""WITH t AS (SELECT min(doc_id) AS doc_id, terms, list(doc_id) AS docs FROM (SELECT doc_id, list_sort(list_distinct({sql_terms('lower(text)')})) AS terms FROM documents) WHERE len(terms) > 0 GROUP BY terms),
s AS (SELECT doc_id, unnest(terms) AS term FROM t), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b, m / (len(x.terms) + len(y.terms) - m) AS jaccard FROM c JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE m / (len(x.terms) + len(y.terms) - m) >= 0.8)"""


def _term_sets(spark, sf):
    """The sets of documents alone, without the other tables of an index."""
    return once(spark, sf, "term sets", lambda: index.term_sets(index.flat_terms(tables.corpus(spark, sf), "doc_id", "body")))


@query(SETS + " SELECT a, b, round_even(jaccard, 6) AS jaccard FROM p")
def x10_near_pairs(spark, sf):
    """Pairs of different sets, each named by its smallest document; x10_kinds says which documents have it."""
    return rounded(dedup.near_pairs(_term_sets(spark, sf), 0.8), "jaccard")


@query(SETS + " SELECT unnest(docs) AS doc_id, doc_id AS kind FROM t")
def x10_kinds(spark, sf):
    return dedup.members(_term_sets(spark, sf))


@query("WITH RECURSIVE " + SETS.removeprefix("WITH ") + ", e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT doc_id AS k, doc_id AS g FROM t UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.g), l AS (SELECT k, min(g) AS g FROM r GROUP BY k), o AS (SELECT unnest(docs) AS doc_id, l.g AS group_id FROM t JOIN l ON k = t.doc_id) SELECT doc_id, group_id FROM o WHERE group_id IN (SELECT group_id FROM o GROUP BY ALL HAVING count(*) > 1)")
def x10_near_groups(spark, sf):
    sets = _term_sets(spark, sf)
    kinds = once(spark, sf, "kinds", lambda: dedup.members(sets))
    return dedup.groups(dedup.near_pairs(sets, 0.8, kinds), kinds)


@query("SELECT query_id, doc_id, round_even((0.85 * cosine + 0.35 * coalesce(jaccard, 0)) / 1.2, 6) AS score FROM fcos LEFT JOIN jac USING (query_id, doc_id)", ("fcos", "jac"))
def r12_tfidf_jaccard(spark, sf):
    return rounded(search.Search(catalog_index(spark, sf), batch(spark)).baseline_scores("tfidf_jaccard"), "score")


SCORED = """, bl AS (SELECT doc_id, sum(tf) AS len FROM tf WHERE zone = 'flat' GROUP BY doc_id), bm AS (SELECT sum(len) / (SELECT n FROM total) AS mean FROM bl),
sc AS (SELECT 'hybrid' AS system, query_id, doc_id, score FROM hyb UNION ALL SELECT 'keyword', query_id, doc_id, count(*) FROM flatq JOIN tf USING (zone, term) GROUP BY query_id, doc_id
  UNION ALL SELECT 'tfidf', query_id, doc_id, cosine FROM fcos UNION ALL SELECT 'tfidf_jaccard', query_id, doc_id, (0.85 * cosine + 0.35 * coalesce(jaccard, 0)) / 1.2 FROM fcos LEFT JOIN jac USING (query_id, doc_id)
  UNION ALL SELECT 'bm25', query_id, doc_id, sum(ln((total.n - df + 0.5) / (df + 0.5) + 1) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len / mean))) FROM flatq JOIN dict USING (zone, term) JOIN tf USING (zone, term) JOIN bl USING (doc_id), bm, total GROUP BY query_id, doc_id) """
SCORED_PARTS = ("hyb", "flatq", "tf", "fcos", "jac", "dict", "total")


@query(SCORED + "SELECT system, query_id, doc_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY system, query_id ORDER BY round(score, 12) DESC, ((doc_id % 1048576) * 2654435761 + 3 * 40503) % 4294967296, doc_id) AS rank FROM sc WHERE system = 'hybrid' OR score > 0) WHERE rank <= 10", SCORED_PARTS)
def c14_rank_ids(spark, sf):
    """The first ten of every system under one tie-break."""
    s = search.Search(catalog_index(spark, sf), batch(spark), Ranking(diversity=False))
    parts = [s.baseline(n, 10, 3).select(F.lit(n).alias("system"), "query_id", "doc_id", "rank") for n in SYSTEMS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT 'listings' AS name, count(*) AS value FROM listing UNION ALL SELECT 'vocabulary ' || zone, count(*) FROM dict GROUP BY zone UNION ALL SELECT 'filter company', count(DISTINCT company) FROM listing UNION ALL SELECT 'filter country', count(DISTINCT country) FROM listing UNION ALL SELECT 'filter workplace', count(DISTINCT workplace) FROM listing UNION ALL SELECT 'filter schedule', count(DISTINCT schedule) FROM listing UNION ALL SELECT 'filter role_family', count(DISTINCT role_family) FROM listing", ("listing", "dict"))
def c15_meta(spark, sf):
    return search.meta(catalog_index(spark, sf))


@query()
def c08_trace(spark, sf):
    """Each system's first five and the rankings before and after spreading, of one query."""
    s = search.Search(catalog_index(spark, sf), batch(spark, [(1, "small ring economy")]))
    parts = [df.select(F.lit(name).alias("step"), "doc_id", "rank") for name, df in s.trace(5).items() if {"doc_id", "rank"} <= set(df.columns)]
    return reduce(lambda a, b: a.unionByName(b), parts)
