"""Whole operations over an index: search, browse, trace, evidence, explanation, comparison."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Ranking
from ..errors import QueryError
from ..operators import analyze, filters, fit, index, rank, score
from ..operators.index import Index

MOST_ROWS = 50


def limited(k: int, most: int = MOST_ROWS) -> int:
    if not 1 <= k <= most:
        raise QueryError(f"between 1 and {most} rows can be asked for")
    return k


@dataclass
class Search:
    """A batch of ``queries(query_id, query)`` over an index. Properties are the steps; each is a lazy table."""

    ix: Index
    queries: DataFrame
    cfg: Ranking = Ranking()
    filters: dict | None = None
    stemming: bool = False

    @cached_property
    def words(self) -> DataFrame:
        return analyze.query_words(self.queries, self.stemming)

    @cached_property
    def skills(self) -> DataFrame:
        return analyze.named_skills(self.words, self.ix.terms)

    @cached_property
    def routed(self) -> DataFrame:
        return analyze.routed(analyze.query_terms(self.words, self.cfg.use_biwords), self.skills, self.ix.terms, self.cfg)

    @cached_property
    def vectors(self) -> DataFrame:
        return analyze.query_vectors(self.routed, self.ix.terms)

    @cached_property
    def flat_words(self) -> DataFrame:
        return analyze.flat_query(self.words)

    @cached_property
    def allowed(self) -> DataFrame | None:
        if not any((self.filters or {}).values()):
            return None
        return self.ix.listings.where(filters.predicate(self.filters)).select(F.col("id").alias("doc_id"))

    @cached_property
    def scores(self) -> DataFrame:
        flat = analyze.query_vectors(self.flat_words, self.ix.terms)
        return score.hybrid(score.zone_cosine(self.vectors, flat, self.ix.posts, self.cfg, self.allowed), score.jaccard(self.flat_words, self.ix.tf), self.cfg)

    def ranked(self, k: int, seed: int | None = None) -> DataFrame:
        """The first k, near ties spread out if the settings ask for it."""
        if not self.cfg.diversity:
            return rank.top_k(self.scores, k, seed)
        pool = rank.top_k(self.scores, self.cfg.pool * k, seed)
        return rank.diversified(pool, index.term_sets(self.ix.zoned), k, self.cfg.epsilon)

    def baseline_scores(self, system: str) -> DataFrame:
        """(query_id, doc_id, score) of "keyword", "tfidf", "tfidf_jaccard" or "bm25"."""
        if system == "keyword":
            found = score.keyword(self.flat_words, self.ix.tf)
        elif system == "bm25":
            found = score.bm25(self.flat_words, self.ix.tf, self.ix.n)
        else:
            flat = analyze.query_vectors(self.flat_words, self.ix.terms)
            cosines = score.cosine(flat, self.ix.posts, self.allowed).select("query_id", "doc_id", "cosine")
            cfg = self.cfg if system == "tfidf_jaccard" else self.cfg.override(w_cosine=1.0, w_jaccard=0.0)
            found = score.hybrid(cosines, score.jaccard(self.flat_words, self.ix.tf), cfg)
        return found.select("query_id", "doc_id", "score")

    def baseline(self, system: str, k: int, seed: int | None = None) -> DataFrame:
        """Rankings of "hybrid", "keyword", "tfidf", "tfidf_jaccard" or "bm25"; baselines leave out scores of zero."""
        if system == "hybrid":
            return self.ranked(k, seed).select("query_id", "doc_id", "score", "rank")
        return rank.top_k(self.baseline_scores(system), k, seed, positive=True)

    def results(self, k: int = 10, sort: str = "best") -> DataFrame:
        """Ranked rows with their records and reasons; records are joined after the cut."""
        top = self.ranked(limited(k))
        parts = score.contributions(self.vectors, self.ix.posts, self.ix.terms, self.cfg).join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        flat = analyze.query_vectors(self.flat_words, self.ix.terms)
        flat = score.cosine(flat, self.ix.posts, top.select("doc_id").distinct()).select("query_id", "doc_id", F.col("cosine").alias("flat_cosine"))
        why = score.reasons(parts).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))  # five zones
        rows = top.join(filters.payload(self.ix.listings).withColumnRenamed("id", "doc_id"), "doc_id").join(why, ["query_id", "doc_id"], "left")
        rows = rows.join(flat, ["query_id", "doc_id"], "left").withColumn("flat_cosine", F.coalesce("flat_cosine", F.lit(0.0)))
        return rank.resorted(rows, sort)

    def summary(self) -> dict[str, DataFrame]:
        """What analysis makes of each query: words, named skills, fields of each word, terms, unknown words and what is close to them."""
        vocabulary = self.ix.terms.where("zone = 'Title' and not contains(term, '_')").select("term")
        unknown = analyze.unknown_words(self.words, self.ix.terms, self.skills)
        return {"words": self.words, "skills": self.skills, "routed": self.routed, "terms": analyze.term_table(self.vectors, self.ix.terms), "suggestions": analyze.close_words(unknown, vocabulary)}

    def trace(self, k: int = 5) -> dict[str, DataFrame]:
        """Every intermediate table of the search, and the first k of each system."""
        out = {"words": self.words, "skills": self.skills, "routed": self.routed, "vectors": self.vectors, "terms": analyze.term_table(self.vectors, self.ix.terms), "unknown": analyze.unknown_words(self.words, self.ix.terms, self.skills), "before": rank.top_k(self.scores, self.cfg.pool * k), "after": self.ranked(limited(k, 30))}
        out["stats"] = score.candidate_stats(self.scores, self.vectors, self.ix.posts, self.ix.n)
        return out | {f"top_{s}": self.baseline(s, k) for s in ("keyword", "tfidf", "tfidf_jaccard", "bm25")}


def search(ix: Index, query: str, k: int = 10, cfg: Ranking = Ranking(), wanted: dict | None = None, sort: str = "best", stemming: bool = False) -> DataFrame:
    """One query, checked; without words but with filters the newest records."""
    limited(k)
    query = analyze.checked(query, wanted)
    filters.check_values(ix.listings, wanted)
    if not query:
        return rank.browse(filters.payload(ix.listings).where(filters.predicate(wanted)), k)
    queries = ix.listings.sparkSession.createDataFrame([(1, query)], "query_id int, query string")
    return Search(ix, queries, cfg, wanted, stemming).results(k, sort)


def evidence_for(ix: Index, doc_id: int, query: str, stemming: bool = False) -> DataFrame:
    """The contributions of one record to one query; no rows if they share no term."""
    filters.lookup(ix.listings, doc_id)
    spark = ix.listings.sparkSession
    s = Search(ix, spark.createDataFrame([(1, query)], "query_id int, query string"), stemming=stemming)
    return score.contributions(s.vectors, ix.posts.where(F.col("doc_id") == doc_id), ix.terms)


def similar(ix: Index, doc_id: int, k: int = 5) -> DataFrame:
    filters.lookup(ix.listings, doc_id)
    ids = ix.listings.sparkSession.createDataFrame([(doc_id,)], "query_id long")
    return rank.similar(F.broadcast(ids), ix.posts, ix.listings, limited(k, 30))


def compare(ix: Index, ids: list[int]) -> DataFrame:
    """Skills that all of two to four records share."""
    for i in ids:
        filters.lookup(ix.listings, i)
    return fit.compared(ix.listings, ids)


def meta(ix: Index) -> DataFrame:
    """(name, value): the number of records, of terms in each zone, of skills, and of values in each filter."""
    one = lambda name, df: df.select(F.lit(name).alias("name"), F.col("value").cast("long").alias("value"))
    records = ix.listings.agg(F.count("*").alias("value"), *(F.count_distinct(F.nullif(c, F.lit(""))).alias(c) for c in filters.FIELDS))
    rows = records.select(F.explode(F.create_map(F.lit("listings"), "value", *(x for c in filters.FIELDS for x in (F.lit(f"filter {c}"), F.col(c))))).alias("name", "value"))
    zones = ix.terms.groupBy("zone").agg(F.count("*").alias("value")).select(F.concat(F.lit("vocabulary "), "zone").alias("name"), "value")
    return rows.unionByName(zones)
