"""Scores of (query, document) pairs. Queries are few and documents many: each score is one join of query terms
with postings and one aggregation, so only documents that share a term are ever touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Ranking


def cosine(vectors: DataFrame, posts: DataFrame, allowed: DataFrame | None = None, min_idf_ratio: float = 0.0, terms: DataFrame | None = None, champion: DataFrame | None = None) -> DataFrame:
    """(query_id, zone, doc_id, cosine). ``allowed(doc_id)`` restricts documents. ``min_idf_ratio`` leaves out query terms
    of small idf against the query's largest (all stay if none would). ``champion`` postings replace those of their terms."""
    if min_idf_ratio:
        with_idf = vectors.join(terms.select("zone", "term", "idf"), ["zone", "term"])
        most = F.max("idf").over(W.partitionBy("query_id", "zone"))
        vectors = with_idf.withColumn("most", most).where(F.col("idf") >= min_idf_ratio * F.col("most")).drop("idf", "most")
    if champion is not None:
        short = champion.select("zone", "term").distinct()
        posts = posts.join(short, ["zone", "term"], "left_anti").unionByName(champion.select(*posts.columns))
    if allowed is not None:
        posts = posts.join(allowed.select("doc_id"), "doc_id", "left_semi")
    met = posts.join(vectors.select("query_id", "zone", "term", "qw"), ["zone", "term"])
    return met.groupBy("query_id", "zone", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("cosine"))


def traversed(vectors: DataFrame, posts: DataFrame) -> DataFrame:
    """(query_id, postings): postings read, before any filter."""
    return posts.join(vectors.select("query_id", "zone", "term"), ["zone", "term"]).groupBy("query_id").agg(F.count("*").alias("postings"))


def zone_weights(vectors: DataFrame, cfg: Ranking) -> DataFrame:
    """(query_id, zone, share): weights of the active zones, summing to one."""
    table = vectors.sparkSession.createDataFrame([(z, float(w)) for z, w in cfg.zone_weights.items()], "zone string, alpha double")
    active = vectors.select("query_id", "zone").distinct().join(F.broadcast(table), "zone")  # five rows
    total = F.sum("alpha").over(W.partitionBy("query_id"))
    return active.withColumn("total", total).where("total > 0").select("query_id", "zone", (F.col("alpha") / F.col("total")).alias("share"))


def zone_cosine(vectors: DataFrame, flat: DataFrame, posts: DataFrame, cfg: Ranking = Ranking(), allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, cosine): the shares' sum over active zones; queries without an active zone fall back to the flat
    vector. Documents of a zone with weight zero stay candidates."""
    if not cfg.use_zones:
        return cosine(flat, posts, allowed).select("query_id", "doc_id", "cosine")
    shares = zone_weights(vectors, cfg)
    zoned = cosine(vectors, posts, allowed).join(shares, ["query_id", "zone"])
    zoned = zoned.groupBy("query_id", "doc_id").agg(F.sum(F.col("share") * F.col("cosine")).alias("cosine"))
    rest = flat.join(shares.select("query_id").distinct(), "query_id", "left_anti")
    return zoned.unionByName(cosine(rest, posts, allowed).select("query_id", "doc_id", "cosine"))


def query_sets(flat: DataFrame) -> DataFrame:
    """(query_id, term, q_size): distinct terms of each query, known or not."""
    return flat.select("query_id", "term").distinct().withColumn("q_size", F.count("*").over(W.partitionBy("query_id")))


def jaccard(flat: DataFrame, tf: DataFrame) -> DataFrame:
    """(query_id, doc_id, jaccard) of documents that share a term: common over all distinct flat terms."""
    docs = tf.where("zone = 'flat'")
    sizes = docs.groupBy("doc_id").agg(F.count("*").alias("d_size"))
    met = docs.join(query_sets(flat), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("m"), F.any_value("q_size").alias("q_size"))
    return met.join(sizes, "doc_id").select("query_id", "doc_id", (F.col("m") / (F.col("q_size") + F.col("d_size") - F.col("m"))).alias("jaccard"))


def hybrid(cosines: DataFrame, jaccards: DataFrame, cfg: Ranking = Ranking()) -> DataFrame:
    """(query_id, doc_id, cosine, jaccard, score): candidates are those of the cosine."""
    both = cosines.join(jaccards, ["query_id", "doc_id"], "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))
    score = (cfg.w_cosine * F.col("cosine") + cfg.w_jaccard * F.col("jaccard")) / (cfg.w_cosine + cfg.w_jaccard)
    return both.select("query_id", "doc_id", "cosine", "jaccard", score.alias("score"))


def keyword(flat: DataFrame, tf: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): number of the query's distinct terms in the document."""
    met = tf.where("zone = 'flat'").join(flat.select("query_id", "term").distinct(), "term")
    return met.groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))


def bm25(flat: DataFrame, tf: DataFrame, n: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score); a query term counts once however often it is asked; N and the mean length count empty documents."""
    docs = tf.where("zone = 'flat'")
    df = docs.groupBy("term").agg(F.count("*").alias("df"))
    length = docs.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    mean = length.agg((F.sum("len") / n).alias("mean"))
    q = flat.select("query_id", "term").distinct().join(df, "term").withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    met = docs.join(q, "term").join(length, "doc_id").crossJoin(F.broadcast(mean))  # one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return met.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def contributions(vectors: DataFrame, posts: DataFrame, terms: DataFrame, cfg: Ranking = Ranking(), allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, zone, term, contribution, tf, df, idf): the terms of the zone-weighted cosine, which they sum up to."""
    if allowed is not None:
        posts = posts.join(allowed.select("doc_id"), "doc_id", "left_semi")
    met = posts.join(vectors.select("query_id", "zone", "term", "qw"), ["zone", "term"]).join(zone_weights(vectors, cfg), ["query_id", "zone"])
    return met.join(terms, ["zone", "term"]).select("query_id", "doc_id", "zone", "term", (F.col("share") * F.col("qw") * F.col("dw")).alias("contribution"), "tf", "df", "idf")


def reasons(parts: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, doc_id, zone, reason): up to five terms of a zone, the largest contribution first."""
    w = W.partitionBy("query_id", "doc_id", "zone").orderBy(F.desc(F.round("contribution", 12)), "term")
    first = parts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: F.replace(x["term"], F.lit("_"), F.lit(" ")))
    return first.groupBy("query_id", "doc_id", "zone").agg(F.concat(F.any_value(F.col("zone")), F.lit(" matches: "), F.array_join(listed, ", ")).alias("reason"))


def candidate_stats(cosines: DataFrame, vectors: DataFrame, posts: DataFrame, n: int) -> DataFrame:
    """(query_id, candidates, never_scored, postings)."""
    c = cosines.groupBy("query_id").agg(F.count("*").alias("candidates"))
    return c.join(traversed(vectors, posts), "query_id").select("query_id", "candidates", (n - F.col("candidates")).alias("never_scored"), "postings")
