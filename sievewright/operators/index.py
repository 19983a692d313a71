"""Field-level inverted indexes as tables: terms, postings, document sets, display forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..sources.files import fingerprint
from ..functions.skills import canon, skill_term


VERSION = "2"  # of the layout of saved indexes


def zone_terms(listings: DataFrame, stemming: bool = False) -> DataFrame:
    """(zone, doc_id, terms) of the five zones and the flat bag; one pass over the records."""
    seg = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: T.terms(x))
    key = F.array_distinct(F.transform("skills", canon))
    texts = {"title": F.col("title"), "company": F.col("company"), "location": T.location_text(F.col("location"), F.col("country")), "worktype": T.worktype_text(F.col("schedule"), F.col("workplace")), "skill_words": F.array_join(key, ", ")}
    base = listings.select(F.col("id").alias("doc_id"), F.transform(key, skill_term).alias("skills"), *(seg(c).alias(k) for k, c in texts.items()))
    if stemming:
        base = base.select("doc_id", "skills", *(T.stemmed_segments(F.col(k)).alias(k) for k in texts))
    pairs = lambda k: F.concat(F.flatten(k), F.flatten(F.transform(k, T.biwords)))  # noqa: E731  never across a comma
    base = base.select("doc_id", "skills", pairs("title").alias("title_all"), pairs("company").alias("company_all"), *(F.flatten(k).alias(k) for k in texts))
    title, company = F.col("title_all"), F.col("company_all")
    zones = {"Title": title, "Skills": F.col("skills"), "Location": F.col("location"), "Company": company, "WorkType": F.col("worktype"), "flat": F.concat("title", "skill_words", "company", "location", "worktype")}
    rows = F.array(*(F.struct(F.lit(z).alias("zone"), c.alias("terms")) for z, c in zones.items()))
    return base.select("doc_id", F.inline(rows)).select("zone", "doc_id", "terms")


def flat_terms(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(zone, doc_id, terms) of one flat zone: lower-cased ASCII words of at least two letters that are no stop words."""
    return docs.select(F.lit("flat").alias("zone"), F.col(id_col).alias("doc_id"), T.terms(F.lower(text)).alias("terms"))


def term_frequencies(zoned: DataFrame) -> DataFrame:
    """(zone, doc_id, term, tf)."""
    return zoned.select("zone", "doc_id", F.explode("terms").alias("term")).groupBy("zone", "doc_id", "term").agg(F.count("*").alias("tf"))


def dictionary(tf: DataFrame, n: int | Column) -> DataFrame:
    """(zone, term, df, idf): idf = log10(N / df), N counts all documents, also those without terms."""
    n = F.lit(n) if isinstance(n, int) else n
    return tf.groupBy("zone", "term").agg(F.count("*").alias("df")).withColumn("idf", F.log10(n / F.col("df")))


def postings(tf: DataFrame, terms: DataFrame) -> DataFrame:
    """(zone, term, doc_id, tf, dw): unit-length weights (1 + log10 tf) idf; a document of zero length has none.

    Terms meet the dictionary once; the terms of a document are then gathered and divided by their norm together."""
    weighted = tf.join(terms, ["zone", "term"]).select("zone", "doc_id", F.struct("term", "tf", ((1 + F.log10("tf")) * F.col("idf")).alias("w")).alias("t"))
    bags = weighted.groupBy("zone", "doc_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))  # the terms of one text
    norm = F.sqrt(F.aggregate("ts", F.lit(0.0), lambda a, t: a + t["w"] * t["w"]))
    each = bags.withColumn("norm", norm).where("norm > 0").select("zone", "doc_id", "norm", F.inline("ts"))
    return each.select("zone", "term", "doc_id", "tf", (F.col("w") / F.col("norm")).alias("dw"))


def lengths(tf: DataFrame) -> DataFrame:
    """(zone, doc_id, doc_len)."""
    return tf.groupBy("zone", "doc_id").agg(F.sum("tf").alias("doc_len"))


def term_sets(zoned: DataFrame) -> DataFrame:
    """(doc_id, terms): distinct flat terms."""
    return zoned.where("zone = 'flat'").select("doc_id", F.array_distinct("terms").alias("terms"))


def champions(posts: DataFrame, r: int) -> DataFrame:
    """For each term with more than r postings its r heaviest (ties: smaller id)."""
    w = W.partitionBy("zone", "term").orderBy(F.desc(F.round("dw", 12)), "doc_id")
    size = posts.groupBy("zone", "term").agg(F.count("*").alias("n")).where(F.col("n") > r).select("zone", "term")
    return posts.join(size, ["zone", "term"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= r).drop("r")


def surfaces(listings: DataFrame, stemming: bool = True) -> DataFrame:
    """(term, surface): the most frequent written form of each stem of title, company and place (ties: alphabetical)."""
    words = listings.select(F.explode(F.concat(*(T.segment_terms(F.col(c), False) for c in ("title", "company", "location")))).alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))
    words = words.withColumn("term", T.stemmed(F.col("surface")) if stemming else F.col("surface"))
    return words.groupBy("term").agg(F.min_by("surface", F.struct(-F.col("n"), "surface")).alias("surface"))


@dataclass
class Index:
    """Tables that searches read. ``n`` is the number of records, also those without terms."""

    listings: DataFrame
    zoned: DataFrame
    tf: DataFrame
    terms: DataFrame
    posts: DataFrame
    n: int

    @classmethod
    def build(cls, listings: DataFrame, zoned: DataFrame | None = None, stemming: bool = False) -> Index:
        zoned = zone_terms(listings, stemming) if zoned is None else zoned
        n = listings.count()
        tf = term_frequencies(zoned)
        terms = dictionary(tf, n)
        return cls(listings, zoned, tf, terms, postings(tf, terms), n)

    def save(self, path: str, key: str = "") -> None:
        """Tables under ``path``; see ``written``."""
        zoned = self.zoned.select("zone", "doc_id", "terms")
        Index.written(self.listings, path, lambda _: zoned, key)

    @classmethod
    def written(cls, listings: DataFrame, path: str, zoned: Callable[[DataFrame], DataFrame] = zone_terms, key: str = "") -> Index:
        """An index whose tables lie under ``path``, each made from those written before it: records, zone terms, term
        frequencies, terms, postings. Postings are partitioned by zone and sorted by term, so that a search for a few
        terms skips row groups. The manifest, with the ``key`` of what was indexed, comes last: without it there is no index."""
        spark = listings.sparkSession
        put = lambda df, name, *by: df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")
        got = lambda name: spark.read.parquet(f"{path}/{name}")
        sorted_ = lambda df: df.repartitionByRange("zone", "term").sortWithinPartitions("zone", "term")
        put(listings, "listings")
        n = got("listings").count()
        put(zoned(got("listings")), "zoned", "zone")
        put(term_frequencies(got("zoned").select("zone", "doc_id", "terms")), "tf", "zone")
        put(sorted_(dictionary(got("tf"), n)), "terms", "zone")
        put(sorted_(postings(got("tf"), got("terms"))), "postings", "zone")
        put(spark.createDataFrame([(n, key)], "n long, key string"), "manifest")
        return cls.load(spark, path, key)

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str | None = None) -> Index:
        """The saved index; with a ``key``, only if it was saved under that key."""
        manifest = spark.read.parquet(f"{path}/manifest").first()
        if key is not None and manifest.key != key:
            raise ValueError(f"the index at {path} is of other data")
        zoned, posts = spark.read.parquet(f"{path}/zoned"), spark.read.parquet(f"{path}/postings")
        return cls(spark.read.parquet(f"{path}/listings"), zoned, spark.read.parquet(f"{path}/tf"), spark.read.parquet(f"{path}/terms"), posts, manifest.n)

    @classmethod
    def load_or_build(cls, listings: DataFrame, path: str, stemming: bool = False, source: str | None = None) -> Index:
        """The saved index if it was made of the same files, else a new one. ``source`` is the folder that ``listings`` were
        read from: names, sizes and times of its files, and the settings, are the index's key."""
        spark = listings.sparkSession
        key = fingerprint(spark, source, f"{VERSION} stemming={stemming}") if source else f"{VERSION} stemming={stemming}"
        try:
            return cls.load(spark, path, key)
        except (AnalysisException, AttributeError, ValueError):  # none there, not one of ours, or of other data
            return cls.written(listings, path, lambda rows: zone_terms(rows, stemming), key)
