"""Query analysis for batches of queries: terms, named skills, routing to zones, vectors, unknown words."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Ranking
from ..errors import QueryError
from ..functions import text as T
from ..functions.skills import canon, skill_term

LONGEST_QUERY = 500
UNIGRAM_ZONES, PHRASE_ZONES = ("Title", "Company", "Location", "WorkType"), ("Title", "Company")


def checked(query: str | None, filters: dict | None = None) -> str:
    """The query, trimmed; too long, or empty without filters, is an error."""
    query = (query or "").strip()
    if len(query) > LONGEST_QUERY:
        raise QueryError(f"a query has at most {LONGEST_QUERY} characters")
    if not query and not any((filters or {}).values()):
        raise QueryError("an empty query needs a filter")
    return query


def query_words(queries: DataFrame, stemming: bool = False) -> DataFrame:
    """(query_id, words, stems): kept words of each query as one segment."""
    words = queries.select("query_id", T.terms(F.col("query"), query=True).alias("words"))
    return words.withColumn("stems", F.get(T.stemmed_segments(F.array("words")), 0) if stemming else F.col("words"))


def query_terms(words: DataFrame, use_biwords: bool = True) -> DataFrame:
    """(query_id, term, tf): unigrams and, if asked for, biwords."""
    every = F.concat("stems", T.biwords(F.col("stems"))) if use_biwords else F.col("stems")
    return words.select("query_id", F.explode(every).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))


def named_skills(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, key, term, df): words and neighbouring pairs whose canonical key is in the Skills index."""
    pairs = F.transform(T.biwords(F.col("words")), lambda b: F.replace(b, F.lit("_"), F.lit(" ")))
    keys = words.select("query_id", F.explode(F.array_distinct(F.transform(F.concat("words", pairs), canon))).alias("key")).withColumn("term", skill_term(F.col("key")))
    return keys.join(terms.where("zone = 'Skills'").select("term", "df"), "term").select("query_id", "key", "term", "df")


def routed(q_terms: DataFrame, skills: DataFrame, terms: DataFrame, cfg: Ranking = Ranking()) -> DataFrame:
    """(query_id, zone, term, tf, df, boost) of the zones in which each term counts.

    A term goes to the zones where its document frequency is at least tau times its largest one. Words of a named
    skill also compete with that skill's frequency, which itself goes to Skills unless its words are much more
    frequent in titles, companies or places.
    """
    word_skill = skills.select("query_id", "df", F.explode(T.terms(F.col("key"))).alias("term")).groupBy("query_id", "term").agg(F.max("df").alias("df"))
    fields = terms.where(F.col("zone").isin(*UNIGRAM_ZONES)).select("zone", "term", "df")
    met = q_terms.join(fields, "term").where(~F.contains("term", F.lit("_")) | F.col("zone").isin(*PHRASE_ZONES)).select("query_id", "term", "tf", "zone", "df")
    as_skill = q_terms.where(~F.contains("term", F.lit("_"))).join(word_skill, ["query_id", "term"]).select("query_id", "term", "tf", F.lit("Skills").alias("zone"), "df")
    every = met.unionByName(as_skill).withColumn("most", F.max("df").over(W.partitionBy("query_id", "term")))
    kept = every.where(F.col("df") >= cfg.tau * F.col("most")) if cfg.use_routing else every
    plain = kept.where("zone <> 'Skills'").select("query_id", "zone", "term", "tf", "df")
    others = skills.select("query_id", "key", F.explode(T.terms(F.col("key"))).alias("term")).join(terms.where(F.col("zone").isin("Title", "Company", "Location")).select("term", F.col("df").alias("odf")), "term")
    others = others.groupBy("query_id", "key").agg(F.max("odf").alias("others"))
    own = skills.join(others, ["query_id", "key"], "left").withColumn("others", F.coalesce("others", F.lit(0)))
    if cfg.use_routing:
        own = own.where((F.col("others") == 0) | (F.col("df") >= cfg.tau * F.greatest("others", F.lit(1))))
    return plain.unionByName(own.select("query_id", F.lit("Skills").alias("zone"), "term", F.lit(1).cast("long").alias("tf"), "df")).withColumn("boost", F.lit(1.0))


def query_vectors(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, zone, term, tf, qw) of ``wanted(query_id, zone, term, tf, boost)``: unknown terms are left out, the norm
    is that of the weights without boosts, and a zone of zero norm is not active."""
    w = wanted.drop("df").join(terms.select("zone", "term", "idf"), ["zone", "term"]).withColumn("plain", (1 + F.log10("tf")) * F.col("idf"))
    w = w.withColumn("norm", F.sqrt(F.sum(F.col("plain") * F.col("plain")).over(W.partitionBy("query_id", "zone"))))
    return w.where("norm > 0").select("query_id", "zone", "term", "tf", (F.col("plain") * F.col("boost") / F.col("norm")).alias("qw"))


def flat_query(words: DataFrame) -> DataFrame:
    """(query_id, zone, term, tf, boost) of the flat bag: unigrams only."""
    return query_terms(words, use_biwords=False).select("query_id", F.lit("flat").alias("zone"), "term", "tf", F.lit(1.0).alias("boost"))


def unknown_words(words: DataFrame, terms: DataFrame, skills: DataFrame) -> DataFrame:
    """(query_id, word) of kept words that are neither in the flat vocabulary nor part of a named skill."""
    each = words.select("query_id", F.explode(F.arrays_zip("words", "stems")).alias("z")).select("query_id", F.col("z.words").alias("word"), F.col("z.stems").alias("term"))
    parts = skills.select("query_id", F.explode(T.terms(F.col("key"))).alias("term"))
    return each.join(terms.where("zone = 'flat'").select("term"), "term", "left_anti").join(parts, ["query_id", "term"], "left_anti").select("query_id", "word").distinct()


def close_words(unknown: DataFrame, vocabulary: list[str] | DataFrame, n: int = 3, cutoff: float = 0.75) -> DataFrame:
    """``unknown(…, word)`` with its closest vocabulary words (Ratcliff-Obershelp). The vocabulary is that of titles:
    a list, or ``(term)`` of any size, which is scored where it lies."""
    if isinstance(vocabulary, list):
        vocabulary = unknown.sparkSession.createDataFrame([(v,) for v in vocabulary], "term string")
    close = closest(unknown.select("word").distinct(), vocabulary.select("term"), n, cutoff)
    return unknown.join(close, "word", "left").withColumn("suggestions", F.coalesce("suggestions", F.expr("cast(array() as array<string>)"))).select(*unknown.columns, "suggestions")


def closest(words: DataFrame, names: DataFrame, n: int, cutoff: float) -> DataFrame:
    """(word, suggestions): the n closest of all ``names(term)`` to each of few ``words(word)``, as difflib.get_close_matches
    picks them (equal ratios: the later name first). Words are broadcast; names are scored in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(word: pd.Series, term: pd.Series) -> pd.Series:
        out, of = [], {}
        for w, t in zip(word, term, strict=True):
            if w not in of:
                of[w] = difflib.SequenceMatcher()
                of[w].set_seq2(w)
            m = of[w]
            m.set_seq1(t)
            out.append(m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0)
        return pd.Series(out, dtype="float64")

    # the ratio is at most twice the shorter length over both, so other lengths cannot reach the cutoff
    a, b = F.length("word"), F.length("term")
    pairs = names.distinct().join(F.broadcast(words), 2 * F.least(a, b) >= cutoff * (a + b) - 1e-9)
    near = pairs.withColumn("ratio", ratio("word", "term")).where(F.col("ratio") >= cutoff)
    top = near.withColumn("r", F.row_number().over(W.partitionBy("word").orderBy(F.desc("ratio"), F.desc("term")))).where(F.col("r") <= n)
    return top.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("suggestions"))


def term_table(vectors: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, zone, term, tf, df, idf) as displayed: idf to four places."""
    return vectors.join(terms, ["zone", "term"]).select("query_id", "zone", "term", "tf", "df", F.bround("idf", 4).alias("idf"))
