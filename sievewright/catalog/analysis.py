"""Index and query-analysis queries."""

from pyspark.sql import functions as F

from ..operators import analyze, index
from ..sources import tables
from .registry import WORDS, batch, catalog_index, query, rounded, sql_terms, text_index

TEXT_TF = f"WITH t AS (SELECT doc_id, unnest({sql_terms('lower(text)')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df, log10((SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY term) "


@query("SELECT zone, count(*) AS postings, count(DISTINCT term) AS vocabulary, sum(tf)::BIGINT AS words FROM tf GROUP BY zone", ("tf",))
def i07_vocabulary(spark, sf):
    tf = index.term_frequencies(index.zone_terms(tables.listings(spark, sf)))
    return tf.groupBy("zone").agg(F.count("*").alias("postings"), F.count_distinct("term").alias("vocabulary"), F.sum("tf").alias("words"))


@query("SELECT zone, doc_id, term, tf FROM tf", ("tf",))
def i02_zone_tf(spark, sf):
    return index.term_frequencies(index.zone_terms(tables.listings(spark, sf)))


@query("SELECT zone, term, df, round_even(idf, 6) AS idf FROM dict", ("dict",))
def i03_df_idf(spark, sf):
    return rounded(catalog_index(spark, sf).terms, "idf")


@query(TEXT_TF + "SELECT term, df, round_even(idf, 6) AS idf FROM d")
def i03_text_idf(spark, sf):
    return rounded(text_index(spark, sf).terms.select("term", "df", "idf"), "idf")


@query("SELECT zone, doc_id, sum(tf)::BIGINT AS doc_len FROM tf GROUP BY ALL", ("tf",))
def i04_doc_lengths(spark, sf):
    return index.lengths(index.term_frequencies(index.zone_terms(tables.listings(spark, sf))))


@query("SELECT zone, term, doc_id, tf, round_even(dw, 6) AS dw FROM post", ("post",))
def i05_ltc_weights(spark, sf):
    return rounded(catalog_index(spark, sf).posts, "dw")


@query(TEXT_TF + ", w AS (SELECT doc_id, term, (1 + log10(tf)) * idf AS w FROM tf JOIN d USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY doc_id) SELECT term, count(*) AS postings, round_even(sum(w / n), 4) AS weight FROM w JOIN n USING (doc_id) WHERE n > 0 GROUP BY term")
def i06_text_postings(spark, sf):
    return text_index(spark, sf).posts.groupBy("term").agg(F.count("*").alias("postings"), F.bround(F.sum("dw"), 4).alias("weight"))


@query("SELECT zone, term, doc_id, round_even(dw, 6) AS dw FROM (SELECT *, row_number() OVER (PARTITION BY zone, term ORDER BY round(dw, 12) DESC, doc_id) AS r, count(*) OVER (PARTITION BY zone, term) AS n FROM post) WHERE n > 50 AND r <= 50", ("post",))
def i11_champions(spark, sf):
    return rounded(index.champions(catalog_index(spark, sf).posts, 50).select("zone", "term", "doc_id", "dw"), "dw")


@query("SELECT surface AS term, surface FROM (SELECT DISTINCT unnest(t || c || list_filter(l, lambda x: x <> 'unknown')) AS surface FROM bag)", ("bag",))
def i08_display_forms(spark, sf):
    return index.surfaces(tables.listings(spark, sf), stemming=False)


def _analysis(spark, sf):
    ix = catalog_index(spark, sf)
    words = analyze.query_words(batch(spark))
    skills = analyze.named_skills(words, ix.terms)
    return ix, words, skills, analyze.routed(analyze.query_terms(words), skills, ix.terms)


@query("SELECT query_id, key, term, df FROM named", ("named",))
def q02_named_skills(spark, sf):
    return _analysis(spark, sf)[2]


@query("SELECT query_id, zone, term, tf, df FROM route", ("route",))
def q03_routing(spark, sf):
    return _analysis(spark, sf)[3].select("query_id", "zone", "term", "tf", "df")


@query("SELECT query_id, zone, term, round_even(qw, 6) AS qw FROM vec", ("vec",))
def q05_query_vectors(spark, sf):
    ix, _, _, route = _analysis(spark, sf)
    return rounded(analyze.query_vectors(route, ix.terms).select("query_id", "zone", "term", "qw"), "qw")


@query("SELECT query_id, zone FROM (SELECT DISTINCT query_id, zone FROM vec)", ("vec",))
def q06_active_zones(spark, sf):
    ix, _, _, route = _analysis(spark, sf)
    return analyze.query_vectors(route, ix.terms).select("query_id", "zone").distinct()


@query("SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest(words) AS word FROM qw) WHERE word NOT IN (SELECT term FROM dict WHERE zone = 'flat') AND (query_id, word) NOT IN (SELECT (query_id, term) FROM named_words)", ("qw", "dict", "named_words"))
def q07_unknown_words(spark, sf):
    ix, words, skills, _ = _analysis(spark, sf)
    return analyze.unknown_words(words, ix.terms, skills)


@query("SELECT query_id, v.zone, v.term, v.tf, df, round_even(idf, 4) AS idf FROM vec v JOIN dict USING (zone, term)", ("vec", "dict"))
def q09_term_table(spark, sf):
    ix, _, _, route = _analysis(spark, sf)
    return analyze.term_table(analyze.query_vectors(route, ix.terms), ix.terms)


@query()
def q08_suggestions(spark, sf):
    ix, words, skills, _ = _analysis(spark, sf)
    vocabulary = ix.terms.where("zone = 'Title' and not contains(term, '_')").select("term")
    return analyze.close_words(analyze.unknown_words(words, ix.terms, skills), vocabulary).withColumn("suggestions", F.array_join("suggestions", ","))


@query()
def t08_stemmed_routing(spark, sf):
    ix = index.Index.build(tables.listings(spark, sf), stemming=True)
    words = analyze.query_words(batch(spark), stemming=True)
    skills = analyze.named_skills(words, ix.terms)
    return analyze.routed(analyze.query_terms(words), skills, ix.terms)


@query(TEXT_TF + ", q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in WORDS) + f") v(query_id, query)), qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({sql_terms('query', True)}) AS term FROM q) GROUP BY ALL) SELECT query_id, term, qt.tf, df FROM qt JOIN d USING (term)")
def j02_query_dictionary(spark, sf):
    terms = text_index(spark, sf).terms.select("term", "df")
    return analyze.query_terms(analyze.query_words(batch(spark, WORDS)), use_biwords=False).join(terms, "term").select("query_id", "term", "tf", "df")
