"""Corpus statistics, facets, suggestions and joins."""

from pyspark.sql import functions as F

from ..functions.skills import covers
from ..operators import fit, stats
from ..sources import tables
from .registry import query


@query("SELECT count(*) AS rows, sum(listings)::BIGINT AS listings, count(DISTINCT company) AS companies, count(DISTINCT country) AS countries, count(*) FILTER (salary_year <> 0) AS with_salary, (SELECT count(DISTINCT key) FROM dskill) AS skills FROM listing", ("listing", "dskill"))
def a01_totals(spark, sf):
    return stats.totals(tables.listings(spark, sf))


FACET_SQL = " UNION ALL ".join(f"SELECT '{f}' AS facet, {f} AS value, count(*) AS n, {{{f}}} AS most FROM listing WHERE {f} <> '' GROUP BY {f}" for f in ("role_family", "workplace", "schedule", "country", "company"))


@query(f"SELECT facet, value, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM ({FACET_SQL.format(**stats.FACETS)})) WHERE rank <= most", ("listing",))
def a02_top_values(spark, sf):
    return stats.facet_counts(tables.listings(spark, sf), stats.FACETS)


@query(f"SELECT facet, value, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM ({FACET_SQL.format(**(stats.OPTIONS | {'company': 0}))})) WHERE rank <= most", ("listing",))
def a04_facets(spark, sf):
    return stats.facet_counts(tables.listings(spark, sf), stats.OPTIONS)


@query("SELECT key AS skill, 'Nation ' || split_part(key, ' ', 2) AS name, count(*) AS n FROM dskill GROUP BY key ORDER BY n DESC, key LIMIT 20", ("dskill",))
def a03_skill_counts(spark, sf):
    return stats.skill_counts(tables.listings(spark, sf))


@query("SELECT company, count(*) AS n FROM listing WHERE contains(lower(company), 'd#1') GROUP BY company ORDER BY NOT starts_with(lower(company), 'd#1'), n DESC, company LIMIT 8", ("listing",))
def f09_suggest_companies(spark, sf):
    return stats.suggest_companies(tables.listings(spark, sf), " D#1 ")


@query("SELECT DISTINCT key AS skill FROM dskill WHERE contains(key, 'n 1') ORDER BY NOT starts_with(key, 'n 1'), length(key), key LIMIT 8", ("dskill",))
def f10_suggest_skills(spark, sf):
    return stats.suggest_skills(tables.listings(spark, sf), "n 1")


@query("SELECT key FROM dskill WHERE doc_id IN (4, 5) GROUP BY key HAVING count(*) = 2", ("dskill",))
def j11_compare(spark, sf):
    return fit.compared(tables.listings(spark, sf), [4, 5])


@query("SELECT x AS mine, y AS wanted, z AS ok FROM (VALUES ('aws cloud infrastructure', 'aws', true), ('python', 'r', false), ('cloud architecture', 'aws', false), ('r', 'r', true), ('power bi desktop', 'power bi', true), ('c programming', 'c', false)) v(x, y, z)")
def f05_covers(spark, sf):
    rows = spark.createDataFrame([("aws cloud infrastructure", "aws"), ("python", "r"), ("cloud architecture", "aws"), ("r", "r"), ("power bi desktop", "power bi"), ("c programming", "c")], "mine string, wanted string")
    return rows.select("mine", "wanted", covers(F.col("mine"), F.col("wanted")).alias("ok"))


@query(
    """, e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 1800 AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, count(*) AS spans, sum(len)::BIGINT AS seconds FROM (SELECT user_id, island, max(e) - min(s) AS len FROM g GROUP BY ALL) GROUP BY user_id""",
    ("q",),
)
def k13_intervals(spark, sf):
    from ..operators.resume import merged_spans

    spans = tables.table(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), (F.unix_seconds(F.col("ts").cast("timestamp")) + 1800).alias("e"))
    return merged_spans(spans, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("spans"), F.sum(F.col("e") - F.col("s")).alias("seconds"))


@query("SELECT c_custkey, n_name, coalesce(n, 0) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def j10_left_default(spark, sf):
    orders = tables.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    who = tables.table(spark, sf, "customer").join(tables.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return who.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_name", F.coalesce("n", F.lit(0)).alias("orders"))
