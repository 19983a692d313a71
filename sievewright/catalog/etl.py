"""Batch construction queries over the star schema."""

from pyspark.sql import functions as F

from ..operators import etl
from ..sources import files, tables
from ..storage import Tables
from .registry import query, rounded


@query("SELECT x AS raw, y AS parsed FROM (VALUES ('[''SQL'', ''sql'', '' Power  BI '']', 'sql|power bi'), ('[]', ''), ('oops', ''), ('[''a'']', 'a')) v(x, y)")
def e02_parse_list(spark, sf):
    raw = spark.createDataFrame([("['SQL', 'sql', ' Power  BI ']",), ("[]",), ("oops",), ("['a']",)], "raw string")
    return raw.select("raw", F.array_join(etl.parsed_list(F.col("raw")), "|").alias("parsed"))


@query("SELECT CASE WHEN p_size % 7 = 0 THEN 'no title' WHEN p_size % 5 = 0 THEN 'no company' WHEN len(skills) = 0 THEN 'no skills' ELSE 'kept' END AS reason, count(*) AS n FROM listing JOIN part ON p_partkey = id GROUP BY ALL", ("listing",))
def e03_drop_reasons(spark, sf):
    rows = tables.listings(spark, sf).join(tables.table(spark, sf, "part").select("p_partkey", "p_size"), F.col("id") == F.col("p_partkey"))
    rows = rows.withColumn("title", F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("title"))).withColumn("company", F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("company")))
    reason = F.coalesce(etl.drop_reason(F.col("title"), F.col("company"), F.col("skills")), F.lit("kept"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT arg_min(id, id) AS id, arg_min(title, id) AS title, arg_min(company, id) AS company, count(*) AS listings, max(posted)::VARCHAR AS posted FROM listing GROUP BY lower(title), lower(company), lower(role_family)", ("listing",))
def e04_repost_merge(spark, sf):
    rows = tables.listings(spark, sf).select("id", "title", "company", "role_family", "posted", "listings")
    return etl.merged_reposts(rows, ["title", "company", "role_family"], "id").select("id", "title", "company", "listings", F.col("posted").cast("string").alias("posted"))


@query(
    """SELECT low AS company_key, form, n FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY n DESC, seen) AS r FROM (
  SELECT lower(company) AS low, CASE WHEN id % 3 = 0 THEN upper(company) ELSE company END AS form, sum(listings)::BIGINT AS n, min(id) AS seen FROM listing GROUP BY ALL)) WHERE r = 1""",
    ("listing",),
)
def e05_canonical_form(spark, sf):
    rows = tables.listings(spark, sf).withColumn("company", F.when(F.col("id") % 3 == 0, F.upper("company")).otherwise(F.col("company")))
    return etl.canonical_forms(rows, "company", "listings", "id").withColumnRenamed("_lower", "company_key")


@query("SELECT id FROM listing WHERE regexp_matches(title, 'widget|gear') UNION ALL SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY role_family ORDER BY ((id % 1048576) * 2654435761 + 13 * 40503) % 4294967296, id) AS r FROM listing WHERE NOT regexp_matches(title, 'widget|gear')) WHERE r <= 40", ("listing",))
def e07_stratified_sample(spark, sf):
    return etl.stratified_sample(tables.listings(spark, sf), F.col("title").rlike("(?i)widget|gear"), "role_family", 40, "id").select("id")


@query("SELECT id, row_number() OVER (ORDER BY lower(title), lower(company), lower(location), id) - 1 AS position FROM listing", ("listing",))
def e09_numbered(spark, sf):
    return etl.numbered(tables.listings(spark, sf).select("id", "title", "company", "location"), ["title", "company", "location"], "id").select("id", "position")


@query(
    """SELECT count(*) AS rows, sum(listings)::BIGINT AS listings, count(DISTINCT company) AS companies, count(DISTINCT country) AS countries, round_even(avg(len(skills)), 2) AS mean_skills,
  round_even(avg((workplace = 'Remote')::INT), 4) AS remote_share, count(salary_year) AS salaries, min(posted)::VARCHAR AS first_posted, max(posted)::VARCHAR AS last_posted, count(*) FILTER (location = '') AS no_location FROM listing""",
    ("listing",),
)
def e10_corpus_profile(spark, sf):
    out = etl.corpus_profile(tables.listings(spark, sf))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_posted", "last_posted")})


@query("SELECT id, location, country, workplace, schedule, array_to_string(skills, '|') AS skills, posted::VARCHAR AS posted, salary_year, listings FROM listing", ("listing",))
def s02_listings(spark, sf):
    return tables.listings(spark, sf).select("id", "location", "country", "workplace", "schedule", F.concat_ws("|", "skills").alias("skills"), F.col("posted").cast("string").alias("posted"), "salary_year", "listings")


@query("SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'Unknown' ELSE p_type END AS country, CASE WHEN p_size % 3 = 0 THEN 'Remote' ELSE 'Not remote' END AS workplace, 'Not stated' AS schedule, p_retailprice AS salary_year, 1 AS listings, p_size % 2 = 0 AS no_degree FROM part")
def s02_coercion(spark, sf):
    raw = tables.table(spark, sf, "part").selectExpr(
        "cast(p_partkey as string) job_id", "p_name title", "p_brand company", "'' location", "case when p_size % 2 = 0 then '' else p_type end country", "case when p_size % 3 = 0 then 'Remote' else 'x' end workplace", "'' schedule", "null role_family", "'a||b' skills", "'2020-01-02' posted",
        "cast(p_retailprice as string) salary_year_avg", "'n/a' salary_hour_avg", "'' salary_rate", "null via", "'' listings", "case when p_size % 2 = 0 then 'True' else 'no' end no_degree", "null health_insurance",
    )
    return files.coerced(raw).select("id", "title", "country", "workplace", "schedule", "salary_year", "listings", "no_degree")


SPACE_CLASS = "[" + "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+"


@query(f"SELECT trim(regexp_replace(coalesce(text, ''), '{SPACE_CLASS}', ' ', 'g')) AS text, count(*) AS n FROM conversations GROUP BY ALL")
def e01_squeezed(spark, sf):
    from ..functions.text import squeezed

    return tables.table(spark, sf, "conversations").groupBy(squeezed(F.col("text")).alias("text")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, round_even(sum(o_totalprice), 6) AS total FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY ALL")
def f00_pushed_scan(spark, sf):
    orders = tables.table(spark, sf, "orders").where("o_orderdate >= date'1996-01-01' and o_orderdate < date'1997-01-01'")
    return rounded(orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "total")


@query("SELECT role_family, count(*) AS n FROM listing GROUP BY ALL", ("listing",))
def e10_role_labels(spark, sf):
    return etl.role_labels(tables.listings(spark, sf))


@query("SELECT skill, n, rank::INT AS rank FROM (SELECT skill, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, skill) AS rank FROM (SELECT unnest(skills) AS skill FROM listing) GROUP BY skill) WHERE rank <= 15", ("listing",))
def e10_top_skills(spark, sf):
    return etl.top_skills(tables.listings(spark, sf))


@query(
    """SELECT p_name AS title, p_brand AS company, p_type AS role_family, CASE WHEN p_size % 2 = 0 THEN 'Remote' ELSE 'Not remote' END AS workplace, 'sql|power bi' AS skills, '2023-0' || (1 + p_size % 9) || '-07' AS posted,
  CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS salary_year, p_brand AS via, p_size % 5 = 0 AS no_degree FROM part"""
)
def e11_scrubbed(spark, sf):
    part = tables.table(spark, sf, "part")
    raw = part.selectExpr(
        "p_type job_title_short", "concat('  ', replace(p_name, ' ', '  '), '\t') job_title", "'' job_location", "concat('via ', p_brand) job_via", "'Full-time' job_schedule_type", "if(p_size % 2 = 0, 'True', 'False') job_work_from_home",
        "concat('2023-0', cast(1 + p_size % 9 as string), '-07 12:30:00') job_posted_date", "if(p_size % 5 = 0, 'True', 'False') job_no_degree_mention", "'False' job_health_insurance", "'X' job_country", "'year' salary_rate",
        "if(p_size % 3 = 0, cast(p_retailprice as string), 'n/a') salary_year_avg", "null salary_hour_avg", "concat(p_brand, ' ') company_name", "\"['SQL', 'sql', ' Power  BI ']\" job_skills",
    )
    return etl.scrubbed(raw).select("title", "company", "role_family", "workplace", F.array_join("skills", "|").alias("skills"), "posted", "salary_year", "via", "no_degree")


@query(
    "SELECT id, title, company, location, country, workplace, schedule, role_family, array_to_string(skills, '|') AS skills, posted::VARCHAR AS posted, salary_year, listings FROM listing",
    ("listing",),
)
def s07_listing_file(spark, sf):
    """Records written as CSV and read again."""
    rows = tables.listings(spark, sf)
    none = F.lit(None).cast("string")
    path = f"{Tables(spark, 'listings').root}/listings.csv"
    files.write_listings(rows.select(
        F.col("id").alias("job_id"), "title", "company", "location", "country", "workplace", "schedule", "role_family", "skills", "posted", F.col("salary_year").alias("salary_year_avg"),
        none.alias("salary_hour_avg"), none.alias("salary_rate"), none.alias("via"), "listings", none.alias("no_degree"), none.alias("health_insurance"),
    ), path)
    out = files.read_listings(spark, path)
    return out.select("id", "title", "company", "location", "country", "workplace", "schedule", "role_family", F.array_join("skills", "|").alias("skills"), F.col("posted").cast("string").alias("posted"), "salary_year", "listings")
