"""Batch construction of the record table from raw postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import portable_hash, squeezed
from ..storage import Tables

#: Titles of the family that is kept whole.
FAMILY = r"(?i)cloud|devops|architect|infrastructure|\bsre\b|site reliability|platform engineer|sysadmin|system administrator|systems administrator|network"


def parsed_list(text: Column) -> Column:
    """A list literal as lower-cased distinct values in order; what is no list is empty."""
    values = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    out = F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(squeezed(v))), lambda v: v != ""))
    return F.coalesce(out, F.array().cast("array<string>"))


def drop_reason(title: Column, company: Column, skills: Column) -> Column:
    """The first requirement that a row fails, null if none."""
    return F.when(squeezed(title) == "", "no title").when(squeezed(company) == "", "no company").when(F.size(skills) == 0, "no skills")


def scrubbed(raw: DataFrame) -> DataFrame:
    """Raw postings with cleaned columns: prefix of the site removed, dates cut to the day, flags as booleans."""
    clean = {c: squeezed(F.col(c)) for c in ("job_title", "company_name", "job_location", "job_country", "job_schedule_type", "salary_rate")}
    return raw.select(
        clean["job_title"].alias("title"), clean["company_name"].alias("company"), clean["job_location"].alias("location"), clean["job_country"].alias("country"),
        F.when(F.col("job_work_from_home") == "True", "Remote").otherwise("Not remote").alias("workplace"), clean["job_schedule_type"].alias("schedule"), F.col("job_title_short").alias("role_family"),
        parsed_list(F.col("job_skills")).alias("skills"), F.substring("job_posted_date", 1, 10).alias("posted"), F.expr("try_cast(salary_year_avg as double)").alias("salary_year"), F.expr("try_cast(salary_hour_avg as double)").alias("salary_hour"),
        clean["salary_rate"].alias("salary_rate"), F.regexp_replace(squeezed(F.col("job_via")), "^via ", "").alias("via"), (F.col("job_no_degree_mention") == "True").alias("no_degree"), (F.col("job_health_insurance") == "True").alias("health_insurance"),
    )


def merged_reposts(rows: DataFrame, keys: list[str], order: Column | str, posted: str = "posted") -> DataFrame:
    """One row for each case-insensitive combination of ``keys``: the first row's values, the number of rows as
    ``listings`` and the latest date."""
    order = F.col(order) if isinstance(order, str) else order
    lower = [F.lower(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    grouped = rows.groupBy(*lower).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (posted, "listings")]), order).alias("_first"), F.count("*").alias("listings"), F.max(posted).alias(posted))
    return grouped.select("_first.*", "listings", posted)


def canonical_forms(rows: DataFrame, name: str, weight: str, order: str) -> DataFrame:
    """(_lower, form, n): of each name's spellings the one with the largest summed weight (ties: seen first)."""
    forms = rows.groupBy(F.lower(name).alias("_lower"), F.col(name).alias("form")).agg(F.sum(weight).alias("n"), F.min(order).alias("_seen"))
    return forms.groupBy("_lower").agg(F.min_by(F.struct("form", "n"), F.struct(-F.col("n"), "_seen")).alias("s")).select("_lower", "s.form", "s.n")


def stratified_sample(rows: DataFrame, family: Column, label: str, per_label: int, id_col: str, seed: int = 13) -> DataFrame:
    """All rows of the family and, of each label's others, the ``per_label`` with the smallest seeded hash."""
    rest = rows.where(~family).withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy(portable_hash(F.col(id_col), seed), id_col)))
    return rows.where(family).unionByName(rest.where(F.col("_r") <= per_label).drop("_r"))


def numbered(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """``rows`` with dense ids from 0 in the order of the lower-cased keys. Rows go to sorted ranges, which are written;
    each range counts its own, from where the ranges before it end. No task holds all rows."""
    tables = Tables(rows.sparkSession, "numbered")
    order = [*(F.lower(k) for k in keys), F.col(id_col)]
    ranged = tables.written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # one row for each range
    starts = counts.select(F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    out = ranged.withColumn("_own", own).join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    return out.select(*rows.columns, (F.col("_start") + F.col("_own") - 1).alias("position"))


def corpus_profile(rows: DataFrame) -> DataFrame:
    """One row of totals: records, listings, companies, countries, mean skills, remote share, salaries, dates, missing places."""
    return rows.agg(
        F.count("*").alias("rows"), F.sum("listings").alias("listings"), F.count_distinct("company").alias("companies"), F.count_distinct("country").alias("countries"),
        F.bround(F.avg(F.size("skills")), 2).alias("mean_skills"), F.bround(F.avg((F.col("workplace") == "Remote").cast("double")), 4).alias("remote_share"),
        F.count_if(F.col("salary_year").isNotNull()).alias("salaries"), F.min("posted").alias("first_posted"), F.max("posted").alias("last_posted"), F.count_if(F.col("location") == "").alias("no_location"),
    )


def role_labels(rows: DataFrame) -> DataFrame:
    """(role_family, n): the label histogram, the most frequent first."""
    return rows.groupBy("role_family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role_family")


def top_skills(rows: DataFrame, k: int = 15) -> DataFrame:
    """(skill, n, rank) of the k skills that most records list."""
    counts = rows.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "skill").limit(k)
    return first.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "skill")))  # k rows
