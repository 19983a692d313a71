"""Corpus statistics, facets and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.skills import canon, pretty

FACETS = {"role_family": 12, "workplace": 5, "schedule": 8, "country": 12, "company": 12}
OPTIONS = {"country": 60, "workplace": 20, "schedule": 20, "role_family": 20}


def totals(listings: DataFrame) -> DataFrame:
    """One row of counts; a salary of zero counts as missing."""
    skills = listings.select(F.explode("skills").alias("s")).agg(F.count_distinct(canon(F.col("s"))).alias("skills"))
    base = listings.agg(F.count("*").alias("rows"), F.sum("listings").alias("listings"), F.count_distinct("company").alias("companies"), F.count_distinct("country").alias("countries"), F.count_if(F.coalesce("salary_year", F.lit(0.0)) != 0).alias("with_salary"))
    return base.crossJoin(skills)  # one row each


def facet_counts(listings: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(facet, value, n, rank): the most frequent values of each facet (ties: by value), in one pass; empty values are skipped."""
    pairs = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"), F.lit(k).alias("most")) for f, k in sizes.items()))
    counts = listings.select(F.inline(pairs)).where("value <> ''").groupBy("facet", "value", "most").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value")))
    return ranked.where("rank <= most").select("facet", "value", "n", "rank")


def skill_counts(listings: DataFrame, k: int = 20) -> DataFrame:
    """(skill, name, n): records that name each skill."""
    each = listings.select(F.explode(F.array_distinct(F.transform("skills", canon))).alias("skill"))
    return each.groupBy("skill").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(k).select("skill", pretty(F.col("skill")).alias("name"), "n")


def suggest_companies(listings: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """(company, n) of companies that contain the text (two letters at least): those that begin with it first."""
    q = (text or "").strip().lower()
    low = F.lower("company")
    counts = listings.where(F.lit(len(q) >= 2) & F.contains(low, F.lit(q))).groupBy("company").agg(F.count("*").alias("n"))
    return counts.orderBy(~F.startswith(low, F.lit(q)), F.desc("n"), "company").limit(limit)


def suggest_skills(listings: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """(skill) of skills that contain the text: those that begin with it first, then shorter ones."""
    q = (text or "").strip().lower()
    names = listings.select(F.explode(F.transform("skills", canon)).alias("skill")).distinct().where(F.contains("skill", F.lit(q)))
    return names.orderBy(~F.startswith("skill", F.lit(q)), F.length("skill"), "skill").limit(limit)
