"""The engine's record shape, read from the star schema and from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per part: title, company and label from the part, skills and place from its line items' suppliers.

    One aggregation of line items by part; suppliers and nations are small dimensions that the optimizer may
    broadcast by their size. Parts without line items have no skills and no place. The place is that of the earliest
    line; of lines with one order and line number, of the one that comes first in the table.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_shipdate", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    items = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    earliest = F.when(line.isNotNull() & F.col("n_name").isNotNull(), F.struct(line, "_file", "_row"))
    per_part = items.groupBy("l_partkey").agg(
        F.array_sort(F.collect_set(F.when(F.col("l_discount") >= 0.09, F.lower("n_name")))).alias("skills"),
        F.min_by("n_name", earliest).alias("location"),
        F.to_date(F.max("l_shipdate")).alias("posted"),
        F.count("*").alias("listings"),
    )
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    schedule = F.when(size % 4 == 0, "Full-time").when(size % 4 == 1, "Contractor").when(size % 4 == 2, "Internship").otherwise("Not stated")
    return part.join(per_part, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("company"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("location", F.lit("Unknown")).alias("country"),
        F.when(size % 3 == 0, "Remote").otherwise("Not remote").alias("workplace"),
        schedule.alias("schedule"),
        F.col("p_type").alias("role_family"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
        "posted",
        F.col("p_retailprice").alias("salary_year"),
        F.coalesce("listings", F.lit(0)).alias("listings"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, body) of documents: the first line and the whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.coalesce("text", F.lit("")).alias("body"), "lang", "source")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile_id, role, skills) of customers: the part name bought most often and the nations of discounted items."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    bought = items.groupBy("o_custkey", "p_name").agg(F.count("*").alias("n"))
    role = bought.groupBy("o_custkey").agg(F.min_by("p_name", F.struct(-F.col("n"), "p_name")).alias("role"))
    skills = items.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_discount") >= 0.09, F.lower("n_name")))).alias("skills"))
    return role.join(skills, "o_custkey").select(F.col("o_custkey").alias("profile_id"), "role", "skills")
