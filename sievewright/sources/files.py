"""File sources and sinks: CSV records, dimensions, judged queries, resumes, index tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "job_title_short string, job_title string, job_location string, job_via string, job_schedule_type string, job_work_from_home string, search_location string, job_posted_date string, job_no_degree_mention string, job_health_insurance string, job_country string, salary_rate string, salary_year_avg string, salary_hour_avg string, company_name string, job_skills string, job_type_skills string"
LISTING = "job_id string, title string, company string, location string, country string, workplace string, schedule string, role_family string, skills string, posted string, salary_year_avg string, salary_hour_avg string, salary_rate string, via string, listings string, no_degree string, health_insurance string"
MOST_BYTES, LEAST_WORDS = 8 << 20, 15


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw postings: 17 string columns, quoted fields of any length and with line ends."""
    return spark.read.schema(RAW).options(header=True, multiLine=True, escape='"', maxCharsPerColumn=-1).csv(path)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings with coerced types and defaults. A missing path raises FileNotFoundError, no rows ValueError."""
    try:
        raw = spark.read.schema(LISTING).options(header=True, multiLine=True, escape='"', maxCharsPerColumn=-1).csv(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    out = coerced(raw)
    if out.isEmpty():
        raise ValueError(f"no rows in {path}")
    return out


def coerced(raw: DataFrame) -> DataFrame:
    """Casts and defaults of listing columns; what cannot be read as a number is null."""
    text = lambda c, d="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return raw.select(
        F.expr("try_cast(job_id as bigint)").alias("id"), "title", "company", text("location").alias("location"), text("country", "Unknown").alias("country"),
        F.when(F.col("workplace") == "Remote", "Remote").otherwise("Not remote").alias("workplace"), text("schedule", "Not stated").alias("schedule"), text("role_family").alias("role_family"),
        F.filter(F.split(F.coalesce("skills", F.lit("")), r"\|"), lambda s: s != "").alias("skills"), F.expr("try_cast(posted as date)").alias("posted"),
        F.expr("try_cast(salary_year_avg as double)").alias("salary_year"), F.expr("try_cast(salary_hour_avg as double)").alias("salary_hour"), F.nullif("salary_rate", F.lit("")).alias("salary_rate"), F.nullif("via", F.lit("")).alias("via"),
        F.coalesce(F.expr("try_cast(listings as bigint)"), F.lit(1)).alias("listings"), (F.coalesce("no_degree", F.lit("")) == "True").alias("no_degree"), (F.coalesce("health_insurance", F.lit("")) == "True").alias("health_insurance"),
    )


def write_listings(listings: DataFrame, path: str) -> None:
    """Listings as CSV; skills joined by bars."""
    listings.withColumn("skills", F.concat_ws("|", "skills")).write.mode("overwrite").options(header=True, escape='"').csv(path)


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """(key, type) of the skill dimension: of rows with one key the first counts. A missing file is an empty table."""
    from ..functions.skills import canon

    kind = "skill_id bigint, skills string, type string"
    try:
        rows = spark.read.schema(kind).options(header=True).csv(path)
    except AnalysisException:
        rows = spark.createDataFrame([], kind)
    return rows.withColumn("key", canon(F.col("skills"))).groupBy("key").agg(F.min_by("type", "skill_id").alias("type"))


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, type, split, must, should): rules as maps of value lists."""
    rule = "map<string, array<string>>"
    raw = spark.read.schema(f"description string, queries array<struct<id string, query string, type string, split string, must {rule}, should {rule}>>").json(path, multiLine=True)
    return raw.select(F.inline("queries"))


def read_info(path: str) -> dict:
    """A small JSON file; empty when it cannot be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, pages, error) of binary resumes. Without a PDF library only the errors before parsing are told."""
    files = spark.read.format("binaryFile").load(path)

    def run(frames):
        import io

        import pandas as pd

        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                text, pages, error = None, None, None
                if not content:
                    error = "empty_file"
                elif len(content) > MOST_BYTES:
                    error = "too_large"
                elif not content.lstrip()[:5].startswith(b"%PDF-"):
                    error = "not_pdf"
                elif PdfReader is None:
                    error = "unreadable"
                else:
                    try:
                        pdf = PdfReader(io.BytesIO(content))
                        if pdf.is_encrypted and not pdf.decrypt(""):
                            error = "encrypted"
                        else:
                            text, pages = "\n".join(p.extract_text() or "" for p in pdf.pages), len(pdf.pages)
                            error = "no_text" if len(text.split()) < LEAST_WORDS else None
                    except Exception:  # whatever a broken file makes the parser raise
                        error = "unreadable"
                out.append((name, text, pages, error))
            yield pd.DataFrame(out, columns=["path", "text", "pages", "error"])

    kind = "path string, text string, pages int, error string"
    # Spark's file sources leave out files without bytes
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    empty = [(s.getPath().toString(), None, None, "empty_file") for s in listed if s.isFile() and s.getLen() == 0]
    return files.select("path", "content").mapInPandas(run, kind).unionByName(spark.createDataFrame(empty, kind))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fingerprint(spark: SparkSession, path: str, version: str) -> str:
    """A hash of the names, sizes and times of the files at ``path`` and the index version."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [version]
    status = fs.listStatus(where)
    for s in status:
        parts.append(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(parts)).encode()).hexdigest()
