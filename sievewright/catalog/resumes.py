"""Resume operators over conversation texts."""

from pyspark.sql import functions as F

from ..functions.skills import Vocabulary
from ..operators import resume
from ..sources import tables
from .registry import query


def _texts(spark, sf):
    # one text per turn, with a heading so that sections open
    turns = tables.table(spark, sf, "conversations")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("resume_id"), F.concat(F.initcap("role"), F.lit("\nSkills\n"), F.split_part("text", F.lit("."), F.lit(1)), F.lit("\nExperience\n"), "text").alias("text"))


@query()
def u02_sections(spark, sf):
    return resume.sections(_texts(spark, sf)).drop("first_line")


@query("SELECT resume_id, count(*) AS lines FROM (SELECT conv_id * 1000 + turn AS resume_id, unnest(string_split(text, chr(10))) AS l FROM conversations) GROUP BY resume_id")
def u02_experience_lines(spark, sf):
    return resume.lines(_texts(spark, sf)).where("section = 'experience'").groupBy("resume_id").agg(F.count("*").alias("lines"))


@query("SELECT customer_id AS resume_id, years FROM (SELECT c_custkey AS customer_id, (1 + c_custkey % 40)::DOUBLE AS years FROM customer)")
def u01_stated_years(spark, sf):
    text = F.concat(F.lit("Over "), (1 + F.col("c_custkey") % 40).cast("string"), F.lit("+ years of solid work experience"))
    return tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("resume_id"), resume.stated_years(text).alias("years"))


@query("SELECT c_custkey AS resume_id, round_even(3 + (c_custkey % 12 + 1) / 12 - (c_custkey % 6) / 12, 1) AS years FROM customer")
def u01_dated_years(spark, sf):
    month = lambda k: F.element_at(F.array(*map(F.lit, resume.MONTHS)), (F.col("c_custkey") % k + 1).cast("int"))
    text = F.concat(month(6), F.lit(" 2018 - "), month(12), F.lit(" 2021, and "), F.lit("Jan 2019 to Mar 2019"))
    return resume.dated_years(tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("resume_id"), text.alias("text")), "2024-01-01")


@query("SELECT p_partkey AS resume_id, CASE p_size % 3 WHEN 0 THEN 'Data & Analytics' WHEN 1 THEN 'Cloud & DevOps' END AS department FROM part")
def u04_department(spark, sf):
    probe = F.when(F.col("p_size") % 3 == 0, "Senior Data Engineer").when(F.col("p_size") % 3 == 1, "Cloud lead").otherwise("Gardener")
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("resume_id"), resume.department(F.col("p_name"), probe)["name"].alias("department"))


@query()
def u06_extract(spark, sf):
    vocabulary = Vocabulary.of([("the and", "x"), ("der", "y"), ("les que", "z")])
    found = F.explode(vocabulary.extracted(F.col("text"))).alias("s")
    return tables.table(spark, sf, "conversations").select("conv_id", "turn", found).select("conv_id", "turn", "s.key", "s.type")


HEADED = ("CASE p_size % 3 WHEN 0 THEN 'A. Name' || chr(10) || 'Senior Data Engineer | ' || p_brand || ' 2019 - 2021' WHEN 1 THEN 'A. Name' || chr(10) || 'Experience' || chr(10) || '- ran things as a manager' || chr(10) || 'Cloud Administrator at ' || p_name || ', Mar 2020' ELSE p_name END")


@query("SELECT p_partkey AS resume_id, CASE p_size % 3 WHEN 0 THEN 'Senior Data Engineer' ELSE 'Cloud Administrator' END AS role FROM part WHERE p_size % 3 < 2")
def u03_roles(spark, sf):
    text = F.expr(HEADED.replace("chr(10)", "'\n'"))
    return resume.roles(tables.table(spark, sf, "part").select(F.col("p_partkey").alias("resume_id"), text.alias("text")))


@query("SELECT p_partkey AS resume_id, unnest([trim(regexp_replace(lower(p_name), '[^a-z0-9+#. ]+', ' ', 'g')), 'aws', 'ec2', 's3', 'kubernetes']) AS key, unnest(['custom', 'dataset', 'custom', 'custom', 'dataset']) AS status FROM part")
def u07_from_list(spark, sf):
    vocabulary = Vocabulary.of([("AWS", "cloud"), ("Kubernetes", "tool")])
    items = F.array("p_name", F.lit("AWS (EC2, S3); K8s"), F.lit(" - "))
    found = F.explode(vocabulary.from_lists(items)).alias("s")
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("resume_id"), found).select("resume_id", "s.key", "s.status")


def _resumes(spark, sf):
    """A resume of each part: a header, a skills section with wrapped lines, dated jobs."""
    lines = [F.lit("A. Name"), F.concat(F.lit("Senior Data Engineer at "), F.col("p_brand")), F.lit("Technical Skills"), F.lit("Cloud: AWS, Google\u2011Cloud,"), F.lit("Azure"), F.lit("Tools: Terraform (modules, state)"), F.lit("Experience"), F.concat(F.lit("Cloud Engineer, Jan 2019 - "), (F.col("p_size") % 5 + 2019).cast("string")), F.lit("\u2022 kept Kubernetes running")]
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("resume_id"), F.concat_ws("\n", *lines).alias("text"))


KNOWN = (("AWS", "cloud"), ("Azure", "cloud"), ("GCP", "cloud"), ("Kubernetes", "tool"), ("Terraform", "tool"))


@query("SELECT p_partkey AS resume_id, 'Cloud Engineer' AS role, 'Cloud & DevOps' AS department, round_even(p_size % 5 + 1, 1)::DOUBLE AS years, 'aws|gcp|azure|terraform|modules|state|kubernetes' AS skills, 'skills|experience' AS sections, 0 AS warnings FROM part")
def u10_parsed(spark, sf):
    out = resume.parsed(_resumes(spark, sf), Vocabulary.of(KNOWN), "2024-01-01")
    return out.select("resume_id", "role", "department", "years", F.array_join(F.transform("skills", lambda s: s["key"]), "|").alias("skills"), F.array_join("sections", "|").alias("sections"), F.size("warnings").alias("warnings"))


@query()
def u11_steps(spark, sf):
    """The step log of resumes, one of them broken."""
    texts = _resumes(spark, sf)
    path = F.concat(F.lit("/resumes/"), F.col("resume_id").cast("string"), F.lit(".pdf"))
    files = texts.select(path.alias("path"), F.length("text").cast("long").alias("size"), "text", F.lit(1).alias("pages"), F.when(F.col("resume_id") == 1, "encrypted").alias("error"))
    profiles = resume.parsed(texts.select(path.alias("resume_id"), "text"), Vocabulary.of(KNOWN), "2024-01-01")
    return resume.steps(files, profiles).select("path", F.inline("steps"))


@query()
def t19_cleaned(spark, sf):
    return tables.table(spark, sf, "conversations").select("conv_id", "turn", resume.cleaned(F.col("text")).alias("text"))
