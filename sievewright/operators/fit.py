"""How a profile meets what records ask for: coverage, fit, requirements, gaps, plans, roll-ups. Batch-first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.skills import canon, covers

#: Component weights, cuts and bands that results depend on.
SKILL_SHARE, ROLE_SHARE = 0.75, 0.25
RELEVANT, PREVALENT, HIGH, MEDIUM, FEW = 0.6, 0.10, 0.50, 0.25, 5
NO_PROFILE = "No profile: fit is not computed."


def normalized_profiles(profiles: DataFrame) -> DataFrame:
    """Trimmed roles (empty: null), distinct skills by key in order, years within [0, 60] or null."""
    named = F.filter(F.transform("skills", lambda s: F.trim(s)), lambda s: canon(s) != "")
    keys = F.transform(named, canon)
    first = F.filter(F.transform(named, lambda s, i: F.struct(s.alias("name"), F.get(keys, i).alias("key"), i.alias("i"))), lambda x: F.array_position(keys, x["key"]) == x["i"] + 1)
    out = profiles.withColumn("skills", F.transform(first, lambda x: F.struct(x["name"].alias("name"), x["key"].alias("key"))))
    out = out.withColumn("role", F.nullif(F.trim("role"), F.lit("")))
    return out.withColumn("years", F.when(F.expr("try_cast(years as double) between 0 and 60"), F.expr("try_cast(years as double)"))) if "years" in profiles.columns else out


def keyed_profiles(profiles: DataFrame) -> DataFrame:
    """``normalized_profiles`` with the keys alone as skills; each skill's key is made once."""
    keys = F.filter(F.transform("skills", lambda s: canon(F.trim(s))), lambda k: k != "")
    return normalized_profiles(profiles.withColumn("_keys", F.array_distinct(keys))).withColumn("skills", F.col("_keys")).drop("_keys")


def has_profile(skills, role):
    return (F.size(skills) > 0) | (F.trim(F.coalesce(role, F.lit(""))) != "")


def record_skills(listings: DataFrame) -> DataFrame:
    """(doc_id, key), a key once per record."""
    return listings.select(F.col("id").alias("doc_id"), F.explode(F.array_distinct(F.transform("skills", canon))).alias("key"))


def covered(needs: DataFrame, skills: DataFrame) -> DataFrame:
    """``needs(profile_id, …, key)`` with ``mine``: the first of the profile's skills ``(profile_id, pos, mine)`` that covers
    it, or null. Joined by profile, so only its own skills are compared."""
    met = needs.select("profile_id", "key").distinct().join(skills, "profile_id").where(covers(F.col("mine"), F.col("key")))
    first = met.groupBy("profile_id", "key").agg(F.min_by("mine", "pos").alias("mine"))
    return needs.join(first, ["profile_id", "key"], "left")


def met(profiles: DataFrame, keys: DataFrame, skills: DataFrame) -> DataFrame:
    """(profile_id, met) of every profile: each of ``keys(key)`` that it covers, with the first of its skills that does.

    ``keys`` is what a batch of queries asks for, a bounded list. Different skills are compared with it once, and the
    skills of profiles then meet the pairs by an equi-join.
    """
    pairs = skills.select("mine").distinct().join(F.broadcast(keys.select("key").distinct()), covers(F.col("mine"), F.col("key")))
    first = skills.join(pairs, "mine").groupBy("profile_id", "key").agg(F.min_by("mine", "pos").alias("mine"))
    each = first.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "mine"))).alias("met"))
    return profiles.select("profile_id").join(each, "profile_id", "left").withColumn("met", F.coalesce("met", F.expr("cast(map() as map<string, string>)")))


def profile_skills(profiles: DataFrame) -> DataFrame:
    """(profile_id, pos, mine)."""
    return profiles.select("profile_id", F.posexplode(F.transform("skills", canon)).alias("pos", "mine"))


def skill_coverage(needs: DataFrame, terms: DataFrame) -> DataFrame:
    """(profile_id, doc_id, coverage, have, missing): idf-weighted share of a record's skills that are covered."""
    idf = terms.where("zone = 'Skills'").select(F.replace("term", F.lit("_"), F.lit(" ")).alias("key"), "idf")
    w = needs.join(idf, "key", "left").withColumn("w", F.coalesce("idf", F.lit(1.0)) + 0.1)
    has = F.col("mine").isNotNull()
    return w.groupBy("profile_id", "doc_id").agg(F.try_divide(F.sum(F.when(has, F.col("w")).otherwise(0.0)), F.sum("w")).alias("coverage"), F.count_if(has).alias("have"), F.count_if(~has).alias("missing"))


def coverage_of(people: DataFrame, rows: DataFrame, skills: DataFrame, terms: DataFrame) -> DataFrame:
    """``skill_coverage`` of bounded ``rows(doc_id, …)``, whose other columns stay, for each of ``people(profile_id, met)``."""
    idf = terms.where("zone = 'Skills'").select(F.replace("term", F.lit("_"), F.lit(" ")).alias("key"), "idf")
    each = rows.select("doc_id").distinct().join(skills, "doc_id").join(idf, "key", "left")
    asked = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key", (F.coalesce("idf", F.lit(1.0)) + 0.1).alias("w")))).alias("asked"))
    both = people.crossJoin(F.broadcast(rows.join(asked, "doc_id")))  # the relevant rows of a batch: fifty a query at most
    weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["w"])
    both = both.withColumn("had", F.filter("asked", lambda x: F.map_contains_key("met", x["key"])))
    both = both.withColumns({"coverage": F.try_divide(weight(F.col("had")), weight(F.col("asked"))), "have": F.size("had").cast("long"), "missing": (F.size("asked") - F.size("had")).cast("long")})
    return both.drop("met", "asked", "had")


def fit(coverage: DataFrame, roles: DataFrame) -> DataFrame:
    """(profile_id, doc_id, coverage, role, fit): weighted mean of the components that there are."""
    both = coverage.join(roles, ["profile_id", "doc_id"], "full")
    part = lambda c, w: F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0)
    total = part("coverage", SKILL_SHARE) + part("role", ROLE_SHARE)
    top = F.coalesce(F.col("coverage") * SKILL_SHARE, F.lit(0.0)) + F.coalesce(F.col("role") * ROLE_SHARE, F.lit(0.0))
    return both.withColumn("fit", F.try_divide(top, total))


def relevant(ranked: DataFrame) -> DataFrame:
    """Rows whose score is positive and at least 0.6 of their query's best."""
    best = F.max("score").over(W.partitionBy("query_id"))
    return ranked.withColumn("best", best).where((F.col("score") > 0) & (F.col("score") >= RELEVANT * F.col("best"))).drop("best")


def requirements(kept: DataFrame, skills: DataFrame) -> DataFrame:
    """(query_id, key, prevalence, jobs, priority): share of the kept rows' scores that ask for each skill, from 0.10 on."""
    total = kept.groupBy("query_id").agg(F.sum("score").alias("total"))
    each = kept.join(skills, "doc_id").groupBy("query_id", "key").agg(F.sum("score").alias("s"), F.count("*").alias("jobs")).join(total, "query_id")
    out = each.withColumn("prevalence", F.col("s") / F.col("total")).where(F.round("prevalence", 12) >= PREVALENT)
    p = F.round("prevalence", 12)
    return out.select("query_id", "key", "prevalence", "jobs", F.when(p >= HIGH, "HIGH").when(p >= MEDIUM, "MEDIUM").otherwise("LOW").alias("priority"))


def evidence(kept: DataFrame) -> DataFrame:
    """(query_id, kept, limited): fewer than five kept rows are limited evidence."""
    return kept.groupBy("query_id").agg(F.count("*").alias("kept")).withColumn("limited", F.col("kept") < FEW)


def gap(required: DataFrame, skills: DataFrame) -> DataFrame:
    """(profile_id, query_id, key, prevalence, priority, mine) for ``required`` joined with profiles; mine is null where missing."""
    return covered(required, skills)


def match_share(gaps: DataFrame) -> DataFrame:
    """(profile_id, query_id, match): prevalence covered over all prevalence; null without requirements."""
    has = F.when(F.col("mine").isNotNull(), F.col("prevalence")).otherwise(0.0)
    return gaps.groupBy("profile_id", "query_id").agg(F.try_divide(F.sum(has), F.sum("prevalence")).alias("match"))


def extra_skills(skills: DataFrame, required: DataFrame) -> DataFrame:
    """(profile_id, mine) of profile skills that cover no requirement of the profile's."""
    met = skills.join(required.select("profile_id", "key").distinct(), "profile_id").where(covers(F.col("mine"), F.col("key"))).select("profile_id", "mine").distinct()
    return skills.select("profile_id", "mine").distinct().join(met, ["profile_id", "mine"], "left_anti")


def plan(gaps: DataFrame) -> DataFrame:
    """(profile_id, query_id, position, key, priority, why) of the missing skills, the most asked for first."""
    w = W.partitionBy("profile_id", "query_id").orderBy(F.desc(F.round("prevalence", 12)), "key")
    why = F.format_string("asked for in %d%% of what was read", F.bround(F.col("prevalence") * 100).cast("int"))
    return gaps.where("mine is null").select("profile_id", "query_id", F.row_number().over(w).alias("position"), "key", "priority", why.alias("why"))


def recommended(fits: DataFrame, listings: DataFrame, k: int, by: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """(by…, doc_id, fit, score, rank): best fit, then score, then id; one per title and company."""
    order = [F.desc(F.round("fit", 12)), F.desc(F.round("score", 12)), "doc_id"]
    named = fits.join(listings.select(F.col("id").alias("doc_id"), F.lower("title").alias("t"), F.lower("company").alias("c")), "doc_id")
    one = named.withColumn("r", F.row_number().over(W.partitionBy(*by, "t", "c").orderBy(*order))).where("r = 1")
    return one.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).select(*by, "doc_id", "fit", "score", "rank")


def by_company(fits: DataFrame, listings: DataFrame, k: int = 8, by: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """(by…, company, jobs, best_fit, best_score, rank)."""
    named = fits.join(listings.select(F.col("id").alias("doc_id"), "company"), "doc_id")
    rolled = named.groupBy(*by, "company").agg(F.count("*").alias("jobs"), F.max("fit").alias("best_fit"), F.max("score").alias("best_score"))
    w = W.partitionBy(*by).orderBy(F.desc(F.round("best_fit", 12)), F.desc("jobs"), "company")
    return rolled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def example_titles(ranked: DataFrame, listings: DataFrame, k: int = 6) -> DataFrame:
    """(query_id, title, first_rank): the first k different titles by rank."""
    t = ranked.join(listings.select(F.col("id").alias("doc_id"), "title"), "doc_id").groupBy("query_id", "title").agg(F.min("rank").alias("first_rank"))
    return t.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("first_rank"))).where(F.col("r") <= k).drop("r")


def compared(listings: DataFrame, ids: list[int]) -> DataFrame:
    """(key) of skills that all of two to four records share."""
    from ..errors import QueryError

    if not 2 <= len(set(ids)) <= 4:
        raise QueryError("two to four different records can be compared")
    rows = record_skills(listings.where(F.col("id").isin(ids)))
    return rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(set(ids))).select("key")
