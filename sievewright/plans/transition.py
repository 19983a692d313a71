"""From a profile to a role: requirements, gap, plan, recommended records and companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Ranking
from ..errors import QueryError
from ..operators import analyze, filters, fit, rank, score
from ..operators.index import Index
from .search import Search, compare, evidence_for, limited, similar

ROLE_PRESENT, READ, RETRIEVED = 0.5, 50, 60
MOST_PAGED = 1000  # records whose fit is computed for every profile at once


def target_requirements(ix: Index, role: str, company: str | None = None, stemming: bool = False) -> tuple[Search, DataFrame, DataFrame]:
    """(search, kept rows, requirements) of a role, at one company if given."""
    queries = ix.listings.sparkSession.createDataFrame([(1, role)], "query_id int, query string")
    s = Search(ix, queries, Ranking(diversity=False), {"company": [company]} if company else None, stemming)
    kept = fit.relevant(rank.top_k(s.scores, READ))
    return s, kept, fit.requirements(kept, fit.record_skills(ix.listings))


def role_present(s: Search) -> DataFrame:
    """(query_id, present): the best title cosine is at least a half."""
    best = score.cosine(s.vectors.where("zone = 'Title'"), s.ix.posts, s.allowed).groupBy("query_id").agg(F.max("cosine").alias("best"))
    return best.select("query_id", (F.col("best") >= ROLE_PRESENT).alias("present"))


def role_similarity(ix: Index, profiles: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(profile_id, doc_id, role): title cosine of each profile's role with the records, or with ``allowed(doc_id)`` of them."""
    roles = profiles.where("role is not null").select("profile_id", F.col("role").alias("query"))
    each = roles.select("query").distinct()  # a role that many profiles have is scored once
    words = analyze.query_words(each.select(F.col("query").alias("query_id"), "query"))
    wanted = analyze.query_terms(words).select("query_id", F.lit("Title").alias("zone"), "term", "tf", F.lit(1.0).alias("boost"))
    found = score.cosine(analyze.query_vectors(wanted, ix.terms), ix.posts, allowed).select(F.col("query_id").alias("query"), "doc_id", F.col("cosine").alias("role"))
    return roles.join(found, "query").select("profile_id", "doc_id", "role")


def paged(rows: DataFrame) -> DataFrame:
    """The different ``doc_id`` of a page of results, which is refused if it is none."""
    ids = rows.select("doc_id").distinct().limit(MOST_PAGED + 1).collect()
    if len(ids) > MOST_PAGED:
        raise QueryError(f"a fit is computed for {MOST_PAGED} records at once at most")
    return rows.sparkSession.createDataFrame(ids, rows.select("doc_id").schema)


def job_fit(ix: Index, profiles: DataFrame, rows: DataFrame) -> DataFrame:
    """(profile_id, doc_id, coverage, role, fit) of ``rows(doc_id)`` for ``profiles(profile_id, role, skills)``."""
    page, skills, mine = paged(rows), fit.record_skills(ix.listings), fit.profile_skills(profiles)
    cover = fit.coverage_of(fit.met(profiles, page.join(skills, "doc_id"), mine), page, skills, ix.terms)  # a result page for each profile
    # a known role without a common title word has similarity zero
    pairs = profiles.where("role is not null").select("profile_id").crossJoin(F.broadcast(page))
    roles = pairs.join(role_similarity(ix, profiles, page), ["profile_id", "doc_id"], "left").select("profile_id", "doc_id", F.coalesce("role", F.lit(0.0)).alias("role"))
    return fit.fit(cover, roles)


def attach_fit(ix: Index, profiles: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` with a fit for each profile; profiles with neither skills nor a role get a fixed message instead."""
    has = profiles.where(fit.has_profile(F.col("skills"), F.col("role")))
    fitted = results.join(job_fit(ix, has, results), "doc_id", "left").withColumn("message", F.lit(None).cast("string"))
    without = profiles.join(has.select("profile_id"), "profile_id", "left_anti").select("profile_id")
    none = without.crossJoin(F.broadcast(results)).withColumns({c: F.lit(None).cast("double") for c in ("coverage", "role", "fit")} | {"have": F.lit(None).cast("long"), "missing": F.lit(None).cast("long"), "message": F.lit(fit.NO_PROFILE)})
    return fitted.unionByName(none, allowMissingColumns=True)


def transition(ix: Index, profiles: DataFrame, role: str, company: str | None = None, k: int = 10, stemming: bool = False) -> dict[str, DataFrame]:
    """Requirements, gap, match, plan, extra skills, recommended records, companies and the closest at one company."""
    limited(k, 30)
    if not (role or "").strip():
        raise QueryError("a target role is needed")
    named, near = filters.resolve_company(ix.listings, company) if company else (None, [])
    if company and named is None:
        raise QueryError(f"no company {company!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    people = fit.keyed_profiles(profiles).where(fit.has_profile(F.col("skills"), F.col("role")))
    s, kept, required = target_requirements(ix, role, stemming=stemming)
    mine = fit.profile_skills(people)
    needs = people.select("profile_id").crossJoin(required)  # a role's requirements for each profile
    gaps = fit.gap(needs, mine)
    rows = fit.relevant(rank.top_k(s.scores, RETRIEVED)).select("doc_id", "score")
    fits = job_fit(ix, people, rows).join(rows, "doc_id")
    out = {"requirements": required, "evidence": fit.evidence(kept), "gap": gaps, "match": fit.match_share(gaps), "plan": fit.plan(gaps), "extra": fit.extra_skills(mine, needs), "recommended": fit.recommended(fits, ix.listings, k), "companies": fit.by_company(fits, ix.listings), "titles": fit.example_titles(rank.top_k(s.scores, READ), ix.listings)}
    if named:
        at, _, own = target_requirements(ix, role, named, stemming)
        out |= {"company_requirements": own, "role_present": role_present(at), "closest": rank.top_k(at.scores, 5)}
    return out


def compared_fit(ix: Index, profiles: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(skills that all of two to four records share, the fit of each record for each profile)."""
    shared = compare(ix, ids)
    rows = ix.listings.where(F.col("id").isin(ids)).select(F.col("id").alias("doc_id"))
    return shared, attach_fit(ix, fit.keyed_profiles(profiles), rows)


def explained(ix: Index, doc_id: int, query: str, profiles: DataFrame, stemming: bool = False) -> dict[str, DataFrame]:
    """One record for one query and some profiles: its evidence, what is similar, the fit, and how to prepare for it.

    preparation (profile_id, position, key, priority, prevalence, why) orders the skills that a profile lacks by how
    often records of that title ask for them; a skill that they rarely ask for is LOW.
    """
    record = filters.lookup(ix.listings, doc_id)
    title = record.select("title").first().title
    people = fit.keyed_profiles(profiles)
    rows = record.select(F.col("id").alias("doc_id"))
    asked = fit.record_skills(record)
    needs = people.where(fit.has_profile(F.col("skills"), F.col("role"))).select("profile_id").crossJoin(F.broadcast(asked))  # the skills of one record
    missing = fit.covered(needs, fit.profile_skills(people)).where("mine is null").select("profile_id", "doc_id", "key")
    _, kept, required = target_requirements(ix, title, stemming=stemming)
    known = required.select("key", "priority", "prevalence").crossJoin(F.broadcast(fit.evidence(kept).select(F.col("kept").alias("read"))))  # one row
    prep = missing.join(F.broadcast(known), "key", "left")
    w = W.partitionBy("profile_id").orderBy(F.desc(F.round(F.coalesce("prevalence", F.lit(0.0)), 12)), "key")
    why = F.when(F.col("prevalence").isNull(), "asked for here, but seldom by similar records").otherwise(F.format_string("asked for by %d%% of the %d records read for this title", F.bround(F.col("prevalence") * 100).cast("int"), F.col("read")))
    prep = prep.select("profile_id", "doc_id", F.row_number().over(w).alias("position"), "key", F.coalesce("priority", F.lit("LOW")).alias("priority"), F.coalesce("prevalence", F.lit(0.0)).alias("prevalence"), why.alias("why"))
    return {"record": filters.payload(record), "evidence": evidence_for(ix, doc_id, query, stemming), "similar": similar(ix, doc_id, 6), "fit": attach_fit(ix, people, rows), "preparation": prep}
