"""Profiles against the catalog: requirements, fit, gaps, plans, roll-ups."""

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import fit, rank
from ..plans import transition
from ..sources import tables
from .ranking import _Scored
from .registry import catalog_index, once, query, rounded, sql_biwords, sql_terms


class _Career:
    """What queries on profiles share; each makes only the tables that it reads."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def s(self):
        return _Scored(self.spark, self.sf)

    @cached_property
    def ix(self):
        return catalog_index(self.spark, self.sf)

    @cached_property
    def kept(self):
        return once(self.spark, self.sf, "kept", lambda: fit.relevant(rank.top_k(self.s.hybrid, 50)))

    @cached_property
    def skills(self):
        return fit.record_skills(self.ix.listings)

    @cached_property
    def required(self):
        return once(self.spark, self.sf, "required", lambda: fit.requirements(self.kept, self.skills))

    @cached_property
    def people(self):
        return once(self.spark, self.sf, "profiles", lambda: tables.profiles(self.spark, self.sf))

    @cached_property
    def mine(self):
        return fit.profile_skills(self.people)

    @cached_property
    def needs(self):
        able = once(self.spark, self.sf, "able", lambda: fit.met(self.people, self.required, self.mine))
        needs = able.crossJoin(F.broadcast(self.required))  # requirements of a batch: hundreds of rows
        return needs.withColumn("mine", F.try_element_at("met", F.col("key"))).drop("met")

    def fits(self):
        """Coverage of the relevant rows of every query for each profile, without a role component."""
        rows = self.kept.select("query_id", "doc_id", "score")
        asked = rows.select("doc_id").distinct().join(self.skills, "doc_id")
        cover = fit.coverage_of(fit.met(self.people, asked, self.mine), rows, self.skills, self.ix.terms)
        none = cover.select("profile_id", "doc_id", F.lit(None).cast("double").alias("role")).limit(0)
        return fit.fit(cover, none)

    def listings(self):
        """The records of relevant rows: fifty a query at most."""
        kept = self.kept.select(F.col("doc_id").alias("id")).distinct()
        return F.broadcast(self.ix.listings.join(F.broadcast(kept), "id", "left_semi"))


EACH = ("profile_id", "query_id")


@query("SELECT query_id, doc_id, round_even(score, 6) AS score FROM rel", ("rel",))
def f07_relevant(spark, sf):
    return rounded(_Career(spark, sf).kept.select("query_id", "doc_id", "score"), "score")


@query("SELECT query_id, key, round_even(prevalence, 6) AS prevalence, jobs, priority FROM req", ("req",))
def a05_requirements(spark, sf):
    return rounded(_Career(spark, sf).required, "prevalence")


@query("SELECT query_id, count(*) AS kept, count(*) < 5 AS limited FROM rel GROUP BY query_id", ("rel",))
def c04_evidence(spark, sf):
    return fit.evidence(_Career(spark, sf).kept)


@query("SELECT profile_id, query_id, key, round_even(prevalence, 6) AS prevalence, priority, mine FROM need", ("need",))
def j06_gap(spark, sf):
    return rounded(_Career(spark, sf).needs.select("profile_id", "query_id", "key", "prevalence", "priority", "mine"), "prevalence")


@query("SELECT profile_id, query_id, round_even(sum(CASE WHEN mine IS NOT NULL THEN prevalence ELSE 0 END) / sum(prevalence), 6) AS match FROM need GROUP BY ALL", ("need",))
def a08_match(spark, sf):
    return rounded(fit.match_share(_Career(spark, sf).needs), "match")


@query("SELECT profile_id, query_id, row_number() OVER (PARTITION BY profile_id, query_id ORDER BY round(prevalence, 12) DESC, key)::INT AS position, key, priority FROM need WHERE mine IS NULL", ("need",))
def k10_plan(spark, sf):
    return fit.plan(_Career(spark, sf).needs).drop("why")


@query("SELECT DISTINCT profile_id, mine FROM mine WHERE mine NOT IN (SELECT key FROM req)", ("mine", "req"))
def j07_extra_skills(spark, sf):
    c = _Career(spark, sf)
    return fit.extra_skills(c.mine, c.needs)


COVER = """, w AS (SELECT f.profile_id, r.query_id, r.doc_id, any_value(r.score) AS score, count(mine.mine) AS have, count(*) - count(mine.mine) AS missing, sum(CASE WHEN mine.mine IS NOT NULL THEN idf + 0.1 ELSE 0 END) / sum(idf + 0.1) AS coverage
  FROM (SELECT profile_id FROM profile) f CROSS JOIN (SELECT query_id, doc_id, score FROM rel) r JOIN dskill USING (doc_id) JOIN (SELECT replace(term, '_', ' ') AS key, idf FROM dict WHERE zone = 'Skills') USING (key) LEFT JOIN mine ON mine.profile_id = f.profile_id AND mine.mine = dskill.key GROUP BY ALL) """
COVER_PARTS = ("profile", "rel", "dskill", "dict", "mine")


@query(COVER + "SELECT profile_id, query_id, doc_id, round_even(coverage, 6) AS coverage, have, missing FROM w", COVER_PARTS)
def a06_coverage(spark, sf):
    return rounded(_Career(spark, sf).fits().select(*EACH, "doc_id", "coverage", "have", "missing"), "coverage")


@query(COVER + "SELECT profile_id, query_id, doc_id, round_even(coverage, 6) AS fit FROM w", COVER_PARTS)
def a07_fit(spark, sf):
    return rounded(_Career(spark, sf).fits().select(*EACH, "doc_id", "fit"), "fit")


@query(
    COVER
    + """, o AS (SELECT w.*, row_number() OVER (PARTITION BY profile_id, query_id, lower(title), lower(company) ORDER BY round(coverage, 12) DESC, round(score, 12) DESC, doc_id) AS u FROM w JOIN listing ON id = doc_id)
SELECT profile_id, query_id, doc_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, query_id ORDER BY round(coverage, 12) DESC, round(score, 12) DESC, doc_id) AS rank FROM o WHERE u = 1) WHERE rank <= 8""",
    (*COVER_PARTS, "listing"),
)
def k09_recommended(spark, sf):
    c = _Career(spark, sf)
    return fit.recommended(c.fits(), c.listings(), 8, EACH).select(*EACH, "doc_id", "rank")


@query(
    COVER
    + """, o AS (SELECT profile_id, query_id, company, count(*) AS jobs, max(coverage) AS best FROM w JOIN listing ON id = doc_id GROUP BY ALL)
SELECT profile_id, query_id, company, jobs, round_even(best, 6) AS best_fit, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, query_id ORDER BY round(best, 12) DESC, jobs DESC, company) AS rank FROM o) WHERE rank <= 8""",
    (*COVER_PARTS, "listing"),
)
def a09_company_rollup(spark, sf):
    c = _Career(spark, sf)
    return rounded(fit.by_company(c.fits(), c.listings(), 8, EACH).select(*EACH, "company", "jobs", "best_fit", "rank"), "best_fit")


TITLE_ROLE = """, rw AS (SELECT profile_id, """ + sql_terms("role", True) + """ AS words FROM profile WHERE role IS NOT NULL),
rt AS (SELECT profile_id, term, count(*) AS tf FROM (SELECT profile_id, unnest(words || """ + sql_biwords("words") + """) AS term FROM rw) GROUP BY ALL),
rv AS (SELECT profile_id, term, p / norm AS qw FROM (SELECT profile_id, term, (1 + log10(rt.tf)) * idf AS p, sqrt(sum(power((1 + log10(rt.tf)) * idf, 2)) OVER (PARTITION BY profile_id)) AS norm FROM rt JOIN (SELECT term, idf FROM dict WHERE zone = 'Title') USING (term)) WHERE norm > 0),
page AS (SELECT DISTINCT doc_id FROM rel),
rs AS (SELECT profile_id, doc_id, sum(qw * dw) AS role FROM rv JOIN (SELECT term, doc_id, dw FROM post WHERE zone = 'Title' AND doc_id IN (SELECT doc_id FROM page)) USING (term) GROUP BY ALL) """


@query(TITLE_ROLE + "SELECT profile_id, doc_id, round_even(role, 6) AS role FROM rs", ("profile", "dict", "post", "rel"))
def r16_role_similarity(spark, sf):
    c = _Career(spark, sf)
    return rounded(transition.role_similarity(c.ix, c.people, c.kept.select("doc_id").distinct()), "role")


@query(
    COVER
    + TITLE_ROLE
    + """, cv AS (SELECT profile_id, doc_id, any_value(coverage) AS coverage FROM w GROUP BY ALL)
SELECT profile_id, doc_id, round_even(coverage, 6) AS coverage, round_even(role, 6) AS role, round_even(CASE WHEN coverage IS NULL THEN role WHEN role IS NULL THEN coverage ELSE 0.75 * coverage + 0.25 * role END, 6) AS fit
FROM (SELECT p.profile_id, g.doc_id, coverage, CASE WHEN p.role IS NULL THEN NULL ELSE coalesce(rs.role, 0) END AS role
  FROM profile p CROSS JOIN page g LEFT JOIN cv ON cv.profile_id = p.profile_id AND cv.doc_id = g.doc_id LEFT JOIN rs ON rs.profile_id = p.profile_id AND rs.doc_id = g.doc_id)""",
    (*COVER_PARTS, "post"),
)
def c03_job_fit(spark, sf):
    """Both components: covered skills, and the title's likeness to the profile's role."""
    c = _Career(spark, sf)
    out = transition.job_fit(c.ix, c.people, c.kept.select("doc_id").distinct())
    return rounded(out.select("profile_id", "doc_id", "coverage", "role", "fit"), "coverage", "role", "fit")


@query()
def c02_attach_fit(spark, sf):
    """The first page of the batch's best query for every profile, and the message for a profile that says nothing."""
    c = _Career(spark, sf)
    blank = c.people.limit(1).select(F.lit(-1).cast("long").alias("profile_id"), F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("skills"))
    page = rank.top_k(c.s.hybrid, 10).where("query_id = 1").select("doc_id", "score")
    return rounded(transition.attach_fit(c.ix, c.people.unionByName(blank), page).select("profile_id", "doc_id", "coverage", "role", "fit", "message"), "coverage", "role", "fit")


@query()
def c09_explained(spark, sf):
    """How every profile would prepare for one record."""
    c = _Career(spark, sf)
    first = c.ix.listings.where(F.size("skills") >= 3).agg(F.min("id")).first()[0]
    return rounded(transition.explained(c.ix, first, "small ring economy", c.people)["preparation"], "prevalence")


@query()
def c10_compared(spark, sf):
    """Three records compared: the fit of each for every profile."""
    c = _Career(spark, sf)
    ids = [r.id for r in c.ix.listings.where(F.size("skills") >= 2).orderBy("id").limit(3).collect()]
    return rounded(transition.compared_fit(c.ix, c.people, ids)[1].select("profile_id", "doc_id", "coverage", "role", "fit"), "coverage", "role", "fit")


@query("SELECT profile_id, role, array_to_string(skills, '|') AS skills FROM profile", ("profile",))
def u09_profiles(spark, sf):
    people = fit.normalized_profiles(tables.profiles(spark, sf))
    return people.select("profile_id", "role", F.array_join(F.transform("skills", lambda s: s["key"]), "|").alias("skills"))
