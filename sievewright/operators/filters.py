"""Facet filters, relevance rules and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFound, QueryError
from ..functions.skills import canon
from .analyze import closest

FIELDS = ("company", "country", "workplace", "schedule", "role_family")


def predicate(filters: dict[str, list[str]] | None) -> Column:
    """Any of the values within a field, all fields together; empty lists and no filters let everything through."""
    out = F.lit(True)
    for field, values in (filters or {}).items():
        if field not in FIELDS:
            raise QueryError(f"unknown filter {field!r}; known are {', '.join(FIELDS)}")
        if values:
            out &= F.lower("company").isin([v.lower() for v in values]) if field == "company" else F.col(field).isin(list(values))
    return out


def check_values(listings: DataFrame, filters: dict[str, list[str]] | None) -> None:
    """Every value exists in its field; an unknown company is answered with close ones."""
    predicate(filters)
    for field, values in (filters or {}).items():
        for v in values or []:
            if listings.where(predicate({field: [v]})).isEmpty():
                near = resolve_company(listings, v)[1] if field == "company" else []
                raise QueryError(f"no {field} {v!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))


def resolve_company(listings: DataFrame, name: str) -> tuple[str | None, list[str]]:
    """The company of exactly this name in any case; otherwise close spellings and names that contain it, six at most."""
    key = (name or "").strip().lower()
    found = listings.where(F.lower("company") == key).select("company").orderBy("company").limit(1).collect()
    if found:
        return found[0].company, []
    names = listings.select(F.lower("company").alias("low"), "company").groupBy("low").agg(F.min("company").alias("company"))
    words = listings.sparkSession.createDataFrame([(key,)], "word string")
    found = closest(words, names.select(F.col("low").alias("term")), 5, 0.8).select(F.posexplode("suggestions").alias("at", "low"))
    close = [r.company for r in found.join(names, "low").orderBy("at").collect()]
    inside = [r.company for r in names.where(F.contains("low", F.lit(key))).orderBy("low").limit(5).collect()] if key else []
    return None, list(dict.fromkeys(close + inside))[:6]


def rule(must: dict[str, list[str]]) -> Column:
    """A relevance rule over records: role_family, country, company, skills_all, skills_any."""
    keys, out = F.transform("skills", canon), F.lit(True)
    wanted = lambda vs: F.array(*(canon(F.lit(v)) for v in vs))
    for name, values in must.items():
        out &= {
            "role_family": lambda v: F.col("role_family").isin(v),
            "country": lambda v: F.col("country").isin(v),
            "company": lambda v: F.lower("company").isin([x.lower() for x in v]),
            "skills_all": lambda v: F.size(F.array_except(wanted(v), keys)) == 0,
            "skills_any": lambda v: F.arrays_overlap(wanted(v), keys),
        }[name](values)
    return out


def lookup(listings: DataFrame, id_: int) -> DataFrame:
    """The record with this id; NotFound if there is none."""
    out = listings.where(F.col("id") == id_)
    if out.isEmpty():
        raise NotFound(id_)
    return out


def payload(listings: DataFrame) -> DataFrame:
    """Records as shown: empty strings of optional columns as nulls."""
    return listings.withColumns({c: F.nullif(c, F.lit("")) for c in ("location", "via", "salary_rate") if c in listings.columns})
