"""Queries on profiles make only what they read."""

from sievewright.catalog import QUERIES, career, registry
from sievewright.operators import analyze, fit
from sievewright.plans import transition
from sievewright.sources import tables

SF = "/root/testdata/sf0.001"


def test_compared_records_need_no_search(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("nothing is searched")

    monkeypatch.setattr(career, "_Scored", refuse)
    got = QUERIES["c10_compared"](spark, SF).collect()
    assert len(got) == 3 * tables.profiles(spark, SF).count() and any(r.role for r in got)


def test_a_role_of_many_profiles_is_scored_once(spark, monkeypatch):
    ix, asked, plain = registry.catalog_index(spark, SF), [], analyze.query_words
    monkeypatch.setattr(analyze, "query_words", lambda q, *a, **k: asked.append(q.count()) or plain(q, *a, **k))
    title = ix.listings.orderBy("id").first().title
    people = spark.createDataFrame([(i, title if i % 2 else None) for i in range(40)] + [(50, "of no title")], "profile_id long, role string")
    page = ix.listings.orderBy("id").limit(3).selectExpr("id doc_id")
    got = transition.role_similarity(ix, people, page).collect()
    assert asked == [2] and {r.profile_id for r in got} == set(range(1, 40, 2))
    assert len({(r.doc_id, r.role) for r in got}) * 20 == len(got) and max(r.role for r in got) > 0.999


def test_keys_of_profiles_are_those_of_normalized_ones(spark):
    rows = [(1, "a", ["SQL", " sql ", "Power-BI", "", None, "PowerBI", "r", "golang", "Go"]), (2, " ", []), (3, None, None)]
    people = spark.createDataFrame(rows, "profile_id long, role string, skills array<string>")
    want = {r.profile_id: (r.role, r.skills and [s.key for s in r.skills]) for r in fit.normalized_profiles(people).collect()}
    out = fit.keyed_profiles(people)
    assert out.columns == people.columns and {r.profile_id: (r.role, r.skills) for r in out.collect()} == want
    assert want[1] == ("a", ["sql", "power bi", "r", "go"])
    # the key of a skill stands once in the plan, in no function of a function
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_position") == 0
