"""Operators on literals whose results are known, and invariants on the catalog."""

import math

import pytest
from pyspark.sql import functions as F

from sievewright.config import Ranking
from sievewright.errors import NotFound, QueryError
from sievewright.functions import skills as S
from sievewright.functions import text as T
from sievewright.functions.stem import stem
from sievewright.operators import analyze, dedup, etl, evaluate, filters, fit, index, rank, resume, score, stats
from sievewright.operators.index import Index
from sievewright.plans import evaluation, search, transition


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    titles = ["Cloud Architect", "Data Engineer", "Data Analyst, Senior", "IT Support", "Cloud Engineer"]
    pools = [["AWS", "Terraform", "Kubernetes"], ["Python", "SQL", "Spark"], ["SQL", "Power BI", "excel"], ["windows", "linux"], ["aws", "python", "K8s"]]
    for i in range(60):
        k = i % 5
        rows.append((i, titles[k], f"Firm {i % 4}", ["Berlin", "Paris", ""][i % 3], ["Germany", "France", "Unknown"][i % 3], "Remote" if i % 2 else "Not remote", ["Full-time", "Contractor", "Not stated"][i % 3], titles[k].split(",")[0], pools[k][: 1 + i % 3], f"2024-01-{1 + i % 28:02d}", float(i), 1))
    df = spark.createDataFrame(rows, "id long, title string, company string, location string, country string, workplace string, schedule string, role_family string, skills array<string>, posted string, salary_year double, listings long")
    return df.withColumn("posted", F.to_date("posted")).cache()


@pytest.fixture(scope="module")
def ix(records):
    ix = Index.build(records)
    for t in (ix.zoned, ix.tf, ix.terms, ix.posts):
        t.cache()
    return ix


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, query string")


def one(df):
    return df.collect()[0][0]


def test_tokens_and_folding(spark):
    df = spark.createDataFrame([("Wrocław IT Support æß",)], "t string")
    assert one(df.select(T.fold(F.col("t")))) == "Wroclaw IT Support aess"
    assert one(df.select(T.terms(F.lit("IT Support")))) == ["it", "support"]
    assert one(df.select(T.terms(F.lit("the data analyst job in Berlin"), query=True))) == ["data", "analyst", "berlin"]
    assert one(df.select(T.segment_terms(F.lit("Berlin, Berlin, Germany"), True))) == ["berlin", "berlin", "germany"]
    assert one(df.select(T.biwords(F.array(F.lit("a"))))) == []
    assert [stem(w) for w in ("engineers", "running", "relational", "skies", "caresses", "hopping", "agreed", "happy", "generalization", "controlling")] == ["engin", "run", "relat", "sky", "caress", "hop", "agre", "happi", "gener", "control"]


def test_toy_index(spark):
    zoned = spark.createDataFrame([("flat", 0, ["a", "b"]), ("flat", 1, ["a"]), ("flat", 2, ["c", "c"])], "zone string, doc_id long, terms array<string>")
    tf = index.term_frequencies(zoned)
    d = {r.term: (r.df, r.idf) for r in index.dictionary(tf, 3).collect()}
    assert {k: v[0] for k, v in d.items()} == {"a": 2, "b": 1, "c": 1} and math.isclose(d["b"][1], math.log10(3))
    w = {(r.doc_id, r.term): r.dw for r in index.postings(tf, index.dictionary(tf, 3)).collect()}
    assert math.isclose(w[2, "c"], 1) and math.isclose(w[0, "a"] ** 2 + w[0, "b"] ** 2, 1)
    assert {(r.doc_id, r.doc_len) for r in index.lengths(tf).collect()} == {(0, 2), (1, 1), (2, 2)}


def test_cosine_equals_brute_force_and_explanations_add_up(spark, ix):
    s = search.Search(ix, queries(spark, "cloud architect aws", "data engineer python berlin", "remote contractor"))
    posts = {}
    for r in ix.posts.collect():
        posts.setdefault((r.zone, r.doc_id), {})[r.term] = r.dw
    shares = {(r.query_id, r.zone): r.share for r in score.zone_weights(s.vectors, s.cfg).collect()}
    want = {}
    for q in s.vectors.collect():
        for (zone, doc), terms in posts.items():
            if zone == q.zone and q.term in terms:
                want[q.query_id, doc] = want.get((q.query_id, doc), 0) + shares[q.query_id, zone] * q.qw * terms[q.term]
    got = {(r.query_id, r.doc_id): r for r in s.scores.collect()}
    assert got.keys() == want.keys() and all(abs(got[k].cosine - v) < 1e-12 for k, v in want.items())
    assert all(-1e-12 <= r.score <= 1 + 1e-12 for r in got.values())
    parts = {}
    for r in score.contributions(s.vectors, ix.posts, ix.terms).collect():
        parts[r.query_id, r.doc_id] = parts.get((r.query_id, r.doc_id), 0) + r.contribution
    assert all(abs(parts[k] - got[k].cosine) < 1e-12 for k in parts)


def test_champions_and_elimination_touch_fewer_postings(spark, ix):
    s = search.Search(ix, queries(spark, "data engineer"))
    whole = score.cosine(s.vectors, ix.posts).count()
    assert score.cosine(s.vectors, ix.posts, champion=index.champions(ix.posts, 3)).count() < whole
    assert score.cosine(s.vectors, ix.posts, min_idf_ratio=0.99, terms=ix.terms).count() <= whole


def test_search_filters_and_errors(spark, ix, records):
    out = search.search(ix, "cloud architect", 5, wanted={"workplace": ["Remote"], "country": []})
    rows = out.collect()
    assert rows and all(r.workplace == "Remote" for r in rows) and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    assert all(r.reasons for r in rows)
    newest = search.search(ix, "", 4, wanted={"company": ["firm 1"]}).collect()
    assert [r.posted for r in newest] == sorted((r.posted for r in newest), reverse=True)
    for call in (lambda: search.search(ix, ""), lambda: search.search(ix, "x" * 501), lambda: search.search(ix, "a", wanted={"colour": ["red"]}), lambda: search.search(ix, "a", wanted={"company": ["Firm 11"]}), lambda: search.search(ix, "a", 51)):
        with pytest.raises(QueryError):
            call()
    with pytest.raises(QueryError, match="Firm 1"):
        filters.check_values(records, {"company": ["Firm 1x"]})
    assert filters.resolve_company(records, "FIRM 2") == ("Firm 2", [])
    with pytest.raises(NotFound):
        search.similar(ix, 999)
    with pytest.raises(ValueError):
        Ranking().override(w_cosine=2.0)
    assert Ranking().override(zone_weights={"Title": 0.1, "No": 1}).zone_weights["Title"] == 0.1


def test_unknown_words_get_suggestions(spark, ix):
    s = search.Search(ix, queries(spark, "architct clod"))
    vocabulary = [r.term for r in ix.terms.where("zone = 'Title'").select("term").collect()]
    got = {r.word: r.suggestions for r in analyze.close_words(analyze.unknown_words(s.words, ix.terms, s.skills), vocabulary).collect()}
    assert "architect" in got["architct"] and "cloud" in got["clod"]


def test_rankings(spark, ix):
    s = search.Search(ix, queries(spark, "data engineer", "cloud"))
    top, spread = rank.top_k(s.scores, 20).collect(), s.ranked(5).collect()
    best = {}
    for r in top:
        best.setdefault(r.query_id, []).append(round(r.score, 12))
    for q in (1, 2):
        mine = sorted((r for r in spread if r.query_id == q), key=lambda r: r["rank"])
        assert [round(r.score, 12) for r in mine] == best[q][:5]  # with epsilon 0 only ties change places
    assert s.baseline("bm25", 3).count() == 6 and s.baseline("tfidf_jaccard", 3).count() == 6
    sets = index.term_sets(ix.zoned)
    pure = rank.mmr(rank.top_k(s.scores, 20), sets, 5, 1.0).collect()
    assert {(r.query_id, r["rank"], r.doc_id) for r in pure} == {(r.query_id, r["rank"], r.doc_id) for r in top if r["rank"] <= 5}
    assert {r.seed for r in rank.many_seeds(s.scores, [1, 2], 3).collect()} == {1, 2}
    near = search.similar(ix, 0, 3).collect()
    assert near and all(r.doc_id != 0 for r in near)
    assert set(s.trace(3)) >= {"words", "routed", "vectors", "terms", "unknown", "before", "after", "stats", "top_bm25"}


def test_skill_names(spark):
    names = spark.createDataFrame([("PowerBI",), ("Power-BI",), ("K8s",), ("Amazon Web Services",)], "n string")
    assert [r[0] for r in names.select(S.canon(F.col("n"))).collect()] == ["power bi", "power bi", "kubernetes", "aws"]
    v = S.Vocabulary.of([("aws", "cloud"), ("power bi", "analyst_tools"), ("go", "programming"), ("word", "other"), ("sql", "programming"), ("power bi", "other")])
    assert {s["key"] for s in v.extract("We go in a word: SQL and PowerBI on Amazon Web Services.", "t")} == {"sql", "power bi", "aws"}
    got = {s["key"]: s["status"] for s in v.listed(["AWS cloud infrastructure, Go; Cooking (baking, SQL)"], "typed")}
    assert got == {"aws cloud infrastructure": "custom", "aws": "dataset", "go": "dataset", "cooking": "custom", "baking": "custom", "sql": "dataset"}
    assert S.top_level_items("a, b (c, d); e | f") == ["a", "b (c, d)", "e", "f"]
    glued = S.Vocabulary.of([("google cloud", "x"), ("power bi", "y"), ("node.js", "z"), ("golang", "w"), ("mysql", "q")])
    found = lambda t: [(s["name"], s["key"]) for s in glued.extract(t, "t")]
    assert found("GoogleCloud, power-bi and Google /\n Cloud Platform") == [("Google /\n Cloud Platform", "gcp"), ("power-bi", "power bi")]
    assert found("my mysql, my-sql; end.mysql x+mysql mysql+ amysql") == [("mysql", "mysql")]  # no joiner inside a word; not after a full stop
    assert found("golang and node.js. node.jsx") == [("node.js", "node.js")]  # "go" is an ordinary word, and so is what stands for it
    df = names.limit(1).select(v.extracted(F.lit("sql here")).alias("x"), v.from_lists(F.array(F.lit("SQL"))).alias("y")).collect()[0]
    assert df.x[0].key == "sql" and df.y[0].type == "programming"


def test_fit_and_transition(spark, ix, records):
    people = spark.createDataFrame([(1, "Cloud Architect", ["AWS", "Terraform", "kubernetes"]), (2, "Cloud Architect", ["aws cloud"]), (3, "", [" Cooking ", "cooking"]), (4, " ", [])], "profile_id int, role string, skills array<string>")
    out = transition.transition(ix, people, "Cloud Architect", "Firm 0", 5)
    match = {r.profile_id: r.match for r in out["match"].collect()}
    assert match[1] == 1.0 and match[1] > match[2] > match[3] == 0 and 4 not in match
    req = out["requirements"].collect()
    assert req and all(0.1 <= r.prevalence <= 1 for r in req)
    plan = [r for r in out["plan"].collect() if r.profile_id == 2]
    assert [r.position for r in plan] == list(range(1, len(plan) + 1)) and all("%" in r.why for r in plan)
    assert {r.mine for r in out["extra"].collect() if r.profile_id == 3} == {"cooking"}
    assert all(r.fit <= 1 for r in out["recommended"].collect()) and out["companies"].count() and out["closest"].count()
    assert out["role_present"].collect()[0].present is True
    with pytest.raises(QueryError):
        transition.transition(ix, people, " ")
    with pytest.raises(QueryError):
        transition.transition(ix, people, "x", "Nobody")
    shown = transition.attach_fit(ix, people.withColumn("skills", F.filter("skills", lambda s: s != "")), rank.top_k(search.Search(ix, queries(spark, "cloud")).scores, 2))
    assert {r.message for r in shown.collect() if r.profile_id == 4} == {fit.NO_PROFILE}
    assert {r.key for r in search.compare(ix, [0, 5]).collect()} >= {"aws"}
    with pytest.raises(QueryError):
        search.compare(ix, [1])


def test_covers_whole_words(spark):
    pairs = [("c++ developer", "c++", True), ("aws cloud infrastructure", "aws", True), ("aws", "aws cloud", False), ("r studio", "r", False), ("r", "r", True), ("node js", "node.js", False), ("", "", True), ("x", "", False)]
    df = spark.createDataFrame(pairs, "mine string, wanted string, yes boolean")
    assert df.select(S.covers(F.col("mine"), F.col("wanted")) == F.col("yes")).distinct().collect() == [(True,)]


def test_settings_of_a_request():
    base = Ranking()
    assert base.override(w_jaccard=None, zone_weights={"Title": 0.9, "Nowhere": 1, "Skills": None}).zone_weights == {**base.zone_weights, "Title": 0.9}
    assert base.override() == base and base.override(w_jaccard=0.0).w_jaccard == 0
    for wrong in ({"w_cosine": 2}, {"w_cosine": 0, "w_jaccard": 0}, {"zone_weights": dict.fromkeys(base.zone_weights, 0)}):
        with pytest.raises(ValueError):
            base.override(**wrong)
    with pytest.raises(TypeError):
        base.override(speed=1)


def test_one_record_explained_and_records_compared(spark, ix):
    people = spark.createDataFrame([(1, "Cloud Architect", ["AWS"]), (2, " ", [])], "profile_id int, role string, skills array<string>")
    out = transition.explained(ix, 0, "cloud architect", people)
    assert out["record"].first().id == 0 and out["evidence"].count() and out["similar"].count()
    fits = {r.profile_id: r for r in out["fit"].collect()}
    assert 0 < fits[1].fit <= 1 and fits[2].message == fit.NO_PROFILE and fits[2].fit is None
    prep = out["preparation"].collect()
    lacks = {k for (k,) in fit.record_skills(ix.listings.where("id = 0")).select("key").collect()} - {"aws"}
    assert {(r.profile_id, r.key) for r in prep} == {(1, k) for k in lacks}
    order = sorted(prep, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(1, len(prep) + 1)) and [r.prevalence for r in order] == sorted((r.prevalence for r in prep), reverse=True)
    shared, each = transition.compared_fit(ix, people, [0, 5])
    assert {r.key for r in shared.collect()} >= {"aws"} and {(r.profile_id, r.doc_id) for r in each.collect()} == {(p, d) for p in (1, 2) for d in (0, 5)}
    shown = search.search(ix, "cloud architect", 3).collect()
    assert all(0 <= r.flat_cosine <= 1 + 1e-9 for r in shown) and any(r.flat_cosine > 0 for r in shown)
    meta = {r.name: r.value for r in search.meta(ix).collect()}
    assert meta["listings"] == 60 and meta["vocabulary Title"] > 0 and meta["filter company"] > 0
    assert set(search.Search(ix, queries(spark, "clowd")).summary()) == {"words", "skills", "routed", "terms", "suggestions"}


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, d, i) for i, d in enumerate([1, 9, 2, 8, 7, 3], 1)], "query_id int, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 3, 2), (1, 4, 1)], "query_id int, doc_id long, grade int")
    m = evaluate.metrics(ranked, qrels, ["query_id"]).collect()[0]
    assert math.isclose(m.p5, 0.4) and math.isclose(m.r5, 2 / 3) and math.isclose(m.ap5, (1 + 2 / 3) / 3) and m.mrr == 1
    many = spark.createDataFrame([(1, i, 2) for i in range(1000)], "query_id int, doc_id long, grade int")
    assert evaluate.recall_ceiling(many).collect()[0].ceiling == 0.005
    same = spark.createDataFrame([(i, 0.0) for i in range(10)], "query_id int, diff double")
    assert evaluate.sign_flip(same, [], 200).collect()[0].p == 1
    clear = spark.createDataFrame([(i, 0.5 + i / 100) for i in range(10)], "query_id int, diff double")
    assert 0 < evaluate.sign_flip(clear, [], 500).collect()[0].p < 0.2


def test_evaluation_runs(spark, ix, monkeypatch):
    judged = [{"id": 1, "must": {"role_family": ["Cloud Architect"]}}, {"id": 2, "must": {"skills_any": ["sql"]}, "should": {"skills_all": ["python"]}}]
    qs = queries(spark, "cloud architect", "data engineer sql")
    qrels = evaluation.judged_grades(ix.listings, judged)
    scores = evaluation.scored_systems(ix, qs, qrels, [0], systems=("keyword", "hybrid")).cache()
    assert scores.count() == 4
    test = evaluation.significance(scores, others=("keyword",), names=("p5",), trials=50).collect()
    assert len(test) == 1 and 0 < test[0].p <= 1
    monkeypatch.setattr(evaluation, "ABLATIONS", {"no_jaccard": {"w_jaccard": 0.0}})
    ab = {r.variant: r for r in evaluation.ablations(ix, qs, qrels, [0]).collect()}
    assert set(ab) == {"full", "no_jaccard"} and ab["full"].d_p5 == 0
    monkeypatch.setattr(evaluation, "TITLE_WEIGHTS", (0.2, 0.45))
    sens = {r.title_weight: r for r in evaluation.sensitivity(ix, qs, qrels, [0, 1]).collect()}
    share = 0.55 / (0.30 + 0.15 + 0.40 + 0.10)
    cfg = Ranking(zone_weights={"Title": 0.45, "Skills": 0.30 * share, "Location": 0.15 * share, "Company": 0.40 * share, "WorkType": 0.10 * share})
    want = evaluate.means(evaluation.scored_systems(ix, qs, qrels, [0, 1], cfg, ("hybrid",)), ["system"], list(evaluation.METRICS)).first()
    assert set(sens) == {0.2, 0.45} and all(math.isclose(sens[0.45][m], want[m], abs_tol=1e-12) for m in evaluation.METRICS)
    full = [{"query": t, "type": y, "split": z} | q for q, t, y, z in zip(judged, ("cloud architect", "data engineer sql"), "ab", ("dev", "test"), strict=True)]
    out = evaluation.run(ix, [q | {"id": str(q["id"])} for q in full], [0, 1], 50)
    assert {(r.system, r.queries) for r in out["systems"].collect()} == {(s, 2) for s in evaluation.SYSTEMS}
    assert {(r.system, r.split) for r in out["by_split"].collect()} == {(s, x) for s in evaluation.SYSTEMS for x in ("dev", "test")}
    assert {r.split for r in out["significance"].collect()} == {"all", "dev", "test"} and out["by_type"].count() == 10 and out["recall_ceiling"].count() == 2


def test_near_duplicate_groups(spark):
    rows = [(i, [f"w{j}" for j in range(20)] + [f"x{i}"]) for i in range(5)] + [(10, ["solo"]), (11, []), (12, ["w0", "w1"]), (20, ["a", "b", "c"]), (21, ["c", "b", "a", "a"])]
    sets = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    groups = {}
    for r in dedup.groups(dedup.near_pairs(sets, 0.8), dedup.members(sets)).collect():
        groups.setdefault(r.group_id, set()).add(r.doc_id)
    assert groups == {0: {0, 1, 2, 3, 4}, 20: {20, 21}}
    assert {(r.a, r.b) for r in dedup.near_pairs(sets, 0.8).collect()} == {(a, b) for a in range(5) for b in range(a + 1, 5)}
    assert {(r.doc_id, r.kind) for r in dedup.members(sets).collect()} == {(i, i) for i in (0, 1, 2, 3, 4, 10, 12, 20)} | {(21, 20)}


def test_near_duplicates_of_many_copies_and_long_chains(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HEAVY", 4)
    words = [f"w{j}" for j in range(300)]
    chain = [(1000 - i, words[2 * i : 2 * i + 40]) for i in range(90)]  # each near the next only; labels have a long way to go
    rows = chain + [(2000 + i, ["same", "terms", "here"]) for i in range(500)]
    sets = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    pairs = dedup.near_pairs(sets, 0.9)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1000 - i - 1, 1000 - i) for i in range(89)}
    got = {r.doc_id: r.group_id for r in dedup.groups(pairs, dedup.members(sets)).collect()}
    assert got == {1000 - i: 911 for i in range(90)} | {2000 + i: 2000 for i in range(500)}


def test_etl(spark, records):
    sample = etl.stratified_sample(records, F.col("title").rlike(etl.FAMILY), "role_family", 3, "id")
    assert sample.where("title like 'Cloud%'").count() == 24 and sample.count() == 24 + 9
    assert etl.numbered(records, ["title", "company"], "id").where("position < 0 or position > 59").count() == 0
    merged = etl.merged_reposts(records.withColumn("title", F.when(F.col("id") % 2 == 0, F.upper("title")).otherwise(F.col("title"))), ["title", "company"], "id")
    assert merged.agg(F.sum("listings")).first()[0] == 60 and merged.where("id = 0").first().title == "CLOUD ARCHITECT"
    assert stats.totals(records).first().with_salary == 59
    raw = spark.createDataFrame([("Data  Engineer", "via X", "['SQL', 'sql']", "2024-01-02 03:04:05", "True")], "job_title string, job_via string, job_skills string, job_posted_date string, job_work_from_home string")
    for c in ("company_name", "job_location", "job_country", "job_schedule_type", "salary_rate", "job_title_short", "salary_year_avg", "salary_hour_avg", "job_no_degree_mention", "job_health_insurance"):
        raw = raw.withColumn(c, F.lit("x"))
    r = etl.scrubbed(raw).first()
    assert (r.title, r.via, r.skills, r.posted, r.workplace, r.salary_year) == ("Data Engineer", "X", ["sql"], "2024-01-02", "Remote", None)


RESUME = """Jane Doe
Cloud Engineer - Acme
Summary
Builder of things
Skills
Cloud: AWS, Azure,
Terraform
- Power BI (DAX)
Experience
Senior Cloud Engineer at Acme  Jan 2020 - Dec 2021
Analyst  2022 - present
Education
BSc SQL 2010 - 2014
"""


def test_resume(spark):
    v = S.Vocabulary.of([("aws", "cloud"), ("azure", "cloud"), ("terraform", "other"), ("power bi", "tools"), ("sql", "programming")])
    texts = spark.createDataFrame([(1, RESUME), (2, "Department: People Ops\n7+ years of experience"), (3, None)], "resume_id int, text string")
    got = {r.resume_id: r for r in resume.parsed(texts, v, "2024-01-01").collect()}
    assert got[1].role == "Senior Cloud Engineer" and got[1].years == 4.0 and got[1].department == "Cloud & DevOps"
    assert {s.key for s in got[1].skills} == {"aws", "azure", "terraform", "power bi", "dax"} and got[1].warnings == []
    assert got[2].years == 7.0 and got[2].department == "People Ops" and got[2].department_source == "stated in the resume"
    assert len(got[3].warnings) == 4 and got[1].sections == ["summary", "skills", "experience", "education"] and got[2].sections == []
    assert resume.section_items("Cloud: AWS,\nAzure (a, b)\n- x: one two\nlong line that goes on for more than six words\nshort one") == (["AWS", "Azure (a, b)", "one two", "short one"], ["long line that goes on for more than six words"])
    odd = spark.createDataFrame([("ﬁne\u00a0text •  x\ny-\nz\x07\n\n\n\nend \u3000",)], "t string")
    assert odd.select(resume.cleaned(F.col("t"))).first()[0] == "fine text - x\nyz \n\nend"
    files = spark.createDataFrame([(1, 2048, RESUME, 2, None), (2, 10, None, None, "not_pdf")], "path int, size long, text string, pages int, error string").withColumn("path", F.concat(F.lit("/a/"), F.col("path").cast("string"), F.lit(".pdf")))
    profiles = resume.parsed(files.where("error is null").select(F.col("path").alias("resume_id"), "text"), v, "2024-01-01")
    log = {r.path: r.steps for r in resume.steps(files, profiles).collect()}
    assert [(s.step, s.ok) for s in log["/a/1.pdf"]] == [("upload", True), ("text", True), ("profile", True)] and log["/a/1.pdf"][0].detail == "1.pdf, 2 KB"
    assert "Senior Cloud Engineer; 4 known skills, 1 others" in log["/a/1.pdf"][2].detail
    assert [(s.step, s.ok, s.detail) for s in log["/a/2.pdf"]][1:] == [("text", False, "not_pdf")]
    held = {r.section: r.body for r in resume.sections(texts.where("resume_id = 1")).collect()}
    assert set(held) == {"header", "summary", "skills", "experience", "education"}
