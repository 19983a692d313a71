"""Queries do the whole job: where their SQL is cut to a part, the same SQL without the cut gives all rows."""

from collections import Counter

import duckdb
import pandas as pd
import pytest

from sievewright.catalog import ORACLES, QUERIES, operations
from sievewright.functions.text import squeezed
from sievewright.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "customer lineitem nation orders part supplier".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame: pd.DataFrame) -> list:
    text = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", ["j06_gap", "k09_recommended"])
def test_all_profiles_and_queries(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert (got.profile_id >= 20).any() and got.query_id.nunique() > 1
    assert plain(got) == plain(duck.execute(ORACLES[name]).df())


def test_texts_of_any_characters_are_squeezed(spark):
    texts = spark.read.parquet(f"{SF}/conversations.parquet").select("text").collect()
    want = Counter(" ".join((r.text or "").split()) for r in texts)
    assert any(not t.isascii() for t in want)
    assert {r.text: r.n for r in QUERIES["e01_squeezed"](spark, SF).collect()} == want
    odd = [c.join(["", "é", "b", ""]) for c in map(chr, range(0x3100)) if c.isspace()] + ["\u200b a", "", None]
    got = spark.createDataFrame([(t,) for t in odd], "text string").select("text", squeezed("text").alias("s")).collect()
    assert [r.s for r in got] == [" ".join((r.text or "").split()) for r in got]


def test_transition_of_all_profiles(spark):
    got = {r.profile_id for r in QUERIES["c07_transition"](spark, SF).collect()}
    assert got == {r.profile_id for r in tables.profiles(spark, SF).collect()}


def test_significance_of_all_systems_seeds_and_trials(spark):
    assert operations.SEEDS == list(range(10))
    got = QUERIES["a16_significance_plain"](spark, SF).collect()
    assert {(r.system, r.metric) for r in got} == {(s, m) for s in ("keyword", "tfidf", "bm25") for m in ("p5", "ap5", "ndcg10")}
    assert all(abs(r.p * 10_001 - round(r.p * 10_001)) < 0.02 or r.p == 1 for r in got) and any(r.p < 1 for r in got)
