import math
import random

import pytest
from pyspark.sql import functions as F
from util import awkward_rows, documents

from sievewright.llm import toxicity
from sievewright.llm.toxicity import Lexicon, fold


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("You IDIOT!", " you idiot "),
        ("1d1ot m0r0n l0$er", " idiot moron loser "),
        ("ѕtuріd", " stupid "),
        ("ｓｔｕｐｉｄ", " stupid "),
        ("i d i o t here", " i d i o t here idiot "),
        ("trash$$$ and 100 %", " trash and 100 "),
        ("Éan  vejuté", " ean vejute "),
        (None, "  "),
        ("", "  "),
    ],
)
def test_fold(text, want):
    assert fold(text) == want


def test_scores_by_hand():
    score = Lexicon({" idiot ": 3.0, " idio": 1.0, " trash ": 2.0}, ("trash can",), (-1.0, 1.0, 1.0)).matcher()
    low = score("")[0]
    assert score(None) == score("") and low < 0.5
    assert score("an idiot idiot")[1] == 2  # shared spaces, nested entries count once
    assert score("idiotic")[1] == 1
    assert score("a trash can")[1] == 0 and score("trash can trash")[1] == 1
    assert score("idiot " + "word " * 1000)[0] < score("idiot word")[0]


def brute(text, lexicon):
    t = fold(text)
    best = {}
    for k, w in lexicon.weights.items():
        at = t.find(k)
        while at >= 0:
            best[at] = max(best.get(at, 0), w)
            at = t.find(k, at + 1)
    for e in lexicon.exceptions:
        at = t.find(f" {e} ")
        while at >= 0:
            best = {s: w for s, w in best.items() if not at <= s < at + len(e) + 1}
            at = t.find(f" {e} ", at + 1)
    c, h, d = lexicon.scale
    x = c + h * math.log(1 + len(best)) + d * math.log(1 + 100 * sum(best.values()) / max(1, t.count(" ") - 1))
    return len(best), 1 / (1 + math.exp(-min(max(x, -30), 30)))


def test_learns_words_of_labelled_rows_only(spark):
    rng = random.Random(2)
    usual = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bad = ["zzqxa", "zzqxb", "zzqxc"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        w = [rng.choice(usual) for _ in range(40)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, "en", "s", 1), (5000, "", "en", "s", 1), (None, "zzqxa zzqxb zzqxc", None, None, 1)]
    docs = documents(spark, rows).select("*", F.lit(1).alias("score"), F.lit(1).alias("toxic"))
    table = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None), (8, 1, 1)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, table)
    assert any("zzqx" in k for k in lexicon.weights)
    got = toxicity.scored(docs, lexicon).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    import zlib

    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id != 5000:
            hits, score = brute(text[r.doc_id], lexicon)
            assert r.hits == hits and math.isclose(r.score, score, rel_tol=1e-12)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_neither_order_nor_repeated_rows_change_the_lexicon(spark):
    rng = random.Random(3)
    bad = ["qqrst", "qqruv", "zzwxy"]
    make = lambda i: " ".join(["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(25)] + (rng.choices(bad, k=4) if i % 3 == 0 else []))
    rows = [(i, make(i), "en", "s", 1) for i in range(200)]
    rows += [(i, make(i + 1), "en", "s", 1) for i in range(0, 90)] * 2
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] * 2, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    assert len({str(toxicity.learn(d, labels)) for d in (docs, docs.repartition(5))}) == 1


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, awkward_rows(14, 20) + [(800, "idiot scum moron", "en", "s", 1)])
    lexicon = toxicity.learn(docs, none)
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, lexicon).collect()}
    assert got[800] == 1 and sum(got.values()) == 1
    assert toxicity.scored(documents(spark, []), lexicon).count() == 0
