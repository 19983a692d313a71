import math
import random

import numpy as np
from pyspark.sql import functions as F
from util import awkward_rows, documents, words

from sievewright.llm import bayes

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    rows, good = [], {}
    for i in range(n):
        source = f"s{i % 5}"
        ok = rng.random() < (0.95 if i % 5 else 0.3)
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 80))]
        if not ok:
            w = [x + "###" for x in w] if i % 2 else [x for x in w[:12] for _ in range(5)]
        rows.append((i, " ".join(w), "en", source, 1))
        good[i] = ok
    return rows, good


def test_features_equal_plain_counts(spark):
    rows = awkward_rows(31, 60)
    for r in bayes.with_features(documents(spark, rows)).collect():
        w, f = words(r.text), r["_f"]
        low = [x.translate({c: c + 32 for c in range(65, 91)}) for x in w]
        n = max(1, len(w))
        want = [math.log1p(len(w)), sum(map(len, w)) / n, min(3, sum(c in "#*$%&|<>" for c in r.text or "") / n)]
        assert np.allclose(f[:3], want)
        assert np.isclose(f[5], sum(a == b for a, b in zip(low, low[1:], strict=False)) / n)
        assert np.isclose(f[6], sum("A" <= c <= "Z" for c in r.text or "") / max(1, sum(map(len, w))))


def test_held_out_accuracy_and_shrinkage(spark):
    rows, good = corpus()
    labels = spark.createDataFrame([(i, int(y), 0) for i, y in good.items() if i % 3], LABELS)
    extra = [(9000, "few words of one sparse site only here", "en", "rare", 1)]
    out = bayes.judged(documents(spark, rows + extra), labels).collect()
    held = [r for r in out if r.id < 9000 and r.id % 3 == 0]
    assert sum(r.kept == good[r.id] for r in held) >= 0.97 * len(held)
    rate = {r.host: r.host_rate for r in out}
    assert rate["s0"] < 0.6 < min(rate[s] for s in ("s1", "s2", "s3", "s4"))
    overall = np.mean([good[r[0]] for r in rows])
    assert abs(rate["rare"] - overall) < 0.15  # one text hardly moves its site from the corpus' rate


def test_rates_by_brute_force(spark):
    rows, good = corpus(200, 4)
    labels = spark.createDataFrame([(i, int(y), 0) for i, y in good.items()], LABELS)
    out = bayes.judged(documents(spark, rows), labels).collect()
    soft, host = {}, {}
    for r in out:
        soft.setdefault(r.host, []).append(round(1e6 / (1 + math.exp(-r.evidence))) / 1e6)
    n = sum(map(len, soft.values()))
    overall = (sum(map(sum, soft.values())) + 1) / (n + 2)

    def strength(groups):  # (n, good, rate)
        chance = sum(r * (1 - r) for _, _, r in groups)
        spread = sum((g / m - r) ** 2 - r * (1 - r) / m for m, g, r in groups)
        return max(2.0, min(1000.0, chance / spread - 1 if spread > 0 else 1000.0))

    k = strength([(len(v), sum(v), overall) for v in soft.values()])
    host = {s: (sum(v) + k * overall) / (len(v) + k) for s, v in soft.items()}
    k = strength([(len(v), sum(v), host[s]) for s, v in soft.items()])
    path = {s: (sum(v) + k * host[s]) / (len(v) + k) for s, v in soft.items()}
    for r in out:
        assert math.isclose(r.host_rate, host[r.host], rel_tol=1e-9) and math.isclose(r.path_rate, path[r.host], rel_tol=1e-9)
        p = path[r.host]
        assert math.isclose(r.score, 1 / (1 + math.exp(-r.evidence - math.log(p / (1 - p)))), rel_tol=1e-9)


def test_awkward_rows_labels_and_empty(spark, monkeypatch):
    names = ("rate", "n", "good", "host_rate", "e", "f", "F_", "id", "mark", "_f", "_host", "of_host", "rates", "host", "path", "text_")
    docs = documents(spark, awkward_rows(32, 50) * 2 + [(None, None, None, None, None)]).select("*", *(F.lit(1).alias(c) for c in names))
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0)], LABELS)
    for labels in (odd, odd.limit(0)):
        out = bayes.judged(docs, labels)
        kept = bayes.passed(docs, labels)
        assert out.count() == docs.count() and kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert bayes.passed(docs, odd.limit(0)).count() == docs.count()
    assert bayes.judged(documents(spark, []), odd).count() == 0 and bayes.passed(documents(spark, []), odd).count() == 0
    direct = sorted(map(str, bayes.passed(docs, odd).collect()))
    monkeypatch.setattr(bayes, "BROADCAST_ROWS", 0)
    assert sorted(map(str, bayes.passed(docs, odd).collect())) == direct


def test_repeated_ids_fit_the_same_model_in_any_order(spark):
    rows, good = corpus(120, 5)
    rows += [(r[0], r[1] + " and more of it ##", *r[2:]) for r in rows[:60]] * 3
    labels = spark.createDataFrame([(i, int(y), 0) for i, y in good.items()], LABELS)
    docs = documents(spark, rows)
    models = {str(bayes.fit(d, labels, sample=80)) for d in (docs, docs.repartition(5), docs.orderBy(F.desc("doc_id"), "text"))}
    assert len(models) == 1
