import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import awkward_rows, documents, words

from sievewright.llm import mixing


def by_resharing(sizes, weights):
    """The rule as stated: share by weight, cut at twice the size, reshare the excess until none is above."""
    out, total, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / w > 2 * sizes[i]]
        if not over:
            for i in open_:
                out[i] = total * weights[i] / w
            break
        for i in over:
            out[i] = 2.0 * sizes[i]
        total -= sum(2 * sizes[i] for i in over)
        open_ -= set(over)
    return out


def test_targets_are_the_fixed_point():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        sizes = [rng.choice([0, 1, 5, 1000, rng.randint(0, 10**6)]) for _ in range(n)]
        weights = [(3, 1, 2)[i % 3] for i in range(n)]
        assert np.allclose(mixing.targets(np.array(sizes), np.array(weights, float)), by_resharing(sizes, weights))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_and_inverse(n):
    i, size, key = np.arange(n), np.full(n, n), np.full(n, 77)
    p = mixing.permuted(i, size, key)
    assert sorted(p) == list(range(n))
    assert (mixing.permuted(p, size, key, back=True) == i).all()


@pytest.mark.parametrize("block", [3, 50, 256])
def test_totals(spark, block):
    rows = awkward_rows(11, 140) + [(7, "again the same id", "en", "s1", 1), (None, "no id at all", None, "s9", 1)]
    rows += [rows[2], rows[2]]
    docs = documents(spark, rows)
    got = mixing.Mix(docs, block=block).totals().collect()
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(len(words(r[1])) for r in rows if r[3] == s) for s in names]
    target = dict(zip(sizes, by_resharing(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    assert sorted((r[0] or -1, len(words(r[1]))) for r in rows) == sorted((r.doc_id or -1, r["size"]) for r in got)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    for size, t in target.items():
        assert abs(sum(r.taken for r in got if r.source_size == size) - t) <= 1
        assert all(abs(r.target - t) < 1e-6 * max(1, t) for r in got if r.source_size == size)
    again = mixing.Mix(docs.repartition(7), block=block).totals().collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_slots_by_brute_force(spark):
    """Words taken, slot by slot from the laid-out stream of each source."""
    rows = awkward_rows(12, 60)
    m = mixing.Mix(documents(spark, rows), block=20)
    stream = {}
    for p in sorted(m.places.where("size > 0").collect(), key=lambda p: (p.sid, p.start)):
        line = stream.setdefault(p.sid, [])
        assert p.start == len(line)
        line += [p.doc_id] * p["size"]
    want = {}
    slots = m.slots().collect()
    for s in slots:
        for d in stream[s.sid][s.block * 20 : s.block * 20 + s.upto]:
            want[d] = want.get(d, 0) + 1
    assert {r.doc_id: r.taken for r in m.totals().collect() if r.taken} == want
    for s in m.plan.itertuples():
        assert sorted(x.slot for x in slots if x.sid == s.sid) == list(range(s.slots))
        for turn in range(s.full):
            assert sorted(x.block for x in slots if x.sid == s.sid and x.turn == turn) == list(range(s.blocks))


def test_mixed_rows_hold_what_is_taken(spark):
    rows = awkward_rows(13, 80)
    rows += [rows[1], rows[1], (7, "again the same id", "en", "s1", 1)]
    docs = documents(spark, rows).select("*", *(F.lit(1).alias(c) for c in ("size", "start", "_id", "id", "Tie", "parts", "_runs", "_same", "sid")))
    out = mixing.mixed(docs, block=20)
    assert out.columns == docs.columns
    out = out.collect()
    taken = {}
    for r in mixing.Mix(docs, block=20).totals().collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    got = {}
    for r in out:
        assert r.n_chars == len(r.text)
        assert any(r.text in x[1] for x in rows if x[0] == r.doc_id and x[1])
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == {k: v for k, v in taken.items() if v}


def test_a_row_repeated_many_times_and_null_ids(spark):
    rows = [(5, "one two three four five", "en", "s1", 1)] * 900 + [(None, f"text {i} of no id", "en", "s1", 1) for i in range(300)] + [(i, "a b c d e f", "en", "s2", 1) for i in range(300)]
    m = mixing.Mix(documents(spark, rows), block=20)
    places = sorted((p.sid, p.start, p["size"]) for p in m.places.collect())
    assert len(places) == len(rows)
    for (a, x, n), (b, y, _) in zip(places, places[1:], strict=False):
        assert y == (x + n if a == b else 0)
    out = m.totals().collect()
    assert len(out) == len(rows) and abs(sum(r.taken for r in out) - 1.5 * sum(len(words(r[1])) for r in rows)) <= 2
    assert sum(len(words(r.text)) for r in mixing.mixed(documents(spark, rows), block=20).collect()) == sum(r.taken for r in out)


@pytest.mark.parametrize("span", [1, 3, 4096])
def test_running_sums_by_spans(spark, monkeypatch, span):
    monkeypatch.setattr(mixing, "SPAN", span)
    rng = random.Random(2)
    rows = [(g, o, rng.randint(0, 9)) for g in range(3) for o in rng.sample(range(400), 60)]
    got = mixing.summed_before(spark.createDataFrame(rows, "g long, o long, v long"), "g", "o", "v", "before").collect()
    assert sorted((r.g, r.o, r.before) for r in got) == sorted((g, o, sum(v for h, p, v in rows if h == g and p < o)) for g, o, _ in rows)


def test_empty(spark):
    assert mixing.Mix(documents(spark, [])).totals().count() == 0
    assert mixing.mixed(documents(spark, [(1, " ", "en", "s", 1), (2, None, None, None, 0)])).count() == 0
