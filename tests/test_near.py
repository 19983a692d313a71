"""Near pairs: against all pairs, and without what they do not need."""

import random

from sievewright.catalog import QUERIES, ranking
from sievewright.operators import dedup
from sievewright.storage import Tables

SF = "/root/testdata/sf0.001"


def some_sets():
    rng, rows = random.Random(7), []
    for i in range(60):
        base = [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(rng.randint(1, 60))]
        for j in range(rng.randint(1, 5)):
            rows.append((10 * i + j, base[j % 3 :] + [f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 4))]))
    return [*rows, (9000, []), (9001, rows[5][1][::-1]), (9002, rows[5][1] * 2)]


def test_all_near_pairs_are_found(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HEAVY", 16)
    rows = some_sets()
    kinds = {}
    for i, terms in sorted(rows):
        kinds.setdefault(frozenset(terms), i)
    sets = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    for t in (0.5, 0.8):
        want = {(a, b): len(x & y) / len(x | y) for x, a in kinds.items() for y, b in kinds.items() if a < b and len(x & y) >= t * len(x | y)}
        got = {(r.a, r.b): r.jaccard for r in dedup.near_pairs(sets, t).collect()}
        assert len(want) > 20 and got == want


def test_sets_of_pairs_that_prefixes_rule_out_do_not_meet(spark, monkeypatch):
    """Sets of 40 terms that share two rare ones and little else: none of the pairs is left for a comparison of sets."""
    written, counts = Tables.written, []

    def spy(self, df):
        out = written(self, df)
        if "a" in df.columns:
            counts.append(out.count())
        return out

    monkeypatch.setattr(Tables, "written", spy)
    rng = random.Random(3)
    rows = [(i, [f"pair{i // 2} {k}" for k in range(2)] + [f"common {j}" for j in rng.sample(range(300), 38)]) for i in range(100)]
    sets = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    assert dedup.near_pairs(sets, 0.8).count() == 0
    assert counts[0] >= 50 and counts[-1] == 0


def test_no_index_is_built_for_near_pairs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("the index of texts is not needed")

    monkeypatch.setattr(ranking, "text_index", refuse)
    assert QUERIES["x10_near_pairs"](spark, SF).count() and QUERIES["x10_near_groups"](spark, SF).count() and QUERIES["x10_kinds"](spark, SF).count()
