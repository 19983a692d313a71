import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from util import awkward_rows, documents, words

from sievewright.llm import jaccard, textkernel

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, num, den):
    sets = [shingles(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        m = len(sets[i] & sets[j])
        if m and den * m >= num * (len(sets[i]) + len(sets[j]) - m):
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in g]
    return groups.values(), out


key = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize(("size", "num", "den", "seed"), [(4, 85, 100, 1), (5, 80, 100, 2), (2, 50, 100, 3)])
def test_components_equal_brute_force(spark, size, num, den, seed):
    rows = awkward_rows(seed, 130)
    rows += [(3, rows[3][1], "en", "s", 1), (5, rows[9][1], "en", "s", 1), (None, rows[0][1], "en", "s", 1), (None, "only here and nowhere else", None, None, 1)]
    got = [tuple(r)[:3] for r in jaccard.jaccard_components(documents(spark, rows), size=size, num=num, den=den).collect()]
    want = brute(rows, size, num, den)[1]
    assert sorted(got, key=key) == sorted(want, key=key)


def tight(monkeypatch, bytes_=0):
    """Every way of dealing out taken on small tables."""
    for name, value in (("HOT_PAIRS", 2), ("HOT_BYTES", bytes_), ("BUSY", 2), ("HEAVY", 4), ("SEEN", 5)):
        monkeypatch.setattr(jaccard, name, value)


@pytest.mark.parametrize(("size", "num", "den", "bytes_"), [(4, 85, 100, 0), (5, 80, 100, 1 << 20), (1, 60, 100, 0)])
def test_components_where_all_is_hot(spark, monkeypatch, size, num, den, bytes_):
    tight(monkeypatch, bytes_)
    rows = awkward_rows(21, 130) + [(None, "a b c d e f", "en", "s", 1)] * 3
    got = [tuple(r)[:3] for r in jaccard.jaccard_components(documents(spark, rows), size=size, num=num, den=den).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, size, num, den)[1], key=key)


@pytest.mark.parametrize("hot", [False, True])
def test_members_of_one_group_that_differ(spark, monkeypatch, hot):
    """Equal prefixes and sizes, in clusters on both sides of the threshold, some of them joined by a chain."""
    if hot:
        tight(monkeypatch)
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(900)}, key=lambda w: int(jaccard._sets(pa.array([w]), 1).__next__()[1][0]))
    first, rest = names[:40], names[200:]
    rows = []
    for c in range(6):
        base = rng.sample(rest, 60)
        for _ in range(9):
            w = list(base)
            for _ in range(rng.choice([0, 2, 6, 9])):
                w[rng.randrange(60)] = rng.choice(rest)
            w = list(dict.fromkeys(w))
            w += rng.sample([x for x in rest if x not in w], 60 - len(w))
            rows.append((len(rows), " ".join(first + w), "en", "s", 1))
    near = rows[0][1].split()
    for k in range(12):  # a chain away from the first
        near = near[: 99 - 3 * k] + rng.sample([x for x in rest if x not in near], 3) + near[102 - 3 * k :] if k else near
        rows.append((len(rows), " ".join(near[:100]), "en", "s", 1))
    groups, want = brute(rows, 1, 85, 100)
    assert 3 < len(groups) < 40
    asked = []
    real = jaccard.side_by_side
    monkeypatch.setattr(jaccard, "frequency_classes", lambda *a: np.zeros(jaccard.CELLS, np.uint8))  # hashes alone order shingles
    monkeypatch.setattr(jaccard, "side_by_side", lambda *a: asked.append(1) or real(*a))
    got = [tuple(r)[:3] for r in jaccard.jaccard_components(documents(spark, rows), size=1).collect()]
    assert asked and sorted(got, key=key) == sorted(want, key=key)


def test_near_copies_without_ids_link_other_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    text = lambda k: " ".join(base[:k] + ["x"] + base[k + 1 :])
    rows = [(None, text(60), "en", "s", 1), (None, text(60), "en", "s", 1), (4, text(10), "en", "s", 1), (9, text(110), "en", "s", 1)]
    got = [tuple(r)[:3] for r in jaccard.jaccard_components(documents(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 4, 85, 100)[1], key=key)
    assert {r[2] for r in got} == {4}


def test_one_of_each_group_stays(spark):
    rows = awkward_rows(4, 110)
    rows += [rows[0], (None, rows[0][1], "en", "s", 1), (None, "only here and nowhere else", None, None, 1)]
    docs = documents(spark, rows)
    got = jaccard.near_duplicates_removed(docs)
    assert got.columns == docs.columns
    kept = [tuple(r)[:2] for r in got.collect()]
    want = []
    for g in brute(rows, 5, 80, 100)[0]:
        members = [rows[i] for i in g]
        if not words(members[0][1]):
            want += [m[:2] for m in members]
        else:
            least = min((m[0] is None, m[0] or 0) for m in members)
            want.append(next(m[:2] for m in members if (m[0] is None, m[0] or 0) == least))
    ids = lambda x: sorted((k[0] is None, k[0] or 0) for k in x)
    assert ids(kept) == ids(want)


def test_empty_table_and_clashing_columns(spark):
    docs = documents(spark, [])
    assert jaccard.jaccard_components(docs).count() == 0
    assert jaccard.near_duplicates_removed(docs).count() == 0
    from pyspark.sql import functions as F

    extra = documents(spark, awkward_rows(5, 20)).select("*", *(F.lit(1).alias(c) for c in ("n", "class", "grp", "token", "pos", "comp", "a", "b", "mark", "_id", "_mark", "id", "Mark_")))
    assert jaccard.near_duplicates_removed(extra).columns == extra.columns
    assert jaccard.jaccard_components(extra).count() == extra.count()


def test_kernel_words_match_pattern():
    texts = [r[1] for r in awkward_rows(6, 60)]
    got = {}
    for chunk in textkernel.words(pa.array(texts)):
        for i in range(len(chunk.first) - 1):
            a, b = chunk.first[i], chunk.first[i + 1]
            got[chunk.row + i] = [bytes(chunk.raw[s:e]).decode() for s, e in zip(chunk.start[a:b], chunk.end[a:b], strict=True)]
    assert [got[i] for i in range(len(texts))] == [words(t) for t in texts]
