from functools import reduce
from operator import add, mul

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import neighbours

KIND = "vec_id long, embedding array<float>"


def exact(rows, k):
    """All rows against all queries; products added up in the order of components."""
    good = [(i, list(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max(len(v) for _, v in good)
    ids = np.array([i for i, _ in good])
    x = np.array([v + [0.0] * (dim - len(v)) for _, v in good])
    out = {}
    for i, q in {(i, tuple(v)) for i, v in zip(ids.tolist(), x.tolist(), strict=True) if i % 20 == 0}:
        s = [reduce(add, map(mul, v, q)) for v in x.tolist()]  # sum() would correct its rounding
        out[i] = sorted(((-t, j) for t, j in zip(s, ids.tolist(), strict=True) if j != i))[:k]
    return {i: [(j, -t) for t, j in line] for i, line in out.items()}


@pytest.mark.parametrize(("seed", "scale", "kind"), [(1, False, "float"), (2, True, "double"), (3, True, "float")])
def test_recall_exact_scores_and_ties(spark, monkeypatch, seed, scale, kind):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 100)
    monkeypatch.setattr(neighbours, "UNIT_ROWS", 150)
    monkeypatch.setattr(neighbours, "UNIT_QUERIES", 20)
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.4 * rng.standard_normal((900, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    if scale:
        x *= rng.uniform(0.3, 3, (900, 1))
    x = x.astype(np.float32 if kind == "float" else np.float64)
    x[100:420] = x[100]  # a third of all rows alike, in several units
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [None] + [1.0] * 15), (1080, [float("nan")] * 16), (1100, [float("inf")] * 16)]
    rows += [(1120, [1.0] * 3), (1121, [0.5, -0.5]), rows[5], rows[40], rows[41]] + odd + [(None, rows[3][1])]
    df = spark.createDataFrame(rows, KIND.replace("float", kind)).select("*", *(F.lit(1).alias(c) for c in ("v", "leaf", "score", "row", "query", "unit", "y")))
    got = {}
    for r in neighbours.nearest(df, "vec_id % 20 = 0").collect():
        assert r.rank not in got.setdefault(r.query_id, {})
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    want = exact(rows, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        line = [found[k] for k in range(1, 21)]
        assert line == sorted(line, key=lambda z: (-z[1], z[0]))
        value = dict(want[q])
        assert all(value[i] == s for i, s in line if i in value)
        hits += len({i for i, _ in line} & set(value))
        if 100 <= q < 420:  # its copies tie exactly, and the smallest ids come first
            assert line == want[q]
    assert hits >= 0.9 * sum(len({i for i, _ in v}) for v in want.values())


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])]
    got = [tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, KIND), "vec_id % 20 = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert neighbours.nearest(spark.createDataFrame([], KIND), "vec_id % 20 = 0").count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, None)], KIND), "vec_id % 20 = 0").count() == 0


@pytest.mark.parametrize("size", [1e153, 1e-153, 1e-300])
def test_extreme_components(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) * size for c in rng.uniform(0.5, 1.5, 4)]) for i in range(60)]
    got = neighbours.nearest(spark.createDataFrame(rows, KIND.replace("float", "double")), "vec_id % 20 = 0").collect()
    want = exact(rows, 20)
    assert len(got) == 60
    for q in want:
        line = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert line == want[q]


def test_chi_square_bound():
    assert abs(neighbours.chi_square_bound(0.95, 8) - 15.507) < 1e-3
