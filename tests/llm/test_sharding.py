from collections import defaultdict
from hashlib import md5

from pyspark.sql import functions as F
from util import awkward_rows, documents

from sievewright.llm import sharding


def brute(rows, limit):
    """Buckets split bit by bit while they are too large."""
    bits = lambda k: format(int(md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16), "060b")
    out, todo = {}, [("", list(range(len(rows))))]
    while todo:
        prefix, members = todo.pop()
        total = sum(len((rows[i][1] or "").encode()) for i in members)
        if total <= limit:
            out |= {i: (prefix, total, len(members)) for i in members}
        elif len(prefix) == 60:
            out |= {i: None for i in members}
        else:
            for b in "01":
                part = [i for i in members if bits(rows[i][0])[len(prefix)] == b]
                if part:
                    todo.append((prefix + b, part))
    return out


def test_equal_to_splitting_by_hand(spark):
    rows = awkward_rows(21, 120)
    rows = [r for r in rows if len((r[1] or "").encode()) <= 4000] + [(None, "no id", "en", "s", 1)]
    got = {(r.doc_id): r for r in sharding.extendible_shards(documents(spark, rows).select("*", F.lit(1).alias("h"), F.lit(1).alias("cell")), limit=4000).collect()}
    for i, w in brute(rows, 4000).items():
        r = got[rows[i][0]]
        assert (r.shard, r.shard_bytes, r.shard_rows) == w and r.depth == len(w[0]) and r.n_bytes == len((rows[i][1] or "").encode())


def test_equal_keys_equal_rows_and_giants(spark):
    rows = [(1, f"text {i} " * 10, "en", "s", 1) for i in range(200)] + [(2, "same " * 20, "en", "s", 1)] * 100 + [(3, "giant " * 1000, "en", "s", 1)]
    out = sharding.extendible_shards(documents(spark, rows), limit=1000).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in out) == sorted((r[0], len(r[1])) for r in rows)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    for s in shards.values():
        assert sum(r.n_bytes for r in s) == s[0].shard_bytes and len(s) == s[0].shard_rows
        assert s[0].shard_bytes <= 1000 or len(s) == 1
    names = sorted(n for n in shards if "/" not in n)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))


def test_empty(spark):
    assert sharding.extendible_shards(documents(spark, [])).count() == 0
