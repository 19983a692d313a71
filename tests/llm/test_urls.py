import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievewright.llm import urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for text, allow in urls.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = (text, "allow" if allow else "block")
    return best or (None, None)


def brute(pages):
    rows = [(i, *parts(u)) for i, u in pages]
    text = {h + p: rule_of(h, p)[1] for _, h, p in rows}
    n = Counter(h + p for _, h, p in rows)
    counts = {y: [Counter() for _ in range(6)] for y in ("allow", "block")}
    grams = lambda u: [("\x01" * 4 + u + "\x02")[i : i + 5] for i in range(len(u) + 1)]
    for u, y in text.items():
        if y and zlib.crc32(u.encode()) % 5:
            for g in grams(u):
                for k in range(1, 6):
                    counts[y][k][g[-k:]] += n[u]

    def p(y, g):
        out = 1 / 256
        for k in range(1, 6):
            same = [v for x, v in counts[y][k].items() if x[:-1] == g[-k:][:-1]]
            if same:
                out = (counts[y][k][g[-k:]] + len(same) * out) / (sum(same) + len(same))
        return out

    score = lambda u: sum(math.log(p("allow", g)) - math.log(p("block", g)) for g in grams(u)) / (len(u) + 1)
    apart = [(math.floor(max(-10, min(10, score(u))) / 0.005), y, n[u]) for u, y in text.items() if y and zlib.crc32(u.encode()) % 5 == 0]
    a, r = (sum(x[2] for x in apart if x[1] == y) for y in ("allow", "block"))
    cut = -math.inf
    if a and r:
        gain = lambda b: sum((1 if y == "allow" else -1) * m / (a if y == "allow" else r) for s, y, m in apart if s >= b)
        cut = min((-round(gain(b), 12), b) for b in {x[0] for x in apart})[1] * 0.005
    out = []
    for i, h, q in rows:
        rule, verdict = rule_of(h, q)
        s = None if rule else score(h + q)
        out.append((i, h, q, rule, verdict or ("allow" if s >= cut else "block"), s))
    return out


def some_urls(seed):
    rng = random.Random(seed)
    out = []
    for i in range(90):
        host = rng.choice(["www.", "m.", ""]) + rng.choice(["abc", "cheap", "news"]) + rng.choice([".example.org", ".example.com", ".example.net", "example.org", ".COM"])
        out.append((i, f"{rng.choice(['http', 'https'])}://{host}{rng.choice(['/es/', '/en/', '/en/1', '/de/', '/fr/', '', '/'])}{rng.choice(['', str(rng.randint(0, 99)), 'pills'])}{rng.choice(['', '?q=/x', '#t', '/a?b#c'])}"))
    return out + [(200, None), (201, ""), (202, "no scheme"), (203, "http://"), (204, "a://b://c/d"), (205, "HTTP://ÉX.ORG/é"), (5, out[5][1]), (5, out[5][1]), (None, "https://x.example.net/fr/1"), (206, "http://org/"), (207, "http://example.org/es/x?y")]


@pytest.mark.parametrize(("seed", "most"), [(1, 50_000), (2, 50_000), (3, 40)])
def test_equal_to_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(urls, "BROADCAST_ROWS", most)
    pages = some_urls(seed)
    if seed == 1:
        pages += [(300, "http://long.example.net/" + "abc/" * 6000)]
    df = spark.createDataFrame(pages, "page_id long, url string").select("*", F.lit("x").alias("host"), F.lit(1).alias("score"))
    got = sorted(map(tuple, urls.judged(df).collect()), key=str)
    want = sorted(brute(pages), key=str)
    order = lambda r: (r[0] is None, r[0] or 0, str(r[1:5]))
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:5] == w[:5]
        assert (g[5] is None and w[5] is None) or abs(g[5] - w[5]) < 1e-9


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judged(df).collect()} == {"allow"}
    assert urls.judged(df.limit(0)).count() == 0
