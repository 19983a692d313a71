import random
from collections import Counter

from pyspark.sql import functions as F
from util import awkward_rows, documents, words

from sievewright.llm import quality
from sievewright.llm.common import Scratch


def brute(text):
    w = words(text)
    seen, dup, lines = set(), 0, 0
    for line in (text or "").split("\n"):
        if words(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(wins)
    hit = {j for i, x in enumerate(wins) if often[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), lines


def verdicts(rows):
    """[kept] by the rules as stated, from all texts at once."""
    made = []
    for r in rows:
        n, chars, symbols, dup, twice, lines = brute(r[1])
        failed = n < 20 or 100 * twice > 30 * n
        parts = {} if failed else {"word_length": chars * 65536 // n, "symbol_share": symbols * 65536 // n, "line_repeat_share": dup * 65536 // max(lines, 1)}
        made.append((failed, r[2], r[3], parts))

    def cell(v):
        low = max(v.bit_length() - 7, 0)
        return v >> low << low

    good = [m for m in made if not m[0]]
    out = []
    for failed, lang, source, parts in made:
        pool = [m for m in good if m[1:3] == (lang, source)]
        if len(pool) < 100:
            pool = [m for m in good if m[1] == lang]
        if len(pool) < 100:
            pool = good
        kept = not failed
        for name, v in parts.items():
            cells = sorted(cell(m[3][name]) for m in pool)
            q25, q50, q75 = (cells[-(-len(cells) * k // 4) - 1] for k in (1, 2, 3))
            slack = int({"word_length": 1.5, "symbol_share": 0.1, "line_repeat_share": 0.4}[name] * 65536)
            kept &= q50 - 8 * (q75 - q50) - slack <= v <= q50 + 8 * (q50 - q25) + slack
        out.append(kept)
    return out


def mixed_rows(n=420):
    """Groups above and below the least size, of different habits, with outliers, ties, nulls and repeated rows."""
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, k)))
    rows = []
    for i in range(n):
        kind = rng.random()
        end = rng.choice(["%", "%%", "$#&"]) if kind < 0.15 else ""
        w = [word(30 if kind > 0.9 else 6 + 3 * (i % 2)) + end for _ in range(rng.randint(15, 70))]
        text = "\n".join(" ".join(w[a : a + 6]) for a in range(0, len(w), 6))
        if kind > 0.8:
            text += "\n" + "\n".join(["the same line"] * rng.randint(2, 12))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", None]), 0))
    return rows + rows[:7] + [(None, rows[0][1], "en", "s0", 0), (None, None, None, None, 0)] + awkward_rows(3, 60)


def test_counts_equal_brute_force(spark):
    rows = awkward_rows(7, 120) + [(900, "a b c d e f g h\na b c d e f g h\n\n\n \na b c d e f g h", "en", "s", 1)]
    got = {r.doc_id: tuple(r["_q"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.with_counts(documents(spark, rows)).collect()}
    for r in rows:
        assert got[r[0]] == brute(r[1])[:5], r[1][:80] if r[1] else r[1]


def test_clean_texts_stay_and_outliers_go(spark):
    rng = random.Random(5)
    text = lambda end: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + end for _ in range(40))
    clean = [(i, text(""), "en", f"s{i % 3}", 0) for i in range(240)]
    bad = [(1000 + i, text("%%%"), "en", f"s{i % 3}", 0) for i in range(60)]
    docs = documents(spark, clean + bad + [(5000, None, None, None, 0), (5001, "", "xx", "s0", 0)])
    kept = {r.id: r.kept for r in quality.judged(docs).collect()}
    assert all(kept[r[0]] for r in clean)
    assert not any(kept[r[0]] for r in bad)
    assert kept[5000] is False and kept[5001] is False
    assert {r.doc_id for r in quality.passed(docs).collect()} == {r[0] for r in clean}


def test_kept_equals_brute_force_and_no_run_differs(spark, monkeypatch):
    rows = mixed_rows()
    want = sorted(zip(((r[0] is None, r[0] or 0) for r in rows), verdicts(rows), strict=True))
    assert 20 < sum(not k for _, k in want) and sum(k for _, k in want) > 200
    docs = documents(spark, rows)
    seen = set()
    for shape in (docs, docs, docs.repartition(7), docs.repartition(3).sortWithinPartitions("text")):
        got = quality.judged(shape).collect()
        assert sorted(((r.id is None, r.id or 0), r.kept) for r in got) == want
        found = quality.limits(quality.counted(shape, Scratch(spark, "t")), Scratch(spark, "t"))
        seen.add(tuple(sorted(map(str, found.collect()))))
    assert len(seen) == 1
    stay = sorted(str(r) for r, (_, k) in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), want, strict=True) if k)
    assert len(stay) == quality.passed(docs).count()
    direct = sorted(map(str, quality.passed(docs).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(map(str, quality.passed(docs).collect())) == direct


def test_tables_without_a_judged_text(spark):
    for _ in range(2):
        assert quality.judged(documents(spark, [])).count() == 0
        short = quality.judged(documents(spark, [(1, "a b c", "en", "s", 1), (2, None, None, None, 0), (2, "", "en", "s", 0)])).collect()
        assert len(short) == 3 and not any(r.kept for r in short) and all(r.failed for r in short)
    assert quality.passed(documents(spark, [])).count() == 0


def test_clashing_columns(spark):
    names = ("n", "q", "Q_", "mark", "limits", "of_lang", "kept", "_q", "id", "n_words", "lo_symbol_share")
    docs = documents(spark, awkward_rows(8, 40) * 2).select("*", *(F.lit(1).alias(c) for c in names))
    assert quality.judged(docs).count() == docs.count()
    out = quality.passed(docs)
    assert out.columns == docs.columns and out.count() == quality.judged(docs).where("kept").count()
