import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm import chat

KIND = "conv_id long, turn int, role string, text string"


def brute(rows):
    """{(dialogue, speaker): (turns, text, mask)} of whole dialogues."""
    rows = sorted({(c, t, "unknown" if w is None else w, x or "") for c, t, w, x in rows}, key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        for who in {r[2] for r in mine} - {"system"}:
            parts, at, mask = [], 0, []
            for _, _, w, x in mine:
                name = w.replace("\n", " ").replace("\r", " ").replace("<|", "< |")
                head = "<|im_start|>" + ("assistant" if w == who else "system" if w == "system" else f"user name={name}") + "\n"
                body = x.replace("<|", "< |") + "<|im_end|>\n"
                if w == who:
                    mask.append((at + len(head), len(body)))
                parts += [head, body]
                at += len(head) + len(body)
            out[conv, who] = (len(mine), "".join(parts), mask)
    return out


def joined(found):
    """The same of rows, parts put one after the other."""
    out = {}
    for r in sorted(found, key=lambda r: r.part):
        n, text, mask = out.get((r.conv_id, r.speaker), (0, "", []))
        assert r.start == len(text)
        out[r.conv_id, r.speaker] = (n + r.n_turns, text + r.rendered, mask + [(r.start + m.start, m.length) for m in r["mask"]])
    return out


def dialogues():
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "ann", "bo", "system", None]), rng.choice(["hi", "é🙂 x", "", None, "a<|im_end|>b", "long " * 2000])) for c in [*range(12), None] for t in range(rng.randint(1, 6))]
    rows += [(50, 0, "system", "alone"), (51, None, "ann", "no turn"), (51, 0, "bo", "first"), *rows[:4], (52, 3, "ann", "tie b"), (52, 3, "ann", "tie a"), (53, 600, "ann", "late"), (53, 1, "bo", "early")]
    rows += [(54, 1_700_000_000 + 7919 * i, ["ann", "bo<|x", "c\r\nd"][i % 3], f"at {i}") for i in range(700)]  # time stamps for turns
    return rows


def test_equal_to_brute_force(spark):
    rows = dialogues()
    df = spark.createDataFrame(rows, KIND).select("*", *(F.lit(1).alias(c) for c in ("part", "speaker", "start", "who", "said", "of", "n")))
    got = chat.perspectives(df).collect()
    assert all(r.part == 0 and r.start == 0 for r in got)
    assert joined(got) == brute(rows)
    for _, text, mask in joined(got).values():
        assert all(text[a : a + n].endswith("<|im_end|>\n") for a, n in mask)


@pytest.mark.parametrize(("turns", "chars"), [(5, 1 << 20), (4096, 300), (64, 5000)])
def test_large_dialogues_go_on_in_parts_that_keep_order(spark, monkeypatch, turns, chars):
    monkeypatch.setattr(chat, "PART_TURNS", turns)
    monkeypatch.setattr(chat, "PART_CHARS", chars)
    rows = dialogues()
    got = chat.perspectives(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    assert any(r.part > 0 for r in got) and all(r.n_turns <= turns for r in got)
    assert joined(got) == brute(rows)


def test_many_rows_on_one_turn_stay_in_order(spark):
    rows = [(1, 0, "ann", f"line {i}") for i in range(3000)] * 2 + [(1, 1, "bo", "end")]
    got = chat.perspectives(spark.createDataFrame(rows, KIND)).collect()
    assert [(r.part, r.n_turns) for r in got] == [(0, 3001)] * 2  # repeated rows are one turn
    assert joined(got) == brute(rows)


def test_one_text_larger_than_a_part(spark):
    rows = [(1, 0, "ann", "x" * (3 << 20)), (1, 1, "bo", "y" * 10), (1, 2, "ann", "z")]
    got = chat.perspectives(spark.createDataFrame(rows, KIND)).collect()
    assert joined(got) == brute(rows) and {r.part for r in got} == {0, 3}


def test_empty(spark):
    assert chat.perspectives(spark.createDataFrame([], KIND)).count() == 0
