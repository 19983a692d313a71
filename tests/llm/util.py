"""Fixtures of awkward documents, and plain versions of word rules."""

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward_rows(seed=1, n=150):
    """Near copies of several rates, exact copies, empty, null, white-space, unicode spaces, very long, repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]
    rows, base, passage = [], make(120), make(40)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 1:
            w = make(rng.randint(1, 60)) + passage
        elif kind == 2:
            w = make(rng.randint(1, 8))
        elif kind == 3 and rows:
            w = (rng.choice(rows)[1] or "x").split(" ")
        else:
            w = make(rng.randint(20, 200))
        sep = rng.choice([" ", " ", "\n", "\t ", "\r\n"])
        text = sep.join(x.upper() if rng.random() < 0.1 else x for x in w)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s1", None]), len(text)))
    k = n
    for text in (None, "", " \n\t ", "one", "one", "ONE", "a b c", "a b c", "a b c\x1cd\x85e", " x y", "🙂 " * 30, "w" * 5000, " ".join(make(30000)), "line of words\n" * 12, "a b c d e f g h i j " * 9, "#$ %& " * 40):
        rows.append((k, text, "en", "s1", len(text or "")))
        k += 1
    return rows


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
