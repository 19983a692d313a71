"""The pipeline's stages on a small corpus: what each keeps, checked on its own input."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from util import documents, words

NAMES = ["quality_rules", "quality_classifier", "ngram_jaccard_join", "mix_sources", "best_fit_packing"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    text = lambda n, end="": " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + end for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        t = text(rng.randint(80, 160), "%%" if i % 10 == 0 else "")
        rows.append((i, t, rng.choice(["en", "de"]), f"s{i % 4}", len(t)))
        labels.append((i, int(i % 10 != 0), 0))
    for i in range(1, 60, 2):
        w = rows[i][1].split(" ")
        w[3] = "changed"
        rows.append((1000 + i, " ".join(w), "en", "s1", 1))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "too few words", "en", None, 13)]
    d = str(tmp_path_factory.mktemp("tables"))
    documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(NAMES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append(docs.collect())
    rules, good, alone, mixed, packed = kept
    clean = {i for i in range(300) if i % 10} | {1000 + i for i in range(1, 60, 2) if i % 10}
    assert {r.doc_id for r in rules} >= clean and not {r.doc_id for r in rules} & {2000, 2001, 2002}
    assert not {r.doc_id for r in rules} & {i for i in range(0, 300, 10)}
    assert {r.doc_id for r in good} >= clean
    assert {r.doc_id for r in alone} == {i for i in range(300) if i % 10}
    text = {r.doc_id: r.text for r in alone}
    assert all(r.text in text[r.doc_id] and r.n_chars == len(r.text) for r in mixed)
    total = sum(len(words(t)) for t in text.values())
    assert abs(sum(len(words(r.text)) for r in mixed) - 1.5 * total) <= 4
    spans = {}
    for r in packed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= 1024


def test_run_gives_the_stages_rows(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() == spark.read.parquet(f"{folder}/best_fit_packing").count()


def test_empty_repeated_and_clashing_tables(spark, folder, tmp_path):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    whole = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 150 or doc_id >= 2000")
    odd = {c: F.lit(1) for c in ("id", "mark", "_id", "_mark", "_tie", "_runs", "_q", "_f", "limits", "rates", "tie", "n", "length", "source_", "stays")}
    tables = {"empty": whole.limit(0), "nulls": whole.limit(3).select(*(F.lit(None).cast(t).alias(c) for c, t in whole.dtypes)), "twice": whole.unionByName(whole).withColumns(odd)}
    for name, docs in tables.items():
        d = f"{tmp_path}/{name}"
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        ids = []
        for k, (step, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, d)
            assert k == len(NAMES) - 1 or out.columns == docs.columns
            out.write.parquet(f"{d}/{step}")
            docs = spark.read.parquet(f"{d}/{step}")
            ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name in ("empty", "nulls"):
            assert ids[-1] == set()
        else:
            assert ids[2] == {i for i in range(150) if i % 10}
            assert spark.read.parquet(f"{d}/ngram_jaccard_join").count() == len(ids[2])
