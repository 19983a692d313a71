"""Files, the saved index, and records that arrive as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from sievewright.operators.index import Index
from sievewright.sources import files, tables
from sievewright.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_listing_csv_round_trip(spark, tmp_path):
    rows = [("7", 'A "quoted"\ntitle', "Firm", "", None, "Remote", "", "Fam", ["sql", "c++"], "2024-02-03", "12.5", "x", "", "", "3", "True", "no")]
    df = spark.createDataFrame(rows, files.LISTING.replace("skills string", "skills array<string>"))
    files.write_listings(df, str(tmp_path / "l"))
    r = files.read_listings(spark, str(tmp_path / "l")).first()
    assert (r.id, r.title, r.country, r.schedule, r.skills, r.salary_year, r.salary_hour, r.listings, r.no_degree) == (7, 'A "quoted"\ntitle', "Unknown", "Not stated", ["sql", "c++"], 12.5, None, 3, True)
    with pytest.raises(FileNotFoundError):
        files.read_listings(spark, str(tmp_path / "none"))
    files.write_listings(df.limit(0), str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        files.read_listings(spark, str(tmp_path / "empty"))


def test_small_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿skill_id,skills,type\n2,Power-BI,b\n1,powerbi,a\n3,sql,c\n", encoding="utf-8")
    assert {(r.key, r.type) for r in files.read_skills(spark, str(tmp_path / "s.csv")).collect()} == {("power bi", "a"), ("sql", "c")}
    assert files.read_skills(spark, str(tmp_path / "no.csv")).count() == 0
    (tmp_path / "j.json").write_text(json.dumps({"description": "d", "queries": [{"id": "1", "query": "q", "type": "role", "split": "dev", "must": {"country": ["X"]}, "should": {}}]}))
    assert files.read_judged(spark, str(tmp_path / "j.json")).first().must == {"country": ["X"]}
    assert files.read_info(str(tmp_path / "none.json")) == {}
    for name, raw in (("a.pdf", b""), ("b.pdf", b"hello"), ("c.pdf", b"%PDF-1.4 junk")):
        (tmp_path / name).write_bytes(raw)
    got = {r.path[-5:]: r.error for r in files.read_resumes(spark, str(tmp_path / "*.pdf")).collect()}
    assert got == {"a.pdf": "empty_file", "b.pdf": "not_pdf", "c.pdf": "unreadable"}


def test_index_round_trip_and_pruned_read(spark, tmp_path):
    records = tables.listings(spark, SF)
    ix, path = Index.build(records), str(tmp_path / "ix")
    again = Index.load_or_build(records, path)
    assert again.n == ix.n and sorted(map(tuple, again.terms.select("zone", "term", "df").collect())) == sorted(map(tuple, ix.terms.select("zone", "term", "df").collect()))
    plan = again.posts.where(F.col("term").isin("red", "blue") & (F.col("zone") == "Title"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(zone" in plan and "PushedFilters: [In(term" in plan
    assert len(files.fingerprint(spark, f"{path}/terms", "1")) == 40
    # other data, or other settings, make another index
    src, kept = str(tmp_path / "src"), str(tmp_path / "kept")
    records.where("id < 50").coalesce(1).write.parquet(src)
    made = lambda **k: Index.load_or_build(spark.read.parquet(src), kept, source=src, **k).n
    stamp = lambda: spark.read.parquet(f"{kept}/manifest").first().key
    assert made() == made() == records.where("id < 50").count()
    first = stamp()
    records.where("id >= 50").coalesce(1).write.mode("append").parquet(src)
    assert made() == records.count() and stamp() != first
    second = stamp()
    made(stemming=True)
    assert stamp() != second
    stemmed = Index.build(records, stemming=True)
    assert stemmed.terms.where("term = 'small_ring'").count() and stemmed.posts.count()


def test_stream_equals_batch(spark, tmp_path):
    records = tables.listings(spark, SF)
    for part in range(2):
        records.where(F.col("id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.append_records(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got, want = ingest.refreshed(spark, str(tmp_path / "out")), Index.build(records)
    key = lambda ix: sorted((r.zone, r.term, r.doc_id, round(r.dw, 9)) for r in ix.posts.collect())
    assert got.n == want.n and key(got) == key(want)
