"""Close spellings are looked for among all names, none cut off by the alphabet."""

import difflib

from pyspark.sql import functions as F

from sievewright.operators import analyze, filters


def test_late_names_of_a_large_catalog_are_found(spark):
    names = spark.range(120_000).select(F.format_string("Aab %06d", "id").alias("company")).union(spark.createDataFrame([("Zab 000001",)], "company string"))
    assert filters.resolve_company(names, "Zab 00001x")[1][0] == "Zab 000001"


def test_closest_as_difflib_picks(spark):
    names = ["widget", "wizard", "midget", "gadget", "fidget", "widgets", "ring", "wdgt", "bolt"]
    words = ["wizget", "rnig", "xyz"]
    rows = analyze.closest(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(v,) for v in names], "term string"), 3, 0.75).collect()
    assert {r.word: r.suggestions for r in rows} == {w: c for w in words if (c := difflib.get_close_matches(w, names, 3, 0.75))}
