"""Text preprocessing and skill-name queries."""

from pyspark.sql import functions as F

from ..functions import skills as S
from ..functions import text as T
from ..sources import tables
from .registry import query, sql_biwords, sql_terms


@query(f"SELECT doc_id, array_to_string({sql_terms('text')}, ' ') AS terms FROM documents")
def t05_terms(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::INT AS n, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: regexp_full_match(t, '[A-Z]{2,}')), ' ') AS acronyms FROM documents")
def t02_raw_tokens(spark, sf):
    tokens = T.raw_tokens(F.col("text"))
    return tables.table(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n"), F.array_join(F.filter(tokens, T.is_acronym), " ").alias("acronyms"))


@query(
    """SELECT reason, token, count(*) AS n FROM (SELECT lower(t) AS token, CASE WHEN length(t) < 2 AND NOT regexp_full_match(t, '[0-9]') THEN 'too short' ELSE 'stop word' END AS reason, t FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM documents))
WHERE reason = 'too short' OR list_contains(string_split('"""
    + " ".join(T.STOP_WORDS)
    + """', ' '), token) AND NOT regexp_full_match(t, '[A-Z]{2,}') GROUP BY ALL"""
)
def t07_removed(spark, sf):
    gone = F.explode(T.removed(T.raw_tokens(F.col("text")))).alias("r")
    return tables.table(spark, sf, "documents").select(gone).groupBy("r.reason", "r.token").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, array_to_string({sql_biwords('w')}, ' ') AS biwords FROM (SELECT doc_id, {sql_terms('text')} AS w FROM documents)")
def t10_biwords(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.array_join(T.biwords(T.terms(F.col("text"))), " ").alias("biwords"))


@query(f"SELECT doc_id, array_to_string(flatten(u) || flatten(list_transform(u, lambda w: {sql_biwords('w')})), ' ') AS terms FROM (SELECT doc_id, list_transform(string_split(text, ','), lambda s: {sql_terms('s')}) AS u FROM documents)")
def t10_segments(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.array_join(T.segment_terms(F.col("text"), True), " ").alias("terms"))


@query(r"""SELECT page_id, rtrim(rtrim(trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(url), '&', ' and '), '[^a-z0-9+#. ]', ' ', 'g'), '\s+', ' ', 'g')), '\.+$', '')), '.')) AS plain FROM pages""")
def t11_plain(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", S.plain(F.col("url")).alias("plain"))


@query("SELECT x AS name, y AS key FROM (VALUES ('PowerBI', 'power bi'), ('Power-BI', 'power bi'), ('Amazon Web Services', 'aws'), ('K8s', 'kubernetes'), ('T-SQL', 't sql'), ('Node.js', 'node.js'), ('C++', 'c++'), ('R&D', 'r and d'), ('golang', 'go'), ('Cloud.', 'cloud')) v(x, y)")
def t12_canon(spark, sf):
    names = spark.createDataFrame([(x,) for x in ("PowerBI", "Power-BI", "Amazon Web Services", "K8s", "T-SQL", "Node.js", "C++", "R&D", "golang", "Cloud.")], "name string")
    return names.select("name", S.canon(F.col("name")).alias("key"))


@query("SELECT x AS name, y AS display FROM (VALUES ('powerbi', 'Power BI'), ('nation_7', 'Nation 7'), ('hr', 'HR'), ('ai ops', 'AI Ops'), ('c#', 'c#'), ('machine learning', 'Machine Learning'), ('postgres', 'PostgreSQL')) v(x, y)")
def t14_pretty(spark, sf):
    names = spark.createDataFrame([(x,) for x in ("powerbi", "nation_7", "hr", "ai ops", "c#", "machine learning", "postgres")], "name string")
    return names.select("name", S.pretty(F.col("name")).alias("display"))


@query("SELECT x AS item, y AS base, z AS inner_items FROM (VALUES ('AWS (EC2, S3)', 'AWS', 'EC2|S3'), ('Linux', 'Linux', ''), ('SQL ( )', 'SQL', '')) v(x, y, z)")
def t16_parenthetical(spark, sf):
    items = spark.createDataFrame([("AWS (EC2, S3)",), ("Linux",), ("SQL ( )",)], "item string")
    p = S.parenthetical(F.col("item"))
    return items.select("item", p["base"].alias("base"), F.array_join(p["inner"], "|").alias("inner_items"))


@query("SELECT id, concat_ws(' ', CASE WHEN schedule <> 'Not stated' THEN schedule END, CASE schedule WHEN 'Contractor' THEN 'contract contractor' WHEN 'Internship' THEN 'intern internship' WHEN 'Full-time' THEN 'fulltime' END, CASE WHEN workplace = 'Remote' THEN 'remote wfh' END) AS words FROM listing", ("listing",))
def t17_worktype(spark, sf):
    return tables.listings(spark, sf).select("id", T.worktype_text(F.col("schedule"), F.col("workplace")).alias("words"))


@query("SELECT id, CASE WHEN contains(lower(location), lower(country)) THEN location ELSE location || ', ' || country END AS place FROM listing", ("listing",))
def t18_location(spark, sf):
    return tables.listings(spark, sf).select("id", T.location_text(F.col("location"), F.col("country")).alias("place"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains(string_split('" + " ".join(T.FIRST_STOP_WORDS) + "', ' '), t)), ' ') AS terms FROM documents")
def t20_first_version(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.array_join(T.first_version(F.col("text")), " ").alias("terms"))


@query()
def t01_fold(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query()
def t08_stem(spark, sf):
    words = tables.table(spark, sf, "documents").select(F.explode(T.terms(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.stemmed(F.col("word")).alias("stem"))


@query()
def t15_split(spark, sf):
    return tables.table(spark, sf, "conversations").select("conv_id", "turn", F.size(S.split_items(F.col("text"))).alias("items"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def m06_json_props(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT x AS value, y AS parsed FROM (VALUES ('12.5', 12.5::DOUBLE), ('x', NULL), ('', NULL), ('1e3', 1000::DOUBLE)) v(x, y)")
def m07_safe_float(spark, sf):
    return spark.createDataFrame([("12.5",), ("x",), ("",), ("1e3",)], "value string").select("value", F.expr("try_cast(value as double)").alias("parsed"))


@query("SELECT p_partkey AS id, round_even(p_retailprice / 7, 2) AS price, (round_even(100 * p_size / 51.0::DOUBLE, 0)::INT)::VARCHAR || '%' AS share FROM part")
def m02_rounding(spark, sf):
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.bround(F.col("p_retailprice") / 7, 2).alias("price"), F.format_string("%d%%", F.bround(100 * F.col("p_size") / 51.0).cast("int")).alias("share"))
