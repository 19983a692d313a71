"""How queries are registered, and the SQL that oracles share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index
from ..operators.index import Index
from ..sources import tables
from ..storage import Tables, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``sql`` gets the common table expressions that it names in ``uses``, with what those need."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_parts(sql, uses)
        return f

    return add


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
QUERY_STOP = "[" + ", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS) + "]"


def sql_terms(text: str, query: bool = False) -> str:
    more = f" AND NOT list_contains({QUERY_STOP}, lower(t))" if query else ""
    return f"list_transform(list_filter(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda t: (length(t) >= 2 OR regexp_full_match(t, '[0-9]')) AND (NOT list_contains({STOP}, lower(t)) OR regexp_full_match(t, '[A-Z]{{2,}}')){more}), lambda t: lower(t))"


def sql_biwords(terms: str) -> str:
    return f"list_transform(range(1, greatest(len({terms}), 1)), lambda i: {terms}[i] || '_' || {terms}[i + 1])"


BATCH = ((1, "red widget"), (2, "small ring economy"), (3, "best large bolt role"), (4, "remote contractor gear nation"), (5, "nation_3 blue bolt"), (6, "brand 12 hot gear gear"), (7, "purple wizget"))
WORDS = ((1, "the and or er th"), (2, "nicht der die ich"), (3, "les que une est"), (4, "ing tion ble ou the"))

PARTS = {
    "sup": ("SELECT l_partkey, l_orderkey, l_linenumber, l_discount, l_shipdate, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey", ()),
    "listing": (
        """SELECT p_partkey AS id, p_name AS title, p_brand AS company, coalesce(location, '') AS location, coalesce(location, 'Unknown') AS country,
  CASE WHEN p_size % 3 = 0 THEN 'Remote' ELSE 'Not remote' END AS workplace,
  CASE p_size % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Contractor' WHEN 2 THEN 'Internship' ELSE 'Not stated' END AS schedule,
  p_type AS role_family, coalesce(skills, []) AS skills, posted, p_retailprice AS salary_year, coalesce(listings, 0) AS listings
FROM part LEFT JOIN (
  SELECT l_partkey, list_sort(list(DISTINCT lower(n_name)) FILTER (l_discount >= 0.09)) AS skills, arg_min(n_name, l_orderkey * 8 + l_linenumber) AS location, max(l_shipdate)::DATE AS posted, count(*) AS listings
  FROM sup GROUP BY l_partkey) ON p_partkey = l_partkey""",
        ("sup",),
    ),
    "bag": (
        f"""SELECT id AS doc_id, {sql_terms("title")} AS t, {sql_terms("company")} AS c,
  {sql_terms("CASE WHEN contains(lower(location), lower(country)) THEN location ELSE location || ', ' || country END")} AS l,
  {sql_terms("concat_ws(' ', CASE WHEN schedule <> 'Not stated' THEN schedule END, CASE WHEN schedule = 'Contractor' THEN 'contract contractor' WHEN schedule = 'Internship' THEN 'intern internship' WHEN schedule = 'Full-time' THEN 'fulltime' END, CASE WHEN workplace = 'Remote' THEN 'remote wfh' END)")} AS w,
  list_transform(skills, lambda s: replace(s, '_', ' ')) AS k FROM listing""",
        ("listing",),
    ),
    "zoned": (
        f"""SELECT 'Title' AS zone, doc_id, t || {sql_biwords("t")} AS terms FROM bag UNION ALL SELECT 'Company', doc_id, c || {sql_biwords("c")} FROM bag
  UNION ALL SELECT 'Location', doc_id, l FROM bag UNION ALL SELECT 'WorkType', doc_id, w FROM bag UNION ALL SELECT 'Skills', doc_id, list_transform(k, lambda s: replace(s, ' ', '_')) FROM bag
  UNION ALL SELECT 'flat', doc_id, t || flatten(list_transform(k, lambda s: {sql_terms("s")})) || c || l || w FROM bag""",
        ("bag",),
    ),
    "tf": ("SELECT zone, doc_id, term, count(*) AS tf FROM (SELECT zone, doc_id, unnest(terms) AS term FROM zoned) GROUP BY ALL", ("zoned",)),
    "total": ("SELECT count(*) AS n FROM listing", ("listing",)),
    "dict": ("SELECT zone, term, count(*) AS df, log10((SELECT n FROM total) / count(*)) AS idf FROM tf GROUP BY zone, term", ("tf", "total")),
    "weighted": ("SELECT zone, doc_id, term, tf, (1 + log10(tf)) * idf AS w FROM tf JOIN dict USING (zone, term)", ("tf", "dict")),
    "post": ("SELECT zone, term, doc_id, tf, w / norm AS dw FROM weighted JOIN (SELECT zone, doc_id, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY zone, doc_id) USING (zone, doc_id) WHERE norm > 0", ("weighted",)),
    "q": ("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in BATCH) + ") v(query_id, query)", ()),
    "qw": (f"SELECT query_id, {sql_terms('query', True)} AS words FROM q", ("q",)),
    "qt": (f"SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(words || {sql_biwords('words')}) AS term FROM qw) GROUP BY ALL", ("qw",)),
    "named": (
        f"""SELECT query_id, key, term, df FROM (SELECT DISTINCT query_id, key, replace(key, ' ', '_') AS term FROM (SELECT query_id, unnest(words || list_transform({sql_biwords('words')}, lambda b: replace(b, '_', ' '))) AS key FROM qw))
  JOIN (SELECT term, df FROM dict WHERE zone = 'Skills') USING (term)""",
        ("qw", "dict"),
    ),
    "named_words": (f"SELECT query_id, key, df, unnest({sql_terms('key')}) AS term FROM named", ("named",)),
    "fields": (
        """SELECT query_id, term, tf, zone, df FROM qt JOIN dict USING (term) WHERE zone IN ('Title', 'Company') OR zone IN ('Location', 'WorkType') AND NOT contains(term, '_')
  UNION ALL SELECT query_id, term, tf, 'Skills', max(w.df) FROM qt JOIN named_words w USING (query_id, term) WHERE NOT contains(term, '_') GROUP BY query_id, term, tf""",
        ("qt", "dict", "named_words"),
    ),
    "route": (
        """SELECT query_id, zone, term, tf, df FROM (SELECT *, max(df) OVER (PARTITION BY query_id, term) AS most FROM fields) WHERE df >= 0.5 * most AND zone <> 'Skills'
  UNION ALL SELECT query_id, 'Skills', term, 1, df FROM (
    SELECT n.query_id, n.term, n.df, coalesce(max(d.df), 0) AS others FROM named n JOIN named_words w USING (query_id, key)
    LEFT JOIN dict d ON d.term = w.term AND d.zone IN ('Title', 'Company', 'Location') GROUP BY ALL) WHERE others = 0 OR df >= 0.5 * greatest(others, 1)""",
        ("fields", "named", "named_words", "dict"),
    ),
    "vec": ("SELECT query_id, zone, term, tf, p / norm AS qw FROM (SELECT query_id, zone, term, r.tf, (1 + log10(r.tf)) * idf AS p, sqrt(sum(power((1 + log10(r.tf)) * idf, 2)) OVER (PARTITION BY query_id, zone)) AS norm FROM route r JOIN dict USING (zone, term)) WHERE norm > 0", ("route", "dict")),
    "flatq": ("SELECT query_id, 'flat' AS zone, term, count(*) AS tf FROM (SELECT query_id, unnest(words) AS term FROM qw) GROUP BY ALL", ("qw",)),
    "flatv": ("SELECT query_id, zone, term, tf, p / norm AS qw FROM (SELECT query_id, zone, term, r.tf, (1 + log10(r.tf)) * idf AS p, sqrt(sum(power((1 + log10(r.tf)) * idf, 2)) OVER (PARTITION BY query_id)) AS norm FROM flatq r JOIN dict USING (zone, term)) WHERE norm > 0", ("flatq", "dict")),
    "shares": (
        """SELECT query_id, zone, alpha / sum(alpha) OVER (PARTITION BY query_id) AS share FROM (SELECT DISTINCT query_id, zone FROM vec)
  JOIN (VALUES ('Title', 0.45::DOUBLE), ('Skills', 0.30::DOUBLE), ('Location', 0.15::DOUBLE), ('Company', 0.40::DOUBLE), ('WorkType', 0.10::DOUBLE)) a(zone, alpha) USING (zone)""",
        ("vec",),
    ),
    "zcos": ("SELECT query_id, zone, doc_id, sum(qw * dw) AS cosine FROM vec JOIN post USING (zone, term) GROUP BY ALL", ("vec", "post")),
    "fcos": ("SELECT query_id, zone, doc_id, sum(qw * dw) AS cosine FROM flatv JOIN post USING (zone, term) GROUP BY ALL", ("flatv", "post")),
    "cos": ("SELECT query_id, doc_id, sum(share * cosine) AS cosine FROM zcos JOIN shares USING (query_id, zone) GROUP BY ALL UNION ALL SELECT query_id, doc_id, cosine FROM fcos WHERE query_id NOT IN (SELECT query_id FROM shares)", ("zcos", "shares", "fcos")),
    "jac": (
        """SELECT query_id, doc_id, m / (q_size + d_size - m) AS jaccard FROM (SELECT query_id, doc_id, count(*) AS m FROM flatq JOIN tf USING (zone, term) GROUP BY ALL)
  JOIN (SELECT query_id, count(*) AS q_size FROM flatq GROUP BY ALL) USING (query_id) JOIN (SELECT doc_id, count(*) AS d_size FROM tf WHERE zone = 'flat' GROUP BY ALL) USING (doc_id)""",
        ("flatq", "tf"),
    ),
    "hyb": ("SELECT query_id, doc_id, cosine, coalesce(jaccard, 0) AS jaccard, (0.85 * cosine + 0.35 * coalesce(jaccard, 0)) / 1.2 AS score FROM cos LEFT JOIN jac USING (query_id, doc_id)", ("cos", "jac")),
    "ranked": ("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM hyb", ("hyb",)),
    "rel": ("SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ranked WHERE rank <= 50) WHERE score > 0 AND score >= 0.6 * best", ("ranked",)),
    "dskill": ("SELECT doc_id, unnest(k) AS key FROM bag", ("bag",)),
    "req": (
        """SELECT query_id, key, prevalence, jobs, CASE WHEN round(prevalence, 12) >= 0.5 THEN 'HIGH' WHEN round(prevalence, 12) >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM (
    SELECT r.query_id, key, sum(score) / any_value(total) AS prevalence, count(*) AS jobs FROM rel r JOIN dskill USING (doc_id) JOIN (SELECT query_id, sum(score) AS total FROM rel GROUP BY ALL) USING (query_id) GROUP BY r.query_id, key) WHERE round(prevalence, 12) >= 0.1""",
        ("rel", "dskill"),
    ),
    "custitem": ("SELECT o_custkey, l_discount, n_name, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey", ()),
    "profile": (
        """SELECT o_custkey AS profile_id, role, skills FROM (SELECT o_custkey, arg_min(p_name, (-n, p_name)) AS role FROM (SELECT o_custkey, p_name, count(*) AS n FROM custitem GROUP BY ALL) GROUP BY ALL)
  JOIN (SELECT o_custkey, coalesce(list_sort(list(DISTINCT replace(lower(n_name), '_', ' ')) FILTER (l_discount >= 0.09)), []) AS skills FROM custitem GROUP BY ALL) USING (o_custkey)""",
        ("custitem",),
    ),
    "mine": ("SELECT profile_id, unnest(skills) AS mine FROM profile", ("profile",)),
    "need": ("SELECT m.profile_id, r.query_id, r.key, r.prevalence, r.priority, mine.mine FROM (SELECT DISTINCT profile_id FROM profile) m CROSS JOIN req r LEFT JOIN mine ON mine.profile_id = m.profile_id AND mine.mine = r.key", ("profile", "req", "mine")),
}


def with_parts(sql: str, uses: tuple[str, ...]) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in PARTS[name][1]:
                need(other)
            order.append(name)

    for name in uses:
        need(name)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][0]})" for n in order) + "\n" + sql


def batch(spark: SparkSession, rows=BATCH) -> DataFrame:
    return spark.createDataFrame(list(rows), "query_id int, query string")


_saved: dict[tuple[str, str, str], Index] = {}


def _shared(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[str], Index]) -> Index:
    """An index that is built once in a session, saved in the shared folder and read from there by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _saved:
        _saved[key] = build(f"{shared_folder(spark)}/index-{kind}-{uuid.uuid4().hex}")
    return _saved[key]


def catalog_index(spark: SparkSession, sf_dir: str) -> Index:
    return _shared(spark, sf_dir, "listings", lambda path: Index.written(tables.listings(spark, sf_dir), path))


def text_index(spark: SparkSession, sf_dir: str) -> Index:
    docs = tables.corpus(spark, sf_dir)
    return _shared(spark, sf_dir, "documents", lambda path: Index.written(docs.select(F.col("doc_id").alias("id"), "title", "lang", "source"), path, lambda _: index.flat_terms(docs, "doc_id", "body")))


_made: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read: written by the first of a session that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = Tables(spark, "once").written(make())
    return _made[key]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six places, ties to even, as oracles do."""
    return df.withColumns({c: F.bround(c, 6) for c in columns})
