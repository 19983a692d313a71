"""One query per operator, over its whole table with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bayes, chat, jaccard, mixing, neighbours, packing, quality, sharding, toxicity, urls
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), size=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


ORACLES["op3_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.judged(read(spark, sf_dir, "documents"))
    return q.selectExpr("id as doc_id", *(f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "failed as base_failed", "kept")


@_query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(read(spark, sf_dir, "documents")).totals()


@_query
def op10_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


@_query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"))


@_query
def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_rows")


ORACLES["op1_extendible_sharding"] = """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT doc_id, n_bytes, depth, h >> (60 - depth) AS prefix FROM d, range(0, 31) t(depth)),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL HAVING sum(n_bytes) <= 1048576)
SELECT doc_id, n_bytes, min(depth)::INT AS depth, arg_min(CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END, depth) AS shard,
  arg_min(shard_bytes, depth) AS shard_bytes, arg_min(shard_rows, depth) AS shard_rows
FROM p JOIN s USING (depth, prefix) GROUP BY doc_id, n_bytes
"""


@_query
def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(read(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["length"].cast("string"))), ","))


ORACLES["op6_perspective_rotation"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
s AS (
  SELECT conv_id, speaker, turn, who, said, who = speaker AS own,
    CASE WHEN who = speaker THEN '<|im_start|>assistant' WHEN who = 'system' THEN '<|im_start|>system'
      ELSE '<|im_start|>user name=' || replace(translate(who, chr(10) || chr(13), '  '), '<|', '< |') END || chr(10) AS head,
    replace(said, '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY turn, who, said) - length(body) AS pos FROM s)
SELECT conv_id, 0::BIGINT AS part, 0::BIGINT AS start, speaker, count(*)::INT AS n_turns, string_agg(head || body, '' ORDER BY turn, who, said) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN pos::BIGINT || ':' || length(body) END, ',' ORDER BY turn, who, said), '') AS mask
FROM o GROUP BY conv_id, speaker
"""


@_query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@_query
def op8_hierarchical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bayes.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), F.col("host").alias("source"), F.col("path").alias("lang"), "evidence", "host_rate", "path_rate", "score", "kept")
