"""The registered queries over the shared tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, language_model, packing, pii, quality, simhash, site_tree, substrings
from .shared import ship

VOCABULARY = packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), key="demonstration key").select("doc_id", "text", "n_pseudonyms")


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), VOCABULARY).drop("ids")


def op3_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], own.schema)
    return chat.digests(chat.formatted(own.union(extra)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return quality.scored(documents, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op5_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_window_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"))


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = simhash.groups(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_benchmark_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents")).drop("row_no", "text_key")


QUERIES = {f.__name__: f for f in (op1_feistel_pii, op2_harmonic_packing, op3_prefix_targets, op4_quality_classifier, op5_attention_scores, op6_window_doubling, op7_site_style_tree, op8_simhash_vp, op9_benchmark_wand, op10_extendible_dedup)}

OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
  SELECT *, length('<turn role=""></turn>' || chr(10))
    + length(replace(replace(role, '\', '\\'), '"', '\"')) + length(replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn')) AS chars
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
lost AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE m < doc_id),
sequences AS (SELECT sha256(array_to_string(ws, ' ')) AS s, min(coalesce(doc_id, 9223372036854775807)) AS keeper, any_value(ws) AS ws FROM w GROUP BY 1),
starts AS (SELECT 50 AS level, s, keeper, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT s, keeper, ws, unnest(range(1, len(ws) - 48)) AS i FROM sequences)),
grown(level, s, keeper, i, k) AS (
  SELECT * FROM starts QUALIFY min(keeper) OVER (PARTITION BY k) < max(keeper) OVER (PARTITION BY k) UNION ALL
  SELECT * FROM (SELECT 2 * a.level, a.s, a.keeper, a.i, md5(a.k || b.k) AS k2 FROM grown a JOIN grown b ON a.s = b.s AND b.i = a.i + a.level) QUALIFY min(keeper) OVER (PARTITION BY k2) < max(keeper) OVER (PARTITION BY k2)),
reached AS (SELECT s, max(level) AS level FROM grown GROUP BY s),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN lost USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(level, 0)::BIGINT AS longest_repeat
FROM w LEFT JOIN kept USING (r) LEFT JOIN reached ON s = sha256(array_to_string(ws, ' '))
"""

ORACLE_SQL = {"op6_window_doubling": OP6_SQL, "op3_prefix_targets": OP3_SQL, "op10_extendible_dedup": OP10_SQL}
