"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language_id, media, metric_search, mixing, near_dedup, packing, secret_scan, token_count, toxicity, warc
from lectern.llm.common import table

TOXIC_FROM = 0.3


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train_on(docs))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op7_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"), max_repeats=2.0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secret_scan, op2_packing, op3_toxicity, op4_token_counts, op5_warc, op6_media_columns, op7_metric_search, op8_language_id, op9_source_mixing, op10_near_duplicates)
    return {f.__name__: f for f in found}


WARC_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM r
"""

SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

MIXING_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, (strlen(coalesce(text, '')) + 3) // 4 AS tokens FROM documents
), t AS (
  SELECT key, sum(tokens)::BIGINT AS total FROM d GROUP BY key HAVING sum(tokens) > 0
), a AS (
  SELECT sum(total)::BIGINT AS tokens, CASE WHEN max(total) <= 2 * min(total) THEN 0.0 ELSE round(1 - ln(2) / ln(max(total)::DOUBLE / min(total)), 9) END AS a FROM t
), w AS (
  SELECT key, total, pow(total::DOUBLE / tokens, a - 1) / (SELECT min(pow(total::DOUBLE / tokens, a - 1)) FROM t, a) AS epochs,
         greatest(ceil(total / greatest({mixing.LEAST_BLOCK}, ceil(tokens / {mixing.BLOCKS}))), {mixing.FINE})::BIGINT AS blocks
  FROM t, a
), b AS (
  SELECT d.*, total, epochs, CASE WHEN blocks IS NULL THEN NULL ELSE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks END AS block
  FROM d LEFT JOIN w USING (key)
), s AS (
  SELECT key, block, sum(tokens) AS tokens, any_value(total) AS total, any_value(epochs) AS epochs FROM b WHERE block IS NOT NULL GROUP BY key, block
), e AS (
  SELECT *, unnest(range(0, greatest(ceil(epochs)::BIGINT, 1))) AS epoch FROM s
), o AS (
  SELECT *, row_number() OVER one - 1 AS block_rank, sum(tokens) OVER (one ROWS UNBOUNDED PRECEDING) AS used FROM e
  WINDOW one AS (PARTITION BY key, epoch ORDER BY md5(key || ':' || block || ':' || epoch), block)
), c AS (
  SELECT key, block, epoch, block_rank FROM o WHERE epoch + 1 <= epochs OR used <= (epochs - epoch) * total
)
SELECT doc_id, source, tokens::BIGINT AS tokens, coalesce(epoch, 0)::BIGINT AS epoch, coalesce(b.block, 0)::BIGINT AS block, coalesce(block_rank, 0)::BIGINT AS block_rank
FROM b LEFT JOIN c ON b.key = c.key AND b.block = c.block WHERE c.epoch IS NOT NULL OR b.block IS NULL
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS found
  FROM w
), n AS (SELECT doc_id, len(found)::BIGINT AS n FROM s
), x AS (SELECT doc_id, hash(shingle) AS shingle FROM (SELECT doc_id, unnest(found) AS shingle FROM s)
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS other FROM sides UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON e.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(component_id, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN least USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": WARC_SQL, "op7_metric_search": SEARCH_SQL, "op9_source_mixing": MIXING_SQL, "op10_near_duplicates": NEAR_SQL}
