"""The numbered queries, each a thin use of its operator over a whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import audio, embeddings, mixing, ngram_join, pages, pieces, pii, token_files, toxicity, warc
from siftwork.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(audio.read_tensors(audio.store_tensors(audio.write_media(table(spark, sf_dir, "documents")))))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.digest(table(spark, sf_dir, "pages"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.links(table(spark, sf_dir, "embeddings"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_ngram_join": op2_ngram_join,
    "op4_warc": op4_warc,
    "op5_audio_features": op5_audio_features,
    "op3_token_files": op3_token_files,
    "op6_pieces": op6_pieces,
    "op7_main_text": op7_main_text,
    "op8_embeddings": op8_embeddings,
    "op9_source_mix": op9_source_mix,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op4_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
""",
    "op9_source_mix": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h, md5(coalesce(text, '')) AS t
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, list_extract([3, 1, 2], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)) AS weight FROM sizes),
levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * (SELECT CAST(sum(source_size) AS BIGINT) FROM ranked) - 2 * coalesce(CAST(sum(source_size) OVER w AS BIGINT), 0))
         / ((SELECT CAST(sum(weight) AS BIGINT) FROM ranked) - coalesce(CAST(sum(weight) OVER w AS BIGINT), 0)) AS level
  FROM ranked WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (
  SELECT (SELECT level FROM levels WHERE level * weight <= 2 * source_size ORDER BY source_size / weight, source IS NULL, source LIMIT 1) AS level),
plan AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), coalesce(chosen.level * weight, CAST(2 * source_size AS DOUBLE))) AS target
  FROM ranked, chosen),
placed AS (
  SELECT d.*, p.source_size, p.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
offers AS (
  SELECT size, (upto + k * source_size) / target AS finish FROM placed, (VALUES (0), (1)) AS c(k) WHERE size > 0 AND target > 0),
run AS (
  SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS words FROM offers GROUP BY finish),
lim AS (
  SELECT max(finish) AS last FROM run WHERE words <= (SELECT CAST(1.5 AS DOUBLE) * sum(size) FROM docs))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size > 0 AND target > 0
            THEN size * (CAST(upto / target <= last AS INT) + CAST((upto + source_size) / target <= last AS INT)) ELSE 0 END AS BIGINT) AS taken
FROM placed, lim
""",
}
