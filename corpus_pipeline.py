"""From documents to token ids in five stages; each works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import mixing, ngram_join, pieces, pii, toxicity
from siftwork.llm.common import materialize, small_batches, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity net does not reject."""
    small_batches(spark)
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 5-word shingles make."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    small_batches(spark)
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document may stand in it twice."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and the hash of the decoded text, of each row."""
    small_batches(spark)
    return pieces.digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", clean), ("ngram_jaccard_join", distinct), ("pii", private), ("source_mix", mixed), ("sentencepiece", encoded)]

#: A trained net, a random field and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
