"""A training-data pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridelta.llm import bpe, langid, mixing, ngram_jaccard, quality
from veridelta.llm.common import bounded_batches, shared_dir, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with calibrated confidence stay."""
    docs = docs.select(*COLUMNS)
    return langid.keep(docs, COLUMNS, langid.learn(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the limits of repetition stay."""
    return quality.keep(docs.select(*COLUMNS), COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies stays."""
    return ngram_jaccard.keep_one(docs.select(*COLUMNS), COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's weight draws them: zero, one or more times."""
    return mixing.mix(docs.select(*COLUMNS), COLUMNS, max_repeats=2.0)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digests of its round trip."""
    return bpe.digests(docs.select(*COLUMNS), with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing", mix_sources),
    ("byte-level BPE", byte_level_bpe),
]

#: A trained classifier and a tokenizer: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    base = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, base, f"stage-{at}")
    return docs
