"""The registered queries of the operators: thin applications to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.llm import ann, bpe, chat_format, langid, license_scan, lm_scoring, mixing, ngram_jaccard, quality, toxicity
from veridelta.llm.common import crc_mod, table

QUERIES = {}
ORACLE_SQL = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.predict(docs, langid.learn(docs)).withColumn("held_out", crc_mod("doc_id", 5) == 0)


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL["op6_quality_rules"] = quality.ORACLE_SQL


@_query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


ORACLE_SQL["op7_chat_formatting"] = chat_format.ORACLE_SQL


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs, ["doc_id", "source"], with_plan=True)


@_query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    index = toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, index).withColumn("held_out", crc_mod("doc_id", 5) == 0)


@_query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_held_out(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL["op2_ngram_jaccard"] = ngram_jaccard.ORACLE_SQL
