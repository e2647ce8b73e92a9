"""Registered queries of the operators, over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.llm import (
    decontaminate,
    language_id,
    lexical,
    licenses,
    mixing,
    neighbours,
    packing,
    quality,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    whitening,
)
from meterlight.llm.common import read
from meterlight.llm.encoders import vocabulary

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.by_moment(mixing.mix(read(spark, folder, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "moment")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, folder, "labels")))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    counted = token_counts.count_documents(docs, vocabulary(WORD_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, folder, "documents"))


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return packing.pack_documents(docs, vocabulary(WORD_BPE))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return language_id.predict(docs, language_id.learn(docs))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_documents(read(spark, folder, "documents"), vocabulary(PIECE_BPE))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"), shingle=3, distance=2)
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judge(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank_documents(read(spark, folder, "documents"), read(spark, folder, "benchmark"), k=10)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"), k=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_toxicity,
        op3_token_counts,
        op4_suffix_dedup,
        op5_neighbours,
        op6_packing,
        op7_language_id,
        op8_quality,
        op9_licenses,
        op10_simhash,
        op11_decontamination,
        op12_search,
        op13_whitening,
    )
}
ORACLES: dict[str, str] = {
    "op9_licenses": licenses.sql(),
    "op11_decontamination": decontaminate.sql(),
    "op12_search": lexical.sql(),
}
