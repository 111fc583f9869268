"""The queries of the training-data operators: (spark, sf_dir) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, html_blocks, language, licenses, packing, quality, sharding, simhash, token_files
from ._common import table
from .tokenization import vocabulary_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=1)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.layout(16), sharding.layout(17))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, vocabulary_path("piece_bpe_32k.model"), ~language.held_out(F.col("doc_id")))
    return language.predict(docs, model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_chat": op2_chat,
    "op3_licenses": op3_licenses,
    "op4_html": op4_html,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_sharding": op8_sharding,
    "op9_token_files": op9_token_files,
    "op10_language": op10_language,
}



def oracle_sql() -> dict[str, str]:
    """A function, as the licence scan's SQL holds a classifier that is trained first."""
    return {
        "op2_chat": chat.rotate_sql(),
        "op3_licenses": licenses.scan_sql(),
        "op7_decontamination": decontamination.digest_sql(),
    }
