"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``:

* language: documents whose language can't be told (no letters, or a score under one half) go;
* quality: documents go that fail the base rules or whose n-gram log-likelihood ratio is under the threshold;
* near_duplicates: of each group linked by SimHash fingerprints the document with the smallest doc_id stays;
* decontamination: passages of the benchmark are cut out, and documents that are mostly such passages go;
* packing: what is left is packed into sequences of 4,096 tokens; one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import decontamination, language, packing, quality, simhash
from voxframe.llm._common import table, written
from voxframe.llm.tokenization import vocabulary_path


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep(docs, language.fit(docs, vocabulary_path("piece_bpe_32k.model")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", tell_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: Trained models and fingerprints have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
