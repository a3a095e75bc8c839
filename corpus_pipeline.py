"""A training corpus from raw documents: language, quality, near duplicates, passages, packing.

run() applies STAGES to the documents of a folder. Each stage takes (spark, docs, sf_dir) and gives
a DataFrame, which is written as Parquet to the shared folder and read again as the next one's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from martwright.llm import language_id, packing, quality, simhash, suffix_dedup
from martwright.llm.common import read_documents, send_package
from martwright.llm.queries import learned_languages
from martwright.sources.tables import shared_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those that no learned language fits go; null lang is filled."""
    return language_id.keep_languages(docs, learned_languages(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules or that the trees score below one half go."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, model)


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return simhash.keep_first(docs, width=4, bits=4)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier go from the texts; emptied documents go."""
    return suffix_dedup.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in training sequences."""
    return packing.pack_documents(docs)


def _sent(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        send_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _sent(known_language)),
    ("quality", _sent(good_quality)),
    ("simhash", _sent(first_of_near_duplicates)),
    ("suffix_dedup", _sent(without_repeated_passages)),
    ("best_fit_packing", _sent(packed)),
]

#: Contexts, trees and packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/corpus/{uuid.uuid4().hex}"
    docs = read_documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
