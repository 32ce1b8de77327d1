"""The corpus pipeline: each stage takes what the one before it kept, and hands on the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempofold.llm import common, decontam, exact, jaccard, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from the labels of the documents given."""
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, white space aside, the one with the smallest id stays."""
    return exact.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by a similarity of 0.8 or more, the one with the smallest id stays."""
    return jaccard.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, as pieces of sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]
#: Learned scores, sketches and ids of a tokenizer are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{k}")
    return docs
