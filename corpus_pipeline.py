"""A corpus pipeline of five stages: toxic and poor documents go, one of each group of near-duplicates stays, documents with benchmark passages go, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, minhash, quality, toxicity
from tessera.llm.common import fresh_name, scratch_path, table
from tessera.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose whole text scores as toxic; a null text counts as empty. The classifier learns from the tables of sf_dir; without labels nothing goes."""
    params = toxicity.ToxicityParams()
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), params)
    return toxicity.filter_documents(docs, model, params.threshold, reject_at_least=True)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose whole text scores as poor; a null text counts as empty. The classifier learns from the tables of sf_dir; without labels nothing goes."""
    params = quality.QualityParams()
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), params)
    return toxicity.filter_documents(docs, model, params.threshold, reject_at_least=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, with the least doc_id; of repeated rows and of rows with one id one. Rows with a null id are no group and stay."""
    name, count = fresh_name("__kept", docs), fresh_name("__rows", docs)
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias(count))
    one = docs.join(kept, docs["doc_id"] == kept[name])
    repeated = one.where(F.col(count) > 1).dropDuplicates(["doc_id"])  # few rows as a rule, so no other text is sorted
    return one.where(F.col(count) == 1).unionByName(repeated).drop(name, count).unionByName(docs.where(docs["doc_id"].isNull()))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that hold windows of benchmark items; null texts, null ids and an empty benchmark lose nothing."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of each row; a null text counts as empty."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("encode", encode)]

ORACLE_SQL = None  # trained models, MinHash components and tokenizers are no SQL; tests hold the stages against brute force and planted rows


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
