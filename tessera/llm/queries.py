"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, extract, idfiles, minhash, quality, shards, topk, toxicity, warc
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each whole document whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents")
    return topk.top_k(docs, docs.where("doc_id % 50 = 0").selectExpr("doc_id as query_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and slots of all documents by the law `rows`."""
    return shards.assign(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with windows of benchmark items, one row a pair."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates by sets of two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHashParams(words=2))


def op8_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as coded id files and read back."""
    files = idfiles.write_files(table(spark, sf_dir, "documents"), tokenizer_path(), idfiles.IdFileParams(end_id=2))
    return idfiles.read_files(files)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    files = warc.write_archives(table(spark, sf_dir, "pages"), warc.WarcParams(least=0))
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_topk, op3_quality, op4_extract, op5_shards, op6_decontaminate, op7_minhash, op8_idfiles, op9_warc, op10_toxicity)}

ORACLES: dict[str, str] = {}
