"""Helpers that the operators of this subpackage share: table access, shared scratch space and vectorised text hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir. Only where one machine does all the work and it is unset, a local folder of the application."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/tessera-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_name(base: str, *frames: DataFrame) -> str:
    """A column name that no frame has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column: str, folds: int):
    """crc32 of the id as text modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, fold_count: int, held_out: int, per_class: int, max_chars: int):
    """At most per_class labelled texts of at most max_chars characters of each class, chosen by a hash of the id, as (texts, labels) on the driver.

    Rows of the held-out fold, rows without an id, label or text and ids with both labels never enter. An id counts once, with its least
    text, so the sample has 2 * per_class * max_chars characters at most, whatever the tables hold.
    """
    rows = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1)).where(fold("__id", fold_count) != held_out)
    rows = rows.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most")).where("__label = __most")
    chosen = None
    for value in (0, 1):
        part = rows.where(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(per_class).select("__id", "__label")
        chosen = part if chosen is None else chosen.unionByName(part)
    docs = documents.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text")).where(F.col("__text").isNotNull() & (F.length("__text") <= max_chars))
    found = docs.join(F.broadcast(chosen), docs["__doc"] == chosen["__id"])  # 2 * per_class ids at most
    got = found.groupBy("__id", "__label").agg(F.min("__text").alias("__text")).select("__id", "__text", "__label").collect()
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    return [r[1] for r in got], np.array([r[2] for r in got], dtype=np.float64)


_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 4096)
        _POWERS, _INVERSES = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, dtype=np.uint64)])) for x in (MULTIPLIER, _INVERSE))
    return _POWERS, _INVERSES


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a polynomial hash count."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for each span, all spans at once: differences of prefix sums of a polynomial, brought to one power."""
    power, inverse = _tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    terms = codes.astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[: len(codes)]
    np.cumsum(terms, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lowered, word starts, word ends) of words [^\\x20\\x09-\\x0D]+ in UTF-8."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; with fewer words the whole sequence is the one shingle; without words none."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    raw, starts, ends = byte_words(text)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    h = span_hashes(raw, starts, ends)
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        s = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            s = s * MULTIPLIER + h[i : len(h) - k + 1 + i]
        return np.unique(mix(s + np.uint64(k)))
