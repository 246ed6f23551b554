"""Token-id output: documents' ids in coded files in the shared folder, in ascending doc_id order, and back."""

from __future__ import annotations

import os
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, idcoder, wordpieces
from .common import scratch_path, span_hashes, written


@dataclass(frozen=True)
class IdFileParams:
    """file_ids: ids after which a file ends (with whole documents); partition_chars: about how many characters of text one task writes; chunk_chars: how many it encodes at a time."""

    end_id: int = 2
    block: int = 2048
    file_ids: int = 6_000_000
    partition_chars: int = 10_000_000
    chunk_chars: int = 250_000
    partitions: int = 0


class LibraryEncoder:
    """Ids by the tokenizers library, an end id after each text. It meets each distinct word once and the texts' ids are put together from those.

    Words are cut as numpy spans, looked up by a 64-bit hash, and new ones given to the library's model in its byte alphabet, which leaves
    out its own cutting. Texts with a special token or characters beyond the first plane go to the library whole.
    """

    def __init__(self, path: str, end_id: int, max_words: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = np.array([ord(c) for _, c in sorted(bpe.byte_symbols().items())], dtype="<u2")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_words, self.end_id = max_words, end_id
        self._reset()

    def _reset(self) -> None:
        self.words = wordpieces.WordTable()
        self.words.add(np.ones(1, dtype=np.uint64), np.array([self.end_id], dtype=np.int32), np.ones(1, dtype=np.int64))

    def _fresh(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of new words in turn, number of ids of each) of spans of code points."""
        points = bpe.gather(codes, starts, lengths)
        size = 1 + (points >= 128).view(np.int8) + (points >= 2048).view(np.int8)  # bytes in UTF-8
        cuts = np.cumsum(np.add.reduceat(size, np.cumsum(lengths) - lengths, dtype=np.int64)).tolist()
        raw = points.tobytes().decode("latin-1" if codes.itemsize == 1 else "utf-16-le").encode()
        text, tokenize = self.letters[np.frombuffer(raw, dtype=np.uint8)].tobytes().decode("utf-16-le"), self.model.tokenize
        ids, counts = [], []
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            word = [t.id for t in tokenize(text[a:b])]
            ids += word
            counts.append(len(word))
        return np.array(ids, dtype=np.int32), np.array(counts, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each), end ids counted; null counts as the empty text."""
        if self.words.count > self.max_words:
            self._reset()
        whole = {i: t for i, t in enumerate(texts) if t and (any(s in t for s in self.special) or wordpieces.outside(t))}
        codes, kind = wordpieces.coded(["" if i in whole else t or "" for i, t in enumerate(texts)])
        starts, ends = wordpieces.spans(codes, kind)
        last = np.flatnonzero(codes[starts] == wordpieces.END)
        hashes = span_hashes(codes, starts, ends)
        hashes[hashes < 2] = 2
        hashes[last] = 1
        numbers = self.words.find(hashes)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            fresh, at = np.unique(hashes[unknown], return_index=True)
            first = unknown[at]
            self.words.add(fresh, *self._fresh(codes, starts[first], ends[first] - starts[first]))
            numbers[unknown] = self.words.find(hashes[unknown])
        ids, lengths = self.words.runs(numbers)
        lengths = np.diff(np.cumsum(lengths)[last], prepend=0)
        if whole:
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i, e in zip(whole, self.tokenizer.encode_batch_fast(list(whole.values()), add_special_tokens=False), strict=True):
                parts[i] = np.array([*e.ids, self.end_id], dtype=np.int32)
            ids, lengths = np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        return ids, lengths


_ENCODERS: dict[tuple[str, int], LibraryEncoder] = {}


def _encoder(path: str, end_id: int) -> LibraryEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = LibraryEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_files(documents: DataFrame, tokenizer_path: str, params: IdFileParams = IdFileParams()) -> DataFrame:
    """Writes coded files of documents(doc_id, text, ...) in ascending doc_id order; returns path, first_doc, n_docs, n_ids, start of each file.

    Null ids come first; a null text has the end id only; repeated rows each count. Documents are dealt by ranges of doc_id and, so that
    one id with many texts is no hot task, of a hash of the text; each range is sorted in its task with spilling, so no task's memory grows
    with the table. The number of ranges comes from the number of rows and the mean length of a few; it decides sizes only. Files of lost
    attempts have names that the returned table doesn't hold. Only that table of files, a row for some millions of ids, is put in one order
    to add up the starts; it is written after that, as one Parquet file instead of one for each task.
    """
    p, target = params, scratch_path(documents.sparkSession, "ids")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = [r[0] or 0 for r in docs.select(F.length("text")).take(1000)]
    n = p.partitions or max(1, round(docs.count() * sum(few) / max(1, len(few)) / p.partition_chars))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = docs.repartitionByRange(n, *order).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches):
        store, root = pafs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        encoder = _encoder(tokenizer_path, p.end_id)
        doc, lengths, ids, size, turn = [], [], [], 0, 0

        def close():
            name = f"{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(idcoder.pack(np.array([d or 0 for d in doc], dtype=np.int64), np.array([d is None for d in doc]), np.concatenate(lengths), np.concatenate(ids), p.block))
            return pa.RecordBatch.from_arrays([pa.array([f"{target}/{name}"]), pa.array([doc[0]], pa.int64()), pa.array([len(doc)], pa.int64()), pa.array([size], pa.int64()), pa.array([turn], pa.int64())], ["path", "first_doc", "n_docs", "n_ids", "turn"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in bpe.pieces([len(t or "") for t in texts], p.chunk_chars):
                few, n_ids = encoder.encode(texts[lo:hi])
                doc += batch.column(0).slice(lo, hi - lo).to_pylist()
                lengths.append(n_ids)
                ids.append(few)
                size += len(few)
                if size >= p.file_ids:
                    yield close()
                    doc, lengths, ids, size, turn = [], [], [], 0, turn + 1
        if doc:
            yield close()

    files = ranged.mapInArrow(run, "path string, first_doc long, n_docs long, n_ids long, turn long")
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "turn", "path").rowsBetween(Window.unboundedPreceding, 0)
    return written(files.withColumn("start", F.sum("n_ids").over(order) - F.col("n_ids")).drop("turn"), "id-files")


def read_files(files: DataFrame, with_ids: bool = False, task_ids: int = 1_000_000) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document in files(path, n_ids, start, ...), from the files alone.

    Files are dealt to a task for each task_ids ids, or to as many as there are cores if that is more, and to no more tasks than files.
    """

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    doc, null, lengths, ids = idcoder.unpack(f.read())
                at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                raw, cuts = ids.astype("<u4").tobytes(), at.tolist()
                out = [pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(first + at[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    count, total = files.agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    n = max(1, min(count, max(files.sparkSession.sparkContext.defaultParallelism, -(-total // task_ids))))
    return files.select("path", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
