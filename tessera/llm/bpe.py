"""Byte-level BPE encoding and decoding by a pair occurrence index.

All distinct words of a batch lie in one symbol array. An index maps each adjacent pair that has a merge rank to all its positions;
the active ranks are applied in ascending order, each at all its positions at once, and only the lists of the pairs beside a merge
change. A merge makes only pairs of higher rank than its own (its product can't occur in an earlier merge), so one ascending sweep
gives what merging each word on its own gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The pre-tokenizer's pattern, and its letter, number and white-space classes below U+0250.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
BLANK = "\\x09-\\x0d\\x20\u0085 "

_WIDE = re.compile("[^\\x00-ɏ]")
_NARROW = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
_FULL = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is a visible Latin-1 character, else the next free one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PairIndexBPE:
    """Encoder and decoder for a tokenizer file; keeps the ids of at most max_words distinct words between batches."""

    def __init__(self, path: str, max_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.byte_id = np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left, self.right, self.made = (np.array([vocab[x] for x in col], dtype=np.int32) for col in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        keys = self.left.astype(np.int64) << 20 | self.right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        pieces = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces |= {i: s.encode() for s, i in self.special.items()}
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_len = np.array([len(p) for p in table], dtype=np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])
        self.piece_bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.max_words = max_words
        self._reset()

    def _reset(self) -> None:
        self.words = _Numbers()
        self.ids, self.at = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); NO_RANK where there is no merge."""
        want = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.order[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each)."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        n = int(lengths.sum())
        sym = np.full(n + 1, -1, dtype=np.int32)
        sym[:n] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        nxt = np.arange(1, n + 2)
        prv = np.arange(-1, n)
        nxt[ends[lengths > 0] - 1] = n
        prv[(ends - lengths)[lengths > 0]] = n
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(pos: np.ndarray) -> None:
            r = self.ranks(sym[pos], sym[nxt[pos]])
            keep = r != NO_RANK
            r, pos = r[keep], pos[keep]
            if not len(r):
                return
            by = np.argsort(r, kind="stable")
            r, pos = r[by], pos[by]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for rank, part in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(pos, cuts) if len(cuts) else [pos], strict=True):
                if rank in lists:
                    lists[rank].append(part)
                else:
                    lists[rank] = [part]
                    heapq.heappush(active, rank)

        add(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            parts = lists.pop(rank)
            pos = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.left[rank], self.right[rank]
            pos = pos[(sym[pos] == a) & (sym[nxt[pos]] == b)]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # of overlapping pairs in a run, the first, third, ...
                first = np.concatenate([[True], nxt[pos[:-1]] != pos[1:]])
                i = np.arange(len(pos))
                pos = pos[(i - np.maximum.accumulate(np.where(first, i, 0))) % 2 == 0]
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = self.made[rank]
            sym[gone] = -1
            nxt[pos] = after
            prv[after] = pos
            beside = np.concatenate([prv[pos], pos])
            beside = beside[beside < n]
            add(np.unique(beside) if len(pos) > 1 else beside)
        alive = sym[:n] >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        return sym[:n][alive], count[ends] - count[ends - lengths]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, start of each text's ids and the end of the last); null counts as the empty text."""
        if len(self.words) > self.max_words:
            self._reset()
        known, get = len(self.words), self.words.__getitem__
        rows, sizes = [], []
        for text in texts:
            found: list[int] = []
            for k, part in enumerate(self.split.split(text) if text and self.split and "<" in text else [text or ""]):
                if k % 2:
                    found.append(-1 - self.special[part])
                elif part:
                    found.extend(map(get, (_FULL if _WIDE.search(part) else _NARROW).findall(part)))
            rows.append(np.array(found, dtype=np.int32))
            sizes.append(len(found))
        if len(self.words) > known:
            fresh = list(self.words)[known:]
            ids, lengths = self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])
            self.ids = np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        words = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
        special = words < 0
        w = np.where(special, 0, words)
        lengths = np.where(special, 1, self.at[w + 1] - self.at[w]) if len(self.at) > 1 else np.ones(len(words), dtype=np.int64)
        ids = gather(self.ids if len(self.ids) else np.zeros(1, dtype=np.int32), np.where(special, 0, self.at[w]), lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        if special.any():
            ids[ends[:-1][special]] = -1 - words[special]
        return ids, ends[np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]).astype(np.int64)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """UTF-8 of the text of ids[at[i]:at[i+1]] for each i; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.piece_len[ids]
        raw = gather(self.piece_bytes, self.piece_at[ids], lengths).tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[at].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start:start+length] of each span in turn."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=values.dtype)
    for i in range(0, len(lengths), 100_000):  # the places of a part at a time, which are larger than the values
        n, e = lengths[i : i + 100_000], ends[i : i + 100_000]
        first = int(e[0] - n[0])
        out[first : int(e[-1])] = values[np.arange(first, int(e[-1])) + np.repeat(starts[i : i + 100_000] - (e - n), n)]
    return out


def pieces(n: list[int], most: int):
    """Ranges of rows whose sizes sum to at most `most`, or of one row."""
    start, total = 0, 0
    for i, x in enumerate(n):
        if total and total + x > most:
            yield start, i
            start, total = i, 0
        total += x
    if start < len(n):
        yield start, len(n)


_CODECS: dict[str, PairIndexBPE] = {}


def codec(path: str) -> PairIndexBPE:
    """One encoder for each worker process, so that its words serve later tasks too."""
    if path not in _CODECS:
        _CODECS[path] = PairIndexBPE(path)
    return _CODECS[path]


def encode_documents(documents: DataFrame, tokenizer_path: str, with_ids: bool = False, chunk_chars: int = 12_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with with_ids) of each row of documents(doc_id, text, ...).

    Every row gives a row, repeated rows and rows with a null id too; a null text counts as empty (no ids, empty decoded text). Other
    columns aren't read, whatever their names. No shuffle: a lost task is done again from its input split.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        bpe = codec(tokenizer_path)
        for batch in batches:
            doc, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in pieces([len(t or "") for t in texts], chunk_chars):
                ids, at = bpe.encode(texts[lo:hi])
                raw, cut = ids.astype("<u4").tobytes(), at.tolist()
                text: list = []  # of each document, or its hash where no one wants it
                for a, b in pieces(np.diff(at).tolist(), 400_000):
                    some = bpe.decode(ids[cut[a] : cut[b]], at[a : b + 1] - cut[a])
                    text += some if with_ids else [hashlib.sha256(t).hexdigest() for t in some]
                out = {
                    "doc_id": doc.slice(lo, hi - lo),
                    "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_sha256": [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                    "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in text] if with_ids else text,
                }
                if with_ids:
                    out |= {"ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), "decoded": [t.decode() for t in text]}
                yield pa.RecordBatch.from_pydict(out)

    return documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of each row of encoded(doc_id, ids array<int>); null ids give a null text."""

    def run(batches):
        bpe = codec(tokenizer_path)
        for batch in batches:
            ids, null = batch.column(1), batch.column(1).is_null().to_pylist()
            flat = [np.array(x or [], dtype=np.int64) for x in ids.to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
            text = bpe.decode(np.concatenate(flat).astype(np.int64) if flat else np.zeros(0, dtype=np.int64), at)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array([None if z else t.decode() for t, z in zip(text, null, strict=True)], pa.string())})

    return encoded.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(run, "doc_id long, text string")
