"""The words of a byte-level BPE's pre-tokenizer for many texts at once, as numpy spans, and a table of their ids."""

from __future__ import annotations

import functools
import re

import numpy as np
import regex

from . import bpe

END = 0  # a mark between texts; texts that hold it, or characters beyond the first plane, are not for spans()
_LETTER, _NUMBER, _BLANK, _OTHER, _END = range(5)
_beyond = re.compile("[\ud800-\udfff\U00010000-\U0010ffff]").search


def outside(text: str) -> bool:
    return "\0" in text or (not text.isascii() and _beyond(text) is not None)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(1 << 16, _OTHER, dtype=np.uint8)
    every = "".join(chr(i) for i in range(1 << 16) if not 0xD800 <= i < 0xE000)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_BLANK, r"\p{White_Space}")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    out[END] = _END
    return out


_SUFFIXES = [(c, 0) for c in "stmd"] + [("r", ord("e")), ("v", ord("e")), ("l", ord("l"))]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their classes) of texts in turn, each followed by END; no text may be outside()."""
    text = "\0".join(texts) + "\0"
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-16-le"), dtype=np.uint16)
        return codes, _classes()[codes]
    return np.frombuffer(raw, dtype=np.uint8), np.frombuffer(raw.translate(_classes()[:256].tobytes()), dtype=np.uint8)


def spans(codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of coded() texts; the END marks are spans too.

    A word is a run of one class with the space before it; of a run of blanks before something else the last one stands alone or, if it is
    a space, goes to what follows; 's, 't, 're, 've, 'm, 'll, 'd are words where an apostrophe begins one.
    """
    n = len(codes)
    begins = np.ones(n, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[codes == END] = True
    blank, space = kind == _BLANK, codes == 32
    filled = begins & (kind < _END) & ~blank
    after = np.flatnonzero(filled[1:] & blank[:-1])  # the last blanks before something else
    begins[after] = True
    begins[after[space[after]] + 1] = False
    quote = np.flatnonzero((codes[:-2] == 39) & begins[:-2] & (kind[1:-1] == _LETTER))
    if len(quote):
        one, two = codes[quote + 1], codes[quote + 2]
        size = np.zeros(len(quote), dtype=np.int64)
        for first, second in _SUFFIXES:
            size[(one == ord(first)) & ((two == second) if second else True) & (size == 0)] = 3 if second else 2
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        begins[quote + size] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n)


class WordTable:
    """A hash table from 64-bit word hashes to runs of ids, in numpy: lookups of many words at once by linear probing."""

    def __init__(self, log: int = 16):
        self.log = log
        self.keys, self.values = np.zeros(1 << log, dtype=np.uint64), np.zeros(1 << log, dtype=np.int32)
        self.ids, self.size = np.zeros(1 << 16, dtype=np.int32), 0
        self.entries, self.count = np.zeros(1 << 14, dtype=np.int64), 0  # start << 24 | length of each word's ids

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for unknown ones. Hashes are never 0."""
        mask = np.uint64((1 << self.log) - 1)
        place = (hashes & mask).astype(np.int64)
        key = self.keys[place]
        out = np.where(key == hashes, self.values[place], -1)
        left = np.flatnonzero((key != hashes) & (key != 0))
        place = place[left]
        while len(left):
            place = place + 1 & int(mask)
            key = self.keys[place]
            hit = key == hashes[left]
            out[left[hit]] = self.values[place[hit]]
            go = ~hit & (key != 0)
            left, place = left[go], place[go]
        return out

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        place = (hashes & np.uint64((1 << self.log) - 1)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.keys[place] == 0)
            self.keys[place[free]], self.values[place[free]] = hashes[free], numbers[free]
            rest = self.keys[place] != hashes  # those whose place another one has
            hashes, numbers, place = hashes[rest], numbers[rest], (place[rest] + 1) & (1 << self.log) - 1

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Adds different words that are not in the table, with their ids in turn."""
        first = self.count
        if 2 * (first + len(hashes)) > 1 << self.log:
            old_keys, old_values = self.keys[self.keys != 0], self.values[self.keys != 0]
            self.log = max(self.log, (2 * (first + len(hashes))).bit_length())
            self.keys, self.values = np.zeros(1 << self.log, dtype=np.uint64), np.zeros(1 << self.log, dtype=np.int32)
            self._put(old_keys, old_values)
        self._put(hashes, np.arange(first, first + len(hashes)))
        for name, values, used in (("entries", self.size + np.cumsum(lengths) - lengths << 24 | lengths, first), ("ids", ids, self.size)):
            room = getattr(self, name)
            if used + len(values) > len(room):
                room = np.concatenate([room, np.zeros(max(len(room), len(values)), dtype=room.dtype)])
                setattr(self, name, room)
            room[used : used + len(values)] = values
        self.count += len(hashes)
        self.size += len(ids)

    def runs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words in turn, number of ids of each)."""
        e = self.entries[numbers]
        lengths = e & (1 << 24) - 1
        return bpe.gather(self.ids, e >> 24, lengths), lengths
