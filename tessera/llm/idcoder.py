"""Adaptive context-mixing coder for token ids, in independently reset, checksummed blocks.

All blocks of a call are coded in step, one id of each at a time, as numpy lanes. Each id is the predicted one or not, whose probability
comes first. The prediction is the id that followed the last two ids last time (order 2) or, where they are no known context, the last id
alone (order 1). The probability that it holds mixes what was seen in the block under its order and confidence with what was seen in the
block as a whole; the weight of the second is learned in each block, as the one of WEIGHTS whose forecasts were best so far; it is taken
anew at the steps of refreshed(). Another id is coded by its share in one of a few tables (order 0) that the file keeps once for all
blocks: the coder finds kinds of text (languages, say) by assigning segments of SEGMENT ids to the table that codes them shortest, and
each block names the table of each of its segments.

The entropy coder is an asymmetric numeral system, whose coder works from the last id to the first: a first pass finds the predictions,
then the tables are made of the ids that were not predicted, and a second pass codes. All that the decoder computes is integers, so both
agree everywhere; only the coder's search for kinds of text uses floats.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TIDS5\n"
SLOTS_LOG = 8
FLAG_BITS = 12
SEGMENT = 64
U, I = np.uint64, np.int64
LEAST = U(1 << 32)
ONE = 1 << FLAG_BITS
CONTEXTS = 16
WEIGHTS = (1, 4, 16, 64)
PART = U((1 << 20) - 1)
MULTIPLIER = U(0x9E3779B97F4A7C15)
BOTH = U(1 << 26 | 1)  # a one in each of the two entries of a table's word
FOURS, IDS = U(4 * (1 << 26 | 1)), U(((1 << 24) - 1) * (1 << 26 | 1))
EMPTY = 256 << 52 | ((1 << 26) - 2) * (1 << 26 | 1)  # a tag that no id has, and entries of an id that no id is, of confidence 2
N = tuple(U(i) for i in range(64))
PLACE, TAGS, WORD = U((1 << 24) - 1), U(255 << 52), U((1 << 32) - 1)
CHANCES, SPAN = U(ONE - 1), U((1 << 21) - 1)
SAMPLE, ROUNDS = 4096, 3  # segments on which tables are found, and rounds after each new one


def refreshed(step: int) -> bool:
    """Whether probabilities are taken anew before this step: at 32, 64, 128 and each 256th."""
    return step in (32, 64, 128) or (step > 0 and step % 256 == 0)


def _sizes(n: int, block: int) -> np.ndarray:
    full, rest = divmod(n, block)
    return np.array([block] * full + [rest] * (rest > 0), dtype=np.int64)


def _rounded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: up to 15 as they are, then by their four highest bits."""
    bits = np.frexp(counts.astype(np.float64))[1].astype(I)
    return np.where(counts < 16, counts, (bits - 4 << 3) + (counts >> np.maximum(bits - 4, 0))).astype(np.uint8)


def _unrounded(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(I)
    bits = np.maximum((c >> 3) - 1, 1)
    return np.where(c < 16, c, (((c & 7) + 8 << 1) + 1) << bits - 1)


class Prior:
    """The tables of shares, in 1/2**bits, of a file's ids; ids are known by their place in `ids` plus one. codes: by table and place, the id's count as of _rounded()."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.bits = max(16, int(len(ids)).bit_length() + 1)
        if self.bits > 20:
            raise ValueError("too many different ids in a file")
        self.ids, self.codes = ids, codes
        self.sizes = np.zeros(codes.shape, dtype=I)
        for size, counts in zip(self.sizes, _unrounded(codes), strict=True):
            if not counts.any():
                counts[:1] = 1
            room = over = 1 << self.bits
            while len(ids) and over > 0:  # each id that occurs has one share at least
                size[:] = np.maximum(counts * max(room, 0) // counts.sum(), counts > 0)
                over = int(size.sum()) - (1 << self.bits)
                room -= over
            if len(ids):
                size[size.argmax()] -= over
        self.starts = np.cumsum(self.sizes, axis=1) - self.sizes

    @property
    def class_bits(self) -> int:
        return (len(self.codes) - 1).bit_length()

    def for_coder(self) -> np.ndarray:
        """By table and 1 + place: whether coded << 63 | bits << 42 | start << 21 | size; 0 stands for a predicted id."""
        out = np.ones((len(self.codes), len(self.ids) + 1), dtype=U)
        out[:, 1:] = (1 << 63 | self.bits << 42) | (self.starts << 21 | self.sizes).astype(U)
        return out.ravel()

    def for_decoder(self) -> np.ndarray:
        """By table and slot: size << 40 | 1 + place << 20 | slot - start."""
        size = self.sizes.ravel()
        place = np.tile(np.arange(1, len(self.ids) + 1), len(self.codes))
        slot = np.arange(len(self.codes) << self.bits) & (1 << self.bits) - 1
        return (np.repeat(size << 40 | place << 20, size) | slot - np.repeat(self.starts.ravel(), size)).astype(U)

    def dumped(self) -> bytes:
        steps = np.diff(self.ids.astype(np.uint32), prepend=np.uint32(0))
        return struct.pack("<2I", len(self.ids), len(self.codes)) + zlib.compress(steps.astype("<u4").tobytes() + self.codes.tobytes(), 6)

    @classmethod
    def loaded(cls, raw: bytes) -> Prior:
        n, tables = struct.unpack("<2I", raw[:8])
        both = zlib.decompress(raw[8:])
        return cls(np.cumsum(np.frombuffer(both[: 4 * n], "<u4"), dtype=np.uint32), np.frombuffer(both[4 * n :], np.uint8).reshape(tables, n))


class _Model:
    """State of all lanes: the ids that followed a context and the probabilities in 1/4096 that a prediction holds.

    A table's word holds the tag of the id before << 52 | order-2 entry << 26 | order-1 entry; an entry is an id of 24 bits and a
    confidence: 0 seen once, 1 twice, 3 oftener, 2 never.
    """

    def __init__(self, lanes: int, steps: int):
        self.lanes = lanes
        self.slot, self.row = np.arange(lanes, dtype=U) << N[SLOTS_LOG], np.arange(lanes, dtype=U) << N[4]
        self.table = np.full(lanes << SLOTS_LOG, EMPTY, dtype=U)
        self.record, self.every = np.zeros((steps, lanes), dtype=np.uint8), np.arange(lanes) << 5
        self.hits, self.trials = np.zeros((lanes, CONTEXTS), dtype=I), np.zeros((lanes, CONTEXTS), dtype=I)
        self.cost = np.zeros((len(WEIGHTS), lanes), dtype=I)
        self.forecasts: list[np.ndarray] = []
        self.at, self.word, self.guess, self.next_tag, self.two, self.ctx, self.share, self.tmp, self.tmp2 = (np.zeros(lanes, dtype=U) for _ in range(9))
        self.missed_row, self.last, self.tag, self.since = self.row.copy(), np.zeros(lanes, dtype=U), np.zeros(lanes, dtype=U), 0
        self.refresh(0)

    def refresh(self, step: int) -> None:
        """The probabilities up to the next refresh, from the contexts and outcomes recorded since the last."""
        seen = np.bincount((self.record[self.since : step] + self.every).ravel(), minlength=self.lanes << 5).reshape(self.lanes, 2, CONTEXTS)
        right, wrong = seen[:, 0], seen[:, 1]
        for cost, p in zip(self.cost, self.forecasts, strict=False):
            cost += (right * (ONE - p) ** 2 + wrong * p**2).sum(axis=1) >> FLAG_BITS
        self.hits += right
        self.trials += right + wrong
        every = ((self.hits.sum(axis=1) + 1 << FLAG_BITS) // (self.trials.sum(axis=1) + 8))[:, None]
        self.forecasts = [((self.hits << FLAG_BITS) + w * every) // (self.trials + w) for w in WEIGHTS]
        p = np.choose(self.cost.argmin(axis=0)[:, None], self.forecasts)
        self.shares, self.since = ((p * 127 >> 7) + 16).astype(U).ravel(), step

    def predict(self) -> np.ndarray:
        """The share of the prediction, self.guess, in 1/4096: 16 to 4,080."""
        h, at, e, two, best, ctx = self.tmp, self.at, self.word, self.two, self.guess, self.ctx
        np.multiply(self.last, MULTIPLIER, out=h)
        np.right_shift(h, N[64 - SLOTS_LOG], out=at)
        np.add(at, self.slot, out=at)
        self.table.take(at.view(I), out=e, mode="clip")
        np.left_shift(h, N[4], out=h)
        np.bitwise_and(h, TAGS, out=self.next_tag)
        np.bitwise_xor(e, self.tag, out=two)
        np.right_shift(two, N[52], out=two)
        np.subtract(two, N[1], out=two)
        np.right_shift(two, N[63], out=two)  # 1 where the tags agree
        np.multiply(two, N[26], out=best)
        np.right_shift(e, best, out=best)
        np.bitwise_and(best, N[3], out=ctx)
        np.left_shift(two, N[2], out=two)
        np.add(ctx, two, out=ctx)
        np.add(ctx, self.missed_row, out=ctx)
        np.right_shift(best, N[2], out=best)
        np.bitwise_and(best, PLACE, out=best)
        return self.shares.take(ctx.view(I), out=self.share, mode="clip")

    def update(self, step: int, ids: np.ndarray, missed: np.ndarray) -> None:
        """missed: 1 where the prediction failed, else 0."""
        e, x, c = self.word, self.tmp, self.tmp2
        np.bitwise_and(self.ctx, N[15], out=c)
        np.left_shift(missed, N[4], out=x)
        np.add(x, c, out=x)
        self.record[step] = x
        np.left_shift(missed, N[3], out=c)
        np.add(self.row, c, out=self.missed_row)
        np.multiply(ids, FOURS, out=x)
        np.bitwise_xor(e, x, out=e)
        np.left_shift(e, N[1], out=c)
        np.bitwise_or(c, BOTH, out=c)  # the next confidences: 0, 1, 3, 3
        np.right_shift(e, N[2], out=e)
        np.bitwise_and(e, IDS, out=e)
        np.add(e, IDS, out=e)
        np.right_shift(e, N[24], out=e)
        np.bitwise_and(e, BOTH, out=e)
        np.bitwise_xor(e, BOTH, out=e)  # 1 in the entries that have this id
        np.multiply(e, N[3], out=e)
        np.bitwise_and(c, e, out=c)
        np.bitwise_or(c, x, out=c)
        np.bitwise_or(c, self.tag, out=c)
        self.table[self.at.view(I)] = c
        np.copyto(self.last, ids)
        self.tag, self.next_tag = self.next_tag, self.tag


def _groups(sizes: np.ndarray, lanes: int):
    """Groups of at most `lanes` blocks, of about equal numbers."""
    lanes = -(-len(sizes) // max(1, -(-len(sizes) // lanes))) or 1
    for first in range(0, len(sizes), lanes):
        yield first, sizes[first : first + lanes]


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transposed table, some rows at a time, so that what is read stays in the cache."""
    out = np.empty(rows.shape[::-1], dtype=rows.dtype)
    for i in range(0, len(rows), 64):
        out[:, i : i + 64] = rows[i : i + 64].T
    return out


def _unpredicted(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By step and lane: the id where it is not the predicted one, else 0; and the share of the prediction."""
    steps, n = columns.shape
    coded, shares = np.empty((steps, n), dtype=np.uint32), np.empty((steps, n), dtype=np.uint16)
    model, x, missed, wrong = _Model(n, steps), np.empty(n, dtype=U), np.empty(n, dtype=U), np.empty(n, dtype=bool)
    for step in range(steps):
        if refreshed(step):
            model.refresh(step)
        np.copyto(x, columns[step])
        shares[step] = model.predict()
        np.not_equal(x, model.guess, out=wrong)
        np.copyto(missed, wrong)
        np.multiply(columns[step], wrong, out=coded[step])
        model.update(step, x, missed)
    return coded, shares


def _counts(coded: list[np.ndarray], kinds: list[np.ndarray], tables: int, n: int) -> np.ndarray:
    """By table and id, how often it is coded by that table."""
    out = np.zeros(tables * (n + 1), dtype=I)
    for some, kind in zip(coded, kinds, strict=True):
        for i in range(0, len(kind), 8):
            part = some[i * SEGMENT : (i + 8) * SEGMENT]
            out += np.bincount((part + np.repeat(kind[i : i + 8] * (n + 1), SEGMENT, axis=0)[: len(part)]).ravel(), minlength=len(out))
    return out.reshape(tables, n + 1)[:, 1:]


def _lengths(coded: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By segment, table and lane, about how many sixteenths of a bit the tables of these counts take; the tables are summed four in a word."""
    share = (counts + 1 / 16 * (1 + counts.sum(axis=0)) / (1 + counts.sum())) / (counts.sum(axis=1, keepdims=True) + 1 / 8)
    cost = np.clip(np.rint(-16 * np.log2(np.maximum(share, 1e-30))), 0, 511).astype(U)
    out = np.empty((-(-len(coded) // SEGMENT), len(counts), coded.shape[1]), dtype=np.int32)
    for first in range(0, len(counts), 4):
        four = np.zeros(counts.shape[1] + 1, dtype=U)
        for i, c in enumerate(cost[first : first + 4]):
            four[1:] |= c << N[16 * i]
        for i in range(len(out)):
            both = four.take(coded[i * SEGMENT : (i + 1) * SEGMENT]).sum(axis=0)
            for j in range(first, min(first + 4, len(counts))):
                out[i, j] = both >> N[16 * (j - first)] & U(0xFFFF)
    return out


def _kinds(coded: list[np.ndarray], n: int, most: int) -> tuple[list[np.ndarray], int]:
    """(by segment and lane the number of its table, for each group; number of tables).

    Tables are found on some thousand segments: each new one begins with the segments that those before it code worst, and then segments
    go to the table that codes them shortest and tables are counted anew, in turn.
    """
    lanes = sum(c.shape[1] for c in coded)
    tables = min(most, 1 << max(0, (sum(c.size for c in coded) >> 14).bit_length() // 2))
    some = np.concatenate([c[:, :: max(1, lanes * len(c) // SEGMENT // SAMPLE)] for c in coded if len(c) == len(coded[0])], axis=1)
    kind = np.zeros((-(-len(some) // SEGMENT), some.shape[1]), dtype=I)
    counts = _counts([some], [kind], 1, n)
    while len(counts) < tables:
        best = _lengths(some, counts).min(axis=1)
        kind[best >= np.quantile(best, 1 - 0.5 / (len(counts) + 1))] = len(counts)
        for _ in range(ROUNDS):
            counts = _counts([some], [kind], max(len(counts), int(kind.max()) + 1), n)
            kind = _lengths(some, counts).argmin(axis=1)
    return [_lengths(c, counts).argmin(axis=1) for c in coded], tables


def _coded(coded: np.ndarray, shares: np.ndarray, kind: np.ndarray, prior: Prior, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit words by row and lane, first row of each lane): the lanes' states, from the last id to the first, with the words that leave them."""
    steps, n = coded.shape
    words, place = np.empty((steps + 2) * n, dtype=np.uint32), np.arange(n) + (steps + 1) * n
    state = np.full(n, LEAST, dtype=U)
    a, e, f, rest, missed, size, need, q = (np.empty(n, dtype=U) for _ in range(8))
    at, over, base = np.empty(n, dtype=I), np.empty(n, dtype=bool), None
    for step in range(steps - 1, -1, -1):
        if base is None or step % SEGMENT == SEGMENT - 1:
            base = kind[step // SEGMENT] * (len(prior.ids) + 1)
        np.copyto(a, shares[step])
        np.add(coded[step], base, out=at)
        spans.take(at, out=e, mode="clip")
        np.right_shift(e, N[63], out=missed)
        np.bitwise_and(e, SPAN, out=f)
        np.multiply(a, missed, out=rest)  # where the case begins
        np.left_shift(rest, N[1], out=size)
        np.subtract(a, size, out=size)
        np.left_shift(missed, N[FLAG_BITS], out=q)
        np.add(size, q, out=size)
        np.right_shift(e, N[42], out=q)
        np.bitwise_and(q, N[31], out=q)
        np.right_shift(e, N[21], out=e)
        np.bitwise_and(e, SPAN, out=e)
        np.multiply(size, f, out=need)
        np.subtract(N[52], q, out=a)
        np.left_shift(need, a, out=need)
        np.greater_equal(state, need, out=over)
        np.copyto(need, over)
        words[place] = state & WORD
        np.subtract(place, (need * U(n)).view(I), out=place)
        np.left_shift(need, N[5], out=need)
        np.right_shift(state, need, out=state)
        for width, count, start in ((q, f, e), (N[FLAG_BITS], size, rest)):  # the id in its table, then the case
            np.floor_divide(state, count, out=a)
            np.multiply(a, count, out=need)
            np.subtract(state, need, out=state)
            np.left_shift(a, width, out=a)
            np.add(state, a, out=state)
            np.add(state, start, out=state)
    for half in (state & WORD, state >> N[32]):
        words[place] = half
        place -= n
    return words.reshape(-1, n), place // n + 1


def encode(ids: np.ndarray, block: int = 2048, lanes_at_once: int = 6144, most_tables: int = 8) -> tuple[Prior, list[tuple[int, int, bytes]]]:
    """The prior, and (number of ids, crc32 of the ids as little-endian 32-bit integers, coded bytes) of each block. A block shorter than its group's others is filled with its last id.

    A state is 2**32 at least and gives its low 32 bits away before it would grow beyond 64. A block's bytes are the numbers of its
    segments' tables, then its words.
    """
    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) >= 1 << 23 or block >= 1 << 16:
        raise ValueError("ids or blocks need fewer bits")
    held = np.zeros(int(ids.max(initial=0)) + 1, dtype=bool)
    held[ids] = True
    found = np.flatnonzero(held)
    places = np.cumsum(held, dtype=np.uint32)
    if not len(ids):
        return Prior(found[:0].astype(np.uint32), np.zeros((1, 0), dtype=np.uint8)), []
    groups, coded, shares = list(_groups(_sizes(len(ids), block), lanes_at_once)), [], []
    for first, own in groups:
        rows = places.take(ids[first * block : first * block + int(own.sum())])
        rows = np.concatenate([rows, np.full(len(own) * int(own.max()) - len(rows), rows[-1], dtype=np.uint32)])
        some, share = _unpredicted(_turned(rows.reshape(len(own), -1)))
        coded.append(some)
        shares.append(share)
    kinds, tables = _kinds(coded, len(found), most_tables)
    prior = Prior(found.astype(np.uint32), _rounded(_counts(coded, kinds, tables, len(found))))
    spans, out = prior.for_coder(), []
    while groups:
        (first, own), kind = groups.pop(0), kinds.pop(0)
        words, start = _coded(coded.pop(0), shares.pop(0), kind, prior, spans)
        least = int(start.min())
        words, start = np.ascontiguousarray(words[least:].T).astype("<u4", copy=False), start - least
        named = (kind.T[:, :, None] >> np.arange(prior.class_bits) & 1).astype(np.uint8)
        for i, size in enumerate(own.tolist()):
            at = (first + i) * block
            raw = ids[at : at + size].astype("<u4", copy=False).tobytes()
            out.append((size, zlib.crc32(raw), np.packbits(named[i, : -(-size // SEGMENT)]).tobytes() + words[i, start[i] :].tobytes()))
    return prior, out


def decode(prior: Prior, blocks: list[tuple[int, int, bytes]], lanes_at_once: int = 6144) -> np.ndarray:
    """The ids of encode()'s blocks, all or some; a block whose checksum differs raises ValueError."""
    out, spans = [], prior.for_decoder() if blocks else None
    by_place = np.concatenate([prior.ids[:1], prior.ids])
    for first, own in _groups(np.array([b[0] for b in blocks], dtype=np.int64), lanes_at_once):
        some, n, steps = blocks[first : first + len(own)], len(own), int(own.max())
        kind = np.zeros((-(-steps // SEGMENT), n), dtype=I)
        heads = [(-(-b[0] // SEGMENT) * prior.class_bits + 7) // 8 for b in some]
        for i, (b, head) in enumerate(zip(some, heads, strict=True)):
            if head:
                bits = np.unpackbits(np.frombuffer(b[2], np.uint8, count=min(head, len(b[2]))))
                bits = bits[: len(bits) // prior.class_bits * prior.class_bits].reshape(-1, prior.class_bits)[: -(-b[0] // SEGMENT)]
                kind[: len(bits), i] = bits @ (1 << np.arange(prior.class_bits))
        np.minimum(kind, len(prior.codes) - 1, out=kind)
        length = max(len(b[2]) - head for b, head in zip(some, heads, strict=True)) // 4 + 3
        words = np.frombuffer(b"".join(b[2][head:].ljust(4 * length, b"\0")[: 4 * length] for b, head in zip(some, heads, strict=True)), "<u4")
        words = words.reshape(n, length).T.astype(U, order="C").ravel()
        state = words[:n] << N[32] | words[n : 2 * n]
        at, got, model = np.arange(n) + 2 * n, np.zeros((steps, n), dtype=np.uint32), _Model(n, steps)
        t, y, e, q, missed, mask, more = (np.empty(n, dtype=U) for _ in range(7))
        wrong, low, last = np.empty(n, dtype=bool), U((1 << prior.bits) - 1), np.arange(n) + (length - 1) * n
        for step in range(steps):
            if step % SEGMENT == 0:
                base = (kind[step // SEGMENT] << prior.bits).astype(U)
            if refreshed(step):
                model.refresh(step)
                np.minimum(at, last, out=at)  # for broken blocks
            a = model.predict()
            np.right_shift(state, N[FLAG_BITS], out=t)
            np.bitwise_and(state, CHANCES, out=q)
            np.greater_equal(q, a, out=wrong)
            np.copyto(missed, wrong)
            np.negative(missed, out=mask)
            np.multiply(t, a, out=t)
            np.subtract(state, t, out=y)
            np.subtract(y, a, out=y)
            np.add(t, q, out=state)  # where the prediction holds
            np.bitwise_and(y, low, out=e)
            np.add(e, base, out=e)
            spans.take(e.view(I), out=q, mode="clip")
            np.right_shift(y, N[prior.bits], out=y)
            np.right_shift(q, N[40], out=e)
            np.multiply(y, e, out=y)
            np.bitwise_and(q, PART, out=e)
            np.add(y, e, out=y)
            np.right_shift(q, N[20], out=q)
            np.bitwise_and(q, PART, out=q)
            for chosen, other in ((y, state), (q, model.guess)):
                np.bitwise_xor(chosen, other, out=chosen)
                np.bitwise_and(chosen, mask, out=chosen)
                np.bitwise_xor(chosen, other, out=chosen)
            np.less(y, LEAST, out=wrong)
            np.copyto(t, wrong)
            words.take(at, out=more, mode="clip")
            np.multiply(more, t, out=more)
            np.add(at, (t * U(n)).view(I), out=at)
            np.left_shift(t, N[5], out=t)
            np.left_shift(y, t, out=y)
            np.bitwise_or(y, more, out=state)
            got[step] = q
            model.update(step, q, missed)
        rows = np.empty((n, steps), dtype="<u4")
        for i in range(0, n, 64):
            rows[i : i + 64] = by_place.take(got[:, i : i + 64], mode="clip").T
        for i, (size, crc, _) in enumerate(some):
            if zlib.crc32(rows[i, :size].tobytes()) != crc:
                raise ValueError(f"checksum of block {first + i}")
            out.append(rows[i, :size])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def pack(doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int = 2048) -> bytes:
    """A file: magic, number of documents and blocks, sizes of two tables and their checksum, tables of documents (id, null, number of ids), of the prior and of blocks, the blocks' bytes."""
    prior, blocks = encode(ids, block)
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + null.astype("u1").tobytes() + lengths.astype("<u4").tobytes(), 1)
    heads, raw_prior = b"".join(struct.pack("<3I", n, crc, len(raw)) for n, crc, raw in blocks), prior.dumped()
    tables = docs + raw_prior + heads
    return MAGIC + struct.pack("<5I", len(doc_ids), len(blocks), len(docs), len(raw_prior), zlib.crc32(tables)) + tables + b"".join(b[2] for b in blocks)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, null, lengths, ids) of pack(); ValueError where a checksum or the magic differs."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("no id file")
    at = len(MAGIC) + 20
    n, k, size, prior_size, crc = struct.unpack("<5I", raw[len(MAGIC) : at])
    heads = at + size + prior_size
    if zlib.crc32(raw[at : heads + 12 * k]) != crc:
        raise ValueError("checksum of the tables")
    docs = zlib.decompress(raw[at : at + size])
    blocks, pos = [], heads + 12 * k
    for i in range(k):
        count, check, length = struct.unpack("<3I", raw[heads + 12 * i : heads + 12 * i + 12])
        blocks.append((count, check, raw[pos : pos + length]))
        pos += length
    return np.frombuffer(docs[: 8 * n], "<i8"), np.frombuffer(docs[8 * n : 9 * n], "u1"), np.frombuffer(docs[9 * n :], "<u4"), decode(Prior.loaded(raw[at + size : heads]), blocks)
