"""Benchmark decontamination by template canonicalisation: typed placeholders, hash-joined template windows and a check of the slots."""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_name, span_hashes

# Units that count as one placeholder after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars euro euros pound pounds cent cents usd eur gbp percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms "
    "mph kmh kph w kw hz khz mhz ghz v mb gb tb kb"
).split()

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|[.!?…:\n]")
NUMBER, NAME, UNIT, EXACT = np.uint64(11), np.uint64(13), np.uint64(17), np.uint64(0x5851F42D4C957F2D)
WORD_KIND, END_KIND, NUMBER_KIND, NAME_KIND, UNIT_KIND = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class DecontaminationParams:
    """window: canonical words in a window; items of fewer words are one window of their own. A window of `literal` or more words that are no
    placeholder matches as a template, one of fewer only word for word.

    filter_bits is the log of the fixed size of the membership filter that documents' windows meet before the join.
    """

    window: int = 10
    literal: int = 5
    filter_bits: int = 22


class _Tokens(dict):
    """Of each token its number; by number the hash of its lower-case form and its kind, NAME_KIND if it begins with a capital and is no unit."""

    units = frozenset(UNITS)

    def __init__(self):
        super().__init__()
        self.hashes, self.kinds = bytearray(), bytearray()

    def __missing__(self, token):
        low = token.lower()
        first = token[0]
        self.hashes += blake2b(low.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        self.kinds.append(END_KIND if first in ".!?…:\n" else NUMBER_KIND if first.isdigit() else UNIT_KIND if low in self.units else NAME_KIND if first.isupper() and (len(token) == 1 or not token.isupper()) else WORD_KIND)
        n = self[token] = len(self)
        return n

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, kinds) of the tokens of a text."""
        if len(self) > 400_000:
            self.clear()
            self.hashes, self.kinds = bytearray(), bytearray()
        found = _TOKEN.findall(text)
        at = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return np.frombuffer(self.hashes, dtype="<u8")[at], np.frombuffer(self.kinds, dtype=np.int8)[at]


def canonical(text: str | None, known: _Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(canonical hashes, own hashes, whether it is a placeholder, whether it may be a name as well) of the words of a text.

    A number becomes the number placeholder; a unit right after a number the unit placeholder; a capitalised word that doesn't begin a
    sentence or line the name placeholder; all else its lower-case form. One that does begin a sentence or line may be either.
    """
    own, kind = known.of(text or "")
    before = np.concatenate([[END_KIND], kind]).astype(np.int8)[:-1]
    words = np.flatnonzero(kind != END_KIND)
    own, kind, before = own[words], kind[words], before[words]
    capital, begins = kind == NAME_KIND, before == END_KIND
    number, unit, name = kind == NUMBER_KIND, (kind == UNIT_KIND) & (before == NUMBER_KIND), capital & ~begins
    form = own.copy()
    form[number], form[unit], form[name] = NUMBER, UNIT, NAME
    return form, own, number | unit | name, capital & begins


def windows(form: np.ndarray, slot: np.ndarray, k: int, p: DecontaminationParams) -> tuple[np.ndarray, np.ndarray]:
    """(places of the windows of k words with enough literal words, places of the others)."""
    literal = np.concatenate([[0], np.cumsum(~slot)])
    enough = literal[k:] - literal[:-k] >= p.literal
    return np.flatnonzero(enough), np.flatnonzero(~enough)


def _spots(p: DecontaminationParams, shared=None, sizes=None):
    """Rows of all windows of each text, or of those in the filter; with the own hashes of each window's placeholders in turn.

    A template window's key is the hash of its canonical words; one with words that may be names gives a second row in which they are.
    A verbatim window's key is the hash of its own words, and it has no slots. `window` is the same for both rows of a window. An item's
    window is one or the other. A document's is both where items have verbatim windows of that length, as its words can be placeholders
    where the item's aren't.
    """

    def run(batches):
        known, keep, lengths = _Tokens(), None if shared is None else shared.value, None if sizes is None else sizes.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids, keys, places, slots, same = [], [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    form, own, slot, either = canonical(text, known)
                    named, open_too, some = np.where(either, NAME, form), slot | either, np.concatenate([[0], np.cumsum(either)])
                    for k, template, verbatim in [(min(p.window, len(form)), True, True)] if lengths is None else lengths:
                        if not 0 < k <= len(form):
                            continue
                        enough, few = windows(form, slot, k, p)
                        kinds = []
                        if template:
                            both = windows(named, open_too, k, p)[0]
                            both = both[some[both + k] > some[both]]
                            kinds = [(span_hashes(form, enough, enough + k), enough, slot), (span_hashes(named, both, both + k), both, open_too)]
                        if verbatim:
                            at = few if lengths is None else np.arange(len(form) - k + 1)
                            kinds.append((span_hashes(own, at, at + k) ^ EXACT, at, None))
                        for h, at, open_ in kinds:
                            if keep is not None:
                                hit = keep[(h >> np.uint64(64 - p.filter_bits)).astype(np.int64)]
                                h, at = h[hit], at[hit]
                            first = h if open_ is None else span_hashes(form, at, at + k)
                            for x, y, i in zip(h.view(np.int64).tolist(), first.view(np.int64).tolist(), at.tolist(), strict=True):
                                ids.append(doc)
                                keys.append(x)
                                same.append(y)
                                places.append(i)
                                slots.append([] if open_ is None else own[i : i + k][open_[i : i + k]].view(np.int64).tolist())
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "place": pa.array(places, pa.int64()), "slots": pa.array(slots, pa.list_(pa.int64())), "window": pa.array(same, pa.int64())})

    return run


SPOT = "id long, key long, place long, slots array<long>, window long"


def _consistent():
    """Whether the placeholders of the two sides stand for each other one to one: equal where the other side's are equal, different where they differ."""
    pairs = F.arrays_zip(F.col("slots").alias("s"), F.col("item_slots").alias("t"))
    return (F.size(F.array_distinct(pairs)) == F.size(F.array_distinct("slots"))) & (F.size(F.array_distinct(pairs)) == F.size(F.array_distinct("item_slots")))


def contaminated(documents: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, item_id, n_windows (matching windows of the item), first_place (word number in the document), exact (all matching windows have equal values in all slots).

    documents(doc_id, text, ...) and benchmark(item_id, text, ...); other columns aren't read. Null and empty texts have no windows;
    rows with a null id give none. Repeated rows count once. Documents are read whole; a fixed-size membership filter of the
    benchmark's windows drops the others before the shuffle, and the join is on the full 64-bit hash, followed by the slot check.
    """
    p, spark = params, documents.sparkSession
    items = benchmark.selectExpr("cast(item_id as long) as id", "cast(text as string) as text").where("id is not null and text is not null")
    spots = cut(items.mapInArrow(_spots(p), SPOT))
    size = 1 << p.filter_bits
    places = spots.select(F.shiftrightunsigned("key", 64 - p.filter_bits).alias("bit")).distinct()
    member = np.zeros(size, dtype=bool)
    for batch in places.toLocalIterator():  # at most as many as the filter has bits
        member[batch[0]] = True
    lengths = sorted(tuple(r) for r in cut(items.mapInArrow(_lengths(p), "words int, template boolean, verbatim boolean").groupBy("words").agg(F.max("template"), F.max("verbatim"))).collect())  # at most `window` rows
    shared, sizes = spark.sparkContext.broadcast(member), spark.sparkContext.broadcast(lengths)
    docs = documents.selectExpr("cast(doc_id as long) as id", "cast(text as string) as text").where("id is not null and text is not null")
    hits = docs.mapInArrow(_spots(p, shared, sizes), SPOT).drop("window")
    other = spots.groupBy(F.col("id").alias("item_id"), "key", F.col("slots").alias("item_slots")).agg(F.min("window").alias("window"))
    same = hits.join(other, "key").where((F.size("slots") == F.size("item_slots")) & _consistent())
    return same.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.count_distinct("window").alias("n_windows"), F.min("place").alias("first_place"), F.min((F.col("slots") == F.col("item_slots")).cast("int")).cast("boolean").alias("exact"))


def _lengths(p: DecontaminationParams):
    """Words of each item's windows, and whether it has template and verbatim ones."""

    def run(batches):
        known = _Tokens()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                form, _, slot, _ = canonical(text, known)
                if k := min(p.window, len(form)):
                    rows.append((k, *(len(x) > 0 for x in windows(form, slot, k, p))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.bool_()))], ["words", "template", "verbatim"])

    return run


def decontaminated(documents: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The rows of documents, all columns, that match no item; rows with a null id or text stay."""
    name = fresh_name("__bad", documents)
    bad = contaminated(documents, benchmark, params).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(bad, documents["doc_id"] == bad[name], "left_anti")
