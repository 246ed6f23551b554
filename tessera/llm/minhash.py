"""MinHash near-duplicate detection with circulant signatures, banding and exact confirmation.

Two permutations make all coordinates: the first scatters a shingle over a ring, the second gives each place of the ring a value,
and coordinate k is the least value over the set after the second permutation is shifted by k places. The values that one shingle
gives to all coordinates are therefore one contiguous slice of the second permutation.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, shingle_set, written
from .components import components


@dataclass(frozen=True)
class MinHashParams:
    """words: shingle length; a pair is linked if 100 * intersection >= percent * union.

    A pair at exactly 0.8 shares none of 40 bands of 6 rows with probability (1 - 0.8**6)**40 = 5e-6; above 0.85 with less than 1e-8.
    Buckets of up to `small` sets are compared pair by pair; of larger ones each set with the least id, then what lies outside the
    bucket's largest component with the whole group, in blocks of about `block` shingles.
    """

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    ring: int = 1 << 20
    small: int = 6
    block: int = 200_000
    seed: int = 7


@functools.lru_cache(maxsize=4)
def _second(ring: int, coordinates: int, seed: int) -> np.ndarray:
    values = np.random.default_rng(seed).permutation(ring).astype(np.uint32)
    return np.concatenate([values, values[:coordinates]])


def signature(shingles: np.ndarray, p: MinHashParams) -> np.ndarray:
    """The bands * rows coordinates of a set that isn't empty. The first permutation is a bijective mix of the 64-bit shingle, reduced to the ring."""
    n = p.bands * p.rows
    values = _second(p.ring, n, p.seed)
    at = (mix(shingles + np.uint64(p.seed)) % np.uint64(p.ring)).astype(np.int64)
    view = np.lib.stride_tricks.sliding_window_view(values, n)
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(out, view[at[i : i + 2048]].min(axis=0), out=out)
    return out


def band_keys(sigs: np.ndarray, p: MinHashParams) -> np.ndarray:
    """A 64-bit key for each band of each signature (one a row)."""
    with np.errstate(over="ignore"):
        rows = sigs.reshape(len(sigs), p.bands, p.rows)
        h = np.broadcast_to(np.arange(p.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2])
        for r in range(p.rows):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, r].astype(np.uint64))
    return h.view(np.int64)


def _lists(values: np.ndarray, lengths) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))


def _sketch(p: MinHashParams):
    """Size, two 64-bit fingerprints (sums over the set) and band keys of each text's set."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                n, fp, sigs = np.zeros(part.num_rows, dtype=np.int64), np.zeros((2, part.num_rows), dtype=np.uint64), []
                for i, t in enumerate(part.column(1).to_pylist()):
                    s = shingle_set(t, p.words)
                    if len(s):
                        n[i], fp[0, i], fp[1, i] = len(s), s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)
                        sigs.append(signature(s, p))
                keys = band_keys(np.array(sigs), p).ravel() if sigs else np.zeros(0, dtype=np.int64)
                cols = [pa.array(x, pa.int64()) for x in (n, *fp.view(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, _lists(keys, np.where(n > 0, p.bands, 0))], ["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return run


def _sets(words: int):
    """fp1, fp2, n_shingles and members of each text's set; empty sets give none."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                sets = [s for t in batch.column(1).slice(start, 1000).to_pylist() if len(s := shingle_set(t, words))]
                sums = [[s.sum(dtype=np.uint64) for s in sets], [mix(s).sum(dtype=np.uint64) for s in sets]]
                cols = [pa.array(np.array(x, dtype=np.uint64).view(np.int64), pa.int64()) for x in sums]
                size = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(size, pa.int64()), _lists(np.concatenate([np.zeros(0, dtype=np.int64), *(s.view(np.int64) for s in sets)]), size)], ["fp1", "fp2", "n_shingles", "members"])

    return run


def _overlap(batches):
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            x, y = (batch.column(k)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in (2, 3))
            out.append(len(np.intersect1d(x, y, assume_unique=True)))
        yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1), "common": pa.array(out, pa.int64()), "total": pa.array([len(x) + len(y) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.int64())})


def _confirmed(pairs: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    done = both.mapInArrow(_overlap, "a long, b long, common long, total long")
    return done.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * p.percent).select("a", "b")


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(all members in turn, start of each row's members and the end of the last) of a list column."""
    chunks = table.column(column).combine_chunks()
    chunks = chunks.chunk(0) if isinstance(chunks, pa.ChunkedArray) else chunks
    at = chunks.offsets.to_numpy().astype(np.int64)
    return chunks.values.to_numpy()[at[0] : at[-1]].view(np.uint64), at - at[0]


def _block(percent: int):
    """Links between a block of sets and another block of one group, found on the full sets: of each set one to each other component that it reaches there, since more join nothing."""

    def run(few: pa.Table, many: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if few.num_rows and many.num_rows:
            x, x_at = _flat(few, "members")
            y, y_at = _flat(many, "its")
            ids, others, mine, theirs = few.column("id").to_numpy(), many.column("other").to_numpy(), few.column("component").to_numpy(), many.column("its_component").to_numpy()
            sizes = np.diff(y_at)
            for i in range(len(ids)):
                own = x[x_at[i] : x_at[i + 1]]
                hit = own[np.minimum(np.searchsorted(own, y), len(own) - 1)] == y
                common = np.add.reduceat(hit, y_at[:-1], dtype=np.int64)
                ok = np.flatnonzero((common * 100 >= (len(own) + sizes - common) * percent) & (theirs != mine[i]))
                ok = ok[np.unique(theirs[ok], return_index=True)[1]]
                a.append(np.minimum(others[ok], ids[i]))
                b.append(np.maximum(others[ok], ids[i]))
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return run


def _rest(rows: DataFrame, found: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """Links that the pivots of large buckets can have missed: each set outside its bucket's largest component against all sets of the bucket's group, in blocks.

    A pair inside one component needs no comparison, so what is left is the sets outside (a stated query set) against the group, dealt
    over blocks of bounded size on both sides; no task holds a whole group.
    """
    state = cut(rows.join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component")))
    shares = state.groupBy("key", "component").agg(F.count("*").alias("share"))
    main = shares.groupBy("key").agg(F.max_by("component", F.struct("share", "component")).alias("group"), F.count("*").alias("parts")).where("parts > 1")
    state = cut(state.join(main.select("key", "group"), "key").groupBy("group", "id").agg(F.max("n").alias("n"), F.min("component").alias("component")).withColumn("outside", F.col("component") != F.col("group")))
    blocks = cut(state.groupBy("group").agg(F.ceil(F.sum("n") / p.block).cast("int").alias("all_blocks"), F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / p.block).cast("int").alias("out_blocks")))
    dealt = state.join(blocks, "group").join(sets, "id")
    hashed = F.xxhash64("id")
    few = dealt.where("outside").select("group", F.pmod(hashed, F.col("out_blocks")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("y"), "id", "component", "members")
    many = dealt.select(F.col("group").alias("of"), F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("u"), F.pmod(hashed, F.col("all_blocks")).cast("int").alias("v"), F.col("id").alias("other"), F.col("component").alias("its_component"), F.col("members").alias("its"))
    return few.groupBy("group", "x", "y").cogroup(many.groupBy("of", "u", "v")).applyInArrow(_block(p.percent), "a long, b long")


def _possible(na, nb, p: MinHashParams):
    """Sizes that allow the similarity."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * p.percent


def near_duplicates(documents: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of documents(doc_id, text, ...).

    Words are runs of bytes other than space, tab, line breaks and form feeds, A-Z lowered; sets hold 64-bit hashes of shingles. Texts
    without words and null texts have the empty set, link with nothing and keep their own id. Repeated rows give a row each. Rows with one
    id are one document: its texts are in one component. Rows with a null id stay alone with a null component and are kept. Columns
    other than doc_id and text aren't read.

    Equal sets, told by two 64-bit sums over all their members and their size, are one class, found by a partial aggregate, so a group of
    copies costs one row a task. Classes meet in band buckets; a large bucket is compared with its least class first, then its classes outside
    its largest component with all its classes, in blocks, so no pair that could still join two components is left out. Links between
    classes are confirmed on full sets. All tables stay distributed; of classes that hold more than a thousandth of all rows, a thousand at
    most, the component goes to their rows by a broadcast, so that no task gets all rows of one class.
    """
    p = params
    docs = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    sketches = written(docs.mapInArrow(_sketch(p), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>").withColumn("cls", F.xxhash64("fp1", "fp2", "n_shingles")), "sketches")
    real = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = written(real.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")), "classes")
    firsts = classes.select(F.col("cls").alias("__cls"), F.col("least").alias("__least"))
    first = (F.col("cls") == F.col("__cls")) & (F.col("doc_id") == F.col("__least"))
    banded = real.join(firsts, first, "left_semi").dropDuplicates(["cls"]).select(F.col("cls").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("pivot"), F.min_by("n", "id").alias("pivot_n")).where("size > 1")
    rows = written(banded.join(buckets, "key"), "buckets")

    few = rows.where(F.col("size") <= p.small)
    other = few.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"))
    pairs = few.join(other, "key").where("id < id2").where(_possible(F.col("n"), F.col("n2"), p)).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    star = rows.where((F.col("size") > p.small) & (F.col("id") != F.col("pivot"))).where(_possible(F.col("n"), F.col("pivot_n"), p)).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    pairs = written(pairs.unionByName(star).distinct(), "pairs")

    wanted = classes.join(rows.select(F.col("id").alias("cls")).distinct(), "cls", "left_semi").select("least").distinct()
    texts = docs.join(wanted, F.col("doc_id") == F.col("least"), "left_semi").dropDuplicates(["doc_id", "text"])
    sets = texts.mapInArrow(_sets(p.words), "fp1 long, fp2 long, n_shingles long, members array<long>").select(F.xxhash64("fp1", "fp2", "n_shingles").alias("id"), "members")
    sets = written(sets, "sets")  # a class occurs twice only where documents have several texts, which repeats links and no more
    links = written(_confirmed(pairs, sets, p), "links")
    found = cut(components(links))

    large = rows.where(F.col("size") > p.small).select("key", "id", "n")
    links = links.unionByName(_rest(large, found, sets, p))
    ids = real.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("doc_id", "a")  # documents with several texts
    links = links.unionByName(real.select("doc_id", F.col("cls").alias("b")).join(ids, "doc_id").where("a < b").select("a", "b").distinct())
    found = components(written(links, "links"))

    part = classes.join(found, classes["cls"] == found["id"], "left").select("cls", "least", "size", F.coalesce("component", "cls").alias("component"))
    part = written(part, "parts")
    top = part.groupBy("component").agg(F.min("least").alias("least_link"))
    part = written(part.drop("least").join(top, "component").select("cls", "size", "least_link"), "tops")
    n = sketches.count()
    hot = part.where(F.col("size") * 1000 > n).select("cls", "least_link")  # a thousand at most
    every = sketches.select("doc_id", "n_shingles", "cls").join(F.broadcast(hot), "cls", "left")
    is_hot = F.col("least_link").isNotNull() | F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    cold = every.where(~is_hot).drop("least_link").join(part.select("cls", "least_link"), "cls", "left")
    done = every.where(is_hot).unionByName(cold).withColumn("least_link", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least_link")))
    return done.select("doc_id", "n_shingles", F.coalesce("least_link", "doc_id").alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("least_link", "doc_id"))).alias("kept"))
