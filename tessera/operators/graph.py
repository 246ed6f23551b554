"""Graphs as edge tables: symmetrization, degrees, triangles, components and distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpointed(df: DataFrame) -> DataFrame:
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"file:///tmp/tessera-{spark.sparkContext.applicationId}")  # one machine: its own folder is shared
    return df.checkpoint(eager=True)


def directed(arcs: DataFrame) -> DataFrame:
    return arcs.select("src", "dst").where("src <> dst").distinct()


def union(arcs: DataFrame) -> DataFrame:
    return directed(arcs).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def mutual(arcs: DataFrame) -> DataFrame:
    """Edges both of whose directions are present: one count over both ends instead of a self-join."""
    e = directed(arcs).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return e.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def fingerprint(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: edges, src_sum, dst_sum and the digest of the number of vertices and the set of edges(src, dst), in any order.

    The digest is over two sums, each of 60 bits of the md5 of every edge, so no edge leaves its task.
    """
    h = F.md5(F.concat_ws("|", F.col("src").cast("string"), F.col("dst").cast("string")))
    part = [F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 17)]
    sums = edges.agg(F.count("*").alias("edges"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"), *(F.coalesce(F.sum(x), F.lit(0)).alias(f"h{i}") for i, x in enumerate(part)))
    both = sums.crossJoin(vertices.agg(F.count("*").alias("n")))
    return both.select("edges", "src_sum", "dst_sum", F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "edges", "h0", "h1")))).alias("digest"))


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, degree) of all vertices, zeros too."""
    d = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def in_degrees(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    d = directed(arcs).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def triangles(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, triangles). Edges point from the end of lower degree, so a hub has few outgoing ones to pair."""
    d = degrees(edges, vertices)
    e = edges.join(d.withColumnsRenamed({"id": "src", "degree": "d1"}), "src").join(d.withColumnsRenamed({"id": "dst", "degree": "d2"}), "dst")
    up = F.struct("d1", "src") < F.struct("d2", "dst")
    o = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    two = o.alias("p").join(o.alias("q"), F.col("p.a") == F.col("q.a")).where("p.b < q.b").select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("q.b").alias("c"))
    tri = two.join(edges.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    return tri.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, degree, triangles, local): local is null below degree 2."""
    return degrees(edges, vertices).join(triangles(edges, vertices), "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)).cast("long")).withColumn("local", F.when(F.col("degree") >= 2, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the least id of each vertex's component, by label propagation with jumps; state stays in tables."""
    both = checkpointed(both_ways(edges).distinct())
    labels = checkpointed(vertices.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("least"))
        step = labels.join(near, labels["id"] == near["src"], "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("least", "component")).alias("component"))
        step = checkpointed(step)
        if step.where("component < old").isEmpty():
            return step.select("id", "component")
        up = step.select(F.col("id").alias("u"), F.col("component").alias("top"))
        labels = checkpointed(step.join(up, step["component"] == up["u"]).select("id", F.least("component", "top").alias("component")))


def strong_components(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component) by repeated forward colouring and backward collection; component is the least id of the strong component."""
    arcs, left, done = checkpointed(directed(arcs)), checkpointed(vertices.select("id")), None
    while not left.isEmpty():
        color = checkpointed(left.select("id", F.col("id").alias("color")))
        while True:  # the least id that reaches each vertex
            got = arcs.join(color, arcs["src"] == color["id"]).groupBy("dst").agg(F.min("color").alias("c"))
            step = checkpointed(color.join(got, color["id"] == got["dst"], "left").select("id", F.least("color", F.coalesce("c", "color")).alias("color"), F.col("color").alias("old")))
            color = step.select("id", "color")
            if step.where("color < old").isEmpty():
                break
        inside = checkpointed(color.where("id = color"))
        while True:  # those that reach their colour's root within the colour
            c1, c2 = color.select(F.col("id").alias("src"), F.col("color").alias("k1")), inside.select(F.col("id").alias("dst"), F.col("color").alias("k2"))
            more = arcs.join(c2, "dst").join(c1, "src").where("k1 = k2").select(F.col("src").alias("id"), F.col("k1").alias("color")).distinct().join(inside, ["id", "color"], "left_anti")
            more = checkpointed(more)
            if more.isEmpty():
                break
            inside = checkpointed(inside.unionByName(more))
        found = inside.select("id", F.col("color").alias("component"))
        done = found if done is None else done.unionByName(found)
        left = checkpointed(left.join(inside, "id", "left_anti"))
        arcs = checkpointed(arcs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return done if done is not None else vertices.select("id", F.col("id").alias("component"))


WORD = 62  # sources a bit set holds
HELD = 1 << 27  # arcs that a task may hold: some 2 GB while they are put in order


class _Graph:
    """Arcs in a task, for breadth-first walks from many sources at once: a vertex has a bit a source, in words of 64.

    Vertices are numbered by falling in-degree, so the j-th arcs into all vertices that have as many lead to a range of rows.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.ids = np.unique(np.concatenate([src, dst]))
        s, t = np.searchsorted(self.ids, src).astype(np.int32), np.searchsorted(self.ids, dst).astype(np.int32)
        degree = np.bincount(t, minlength=len(self.ids))
        order = np.argsort(-degree, kind="stable").astype(np.int32)
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)
        s, t = self.place[s], self.place[t]
        by = np.argsort(t, kind="stable")
        s, degree = s[by], degree[order]
        start = np.cumsum(degree) - degree
        self.nth = [s[start[: np.count_nonzero(degree > j)] + j] for j in range(min(256, int(degree.max(initial=0))))]
        hubs = np.count_nonzero(degree > 256)
        self.hubs = [s[start[v] + 256 : start[v] + degree[v]] for v in range(hubs)]

    def counts(self, sources: np.ndarray) -> dict[int, int]:
        """How many pairs (source, vertex) lie at each distance above 0."""
        n, out = len(self.ids), {}
        at = np.minimum(np.searchsorted(self.ids, sources), max(0, n - 1))
        rows = self.place[at[self.ids[at] == sources]] if n else np.zeros(0, np.int32)
        words = int(max(1, min(16, (1 << 27) // (32 * max(1, n)), -(-len(rows) // 64))))
        seen, front, new, some = (np.zeros((n, words), np.uint64) for _ in range(4))
        for a in range(0, len(rows), 64 * words):
            r = rows[a : a + 64 * words]
            k = np.arange(len(r))
            front[:] = 0
            front[r, k >> 6] = np.uint64(1) << (k & 63).astype(np.uint64)
            seen[:] = front
            d = 0
            while True:
                new[:] = 0
                for s in self.nth:
                    np.take(front, s, axis=0, out=some[: len(s)], mode="clip")
                    new[: len(s)] |= some[: len(s)]
                for v, s in enumerate(self.hubs):
                    for c in range(0, len(s), 1 << 16):
                        new[v] |= np.bitwise_or.reduce(front[s[c : c + (1 << 16)]], axis=0)
                np.bitwise_not(seen, out=some)
                new &= some
                pairs = int(np.bitwise_count(new).sum(dtype=np.int64))
                if not pairs:
                    break
                d += 1
                out[d] = out.get(d, 0) + pairs
                seen |= new
                front, new = new, front
        return out


def distances(arcs: DataFrame, sources: DataFrame, source: str = "id") -> DataFrame:
    """(d, pairs): how many ordered pairs (source, vertex) lie at each shortest distance d > 0; arcs(src, dst) as given.

    Sources are dealt into 36 blocks at most. Each is one task, which gets all arcs in pieces, walks from a few hundred of its sources at a time and
    returns counts, so nothing is written by source and vertex. A task holds the arcs and 128 MB of bits, or 32 bytes a vertex if that is more;
    beyond HELD arcs walks are joins, whose tables grow with sources times vertices.
    """
    arcs = checkpointed(arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct())
    if arcs.count() > HELD:
        return joined_distances(arcs, sources, source)
    ids = sources.select(F.col(source).cast("long").alias("id")).where(F.col(source).isNotNull()).distinct()
    parts = max(1, min(36, -(-ids.count() // 512)))
    packed = "kind int, to array<int>, a binary, b binary"

    def pack(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([list(range(parts))], pa.list_(pa.int32())), *(pa.array([x.tobytes()], pa.binary()) for x in (a, b))], names=["kind", "to", "a", "b"])

    def deal(batches):
        for batch in batches:
            a = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (h ^ (h >> np.uint64(32))) % np.uint64(parts)
            to = np.unique(x)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(to), pa.int32()), pa.array([[int(t)] for t in to], pa.list_(pa.int32())), pa.array([a[x == t].tobytes() for t in to], pa.binary()), pa.array([b""] * len(to), pa.binary())], names=["kind", "to", "a", "b"])

    def walk(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for x, kind, a, b in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                got.setdefault(x, ([], [], []))[0 if kind == 0 else 1].append(np.frombuffer(a, np.int64))
                if kind:
                    got[x][2].append(np.frombuffer(b, np.int64))
        for own, src, dst in got.values():
            if own and src:
                src, dst = np.concatenate(src), np.concatenate(dst)
                graph = _Graph(src, dst)
                del src, dst
                found = sorted(graph.counts(np.concatenate(own)).items())
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["d", "pairs"])

    pieces = arcs.mapInArrow(pack, packed).unionAll(ids.mapInArrow(deal, packed)).select(F.explode("to").alias("x"), "kind", "a", "b")
    return pieces.repartitionById(parts, F.col("x")).mapInArrow(walk, "d long, pairs long").groupBy("d").agg(F.sum("pairs").alias("pairs"))


def joined_distances(arcs: DataFrame, sources: DataFrame, source: str = "id") -> DataFrame:
    """distances() without a graph in any task.

    Breadth-first from all sources at once. Sources are numbered in words of 62, and a row (word, vertex) holds the bits of the sources that
    have reached the vertex, so a step is one join of the frontier with the arcs and one bitwise-or a vertex; no task holds the graph.
    """
    arcs = checkpointed(arcs.select("src", "dst").where("src <> dst").distinct())
    ids = sources.select(F.col(source).alias("id")).distinct()
    bucket = F.pmod(F.xxhash64("id"), F.lit(max(1, ids.count() // WORD)))  # about one word each
    slot = F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1
    front = ids.withColumn("b", bucket).withColumn("n", slot).select("b", F.floor(F.col("n") / WORD).alias("w"), "id", F.expr(f"shiftleft(1L, cast(n % {WORD} as int))").alias("bits"))
    seen, d, out = checkpointed(front), 0, None
    front = seen
    while True:
        step = front.join(arcs, front["id"] == arcs["src"]).groupBy("b", "w", F.col("dst").alias("id")).agg(F.bit_or("bits").alias("new"))
        both = checkpointed(step.join(seen.withColumnRenamed("bits", "old"), ["b", "w", "id"], "full").select("b", "w", "id", F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0)))).alias("new")))
        d += 1
        n = both.agg(F.sum(F.bit_count("new"))).first()[0] or 0
        if not n:
            break
        row = arcs.sparkSession.createDataFrame([(d, int(n))], "d long, pairs long")
        out = row if out is None else out.unionAll(row)
        front = both.where("new <> 0").select("b", "w", "id", F.col("new").alias("bits"))
        seen = both.select("b", "w", "id", F.col("old").bitwiseOR(F.col("new")).alias("bits"))
    return out if out is not None else arcs.sparkSession.createDataFrame([], "d long, pairs long")


def crawl(tree: DataFrame, roots: list[int], depth: int) -> DataFrame:
    """(root, node, depth, parent) of the nodes of tree(p, c) within a depth of each root, at their first depth, with the least node one step above that leads there."""
    spark = tree.sparkSession
    front = checkpointed(spark.createDataFrame([(r, r, 0, None) for r in roots], "root long, node long, depth int, parent long"))
    seen = front
    for d in range(1, depth + 1):
        step = front.join(tree, front["node"] == tree["p"]).groupBy("root", F.col("c").alias("node")).agg(F.min("p").alias("parent"))
        front = checkpointed(step.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("depth"), "parent"))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen.where("depth > 0")


def roots(up: DataFrame) -> DataFrame:
    """(id, root, steps) of up(c, p), a forest in which each child has one parent: pointers are doubled, so depth 2**k takes k rounds."""
    at = checkpointed(up.select(F.col("c").alias("id"), F.col("p").alias("root"), F.lit(1).alias("steps")))
    while True:
        more = at.select(F.col("id").alias("root"), F.col("root").alias("top"), F.col("steps").alias("further"))
        step = checkpointed(at.join(more, "root", "left").select("id", F.coalesce("top", "root").alias("root"), (F.col("steps") + F.coalesce("further", F.lit(0))).alias("steps"), F.col("top").isNotNull().alias("moved")))
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at


def directed_clustering(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, local) of a directed graph: closed walks over S = A + A^T, halved, over s(s-1) - 2r; null where that isn't positive.

    A triangle of weights x, y, z adds 2xyz to each of its vertices, so triangles are found once, from the end of lower degree, as in triangles().
    """
    a = directed(arcs)
    s = both_ways(a).groupBy("src", "dst").agg(F.count("*").alias("w"))
    per = s.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("s"), F.sum((F.col("w") == 2).cast("int")).alias("r"))
    half = s.where("src < dst")
    d = degrees(half.select("src", "dst"), vertices)
    e = half.join(d.withColumnsRenamed({"id": "src", "degree": "d1"}), "src").join(d.withColumnsRenamed({"id": "dst", "degree": "d2"}), "dst")
    up = F.struct("d1", "src") < F.struct("d2", "dst")
    o = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), "w")
    two = o.alias("p").join(o.alias("q"), F.col("p.a") == F.col("q.a")).where("p.b < q.b").select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("q.b").alias("c"), (F.col("p.w") * F.col("q.w")).alias("x"))
    tri = two.join(half.select(F.col("src").alias("b"), F.col("dst").alias("c"), "w"), ["b", "c"]).select("a", "b", "c", (F.col("x") * F.col("w") * 2).alias("closed"))
    closed = tri.select(F.explode(F.array("a", "b", "c")).alias("id"), "closed").groupBy("id").agg(F.sum("closed").alias("closed"))
    room = F.col("s") * (F.col("s") - 1) - 2 * F.col("r")
    return vertices.select("id").join(per, "id", "left").join(closed, "id", "left").select("id", F.when(room > 0, F.coalesce("closed", F.lit(0)) / 2.0 / room).alias("local"))


def assortativity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Nominal assortativity of undirected edges and labels(id, label), from the mixing matrix."""
    e = both_ways(edges).join(labels.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(labels.withColumnsRenamed({"id": "dst", "label": "b"}), "dst").groupBy("a", "b").agg(F.count("*").alias("n"))
    total = e.agg(F.sum("n").alias("m"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    squares = e.groupBy("a").agg(F.sum("n").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("sq"))
    m = F.col("m").cast("double")
    return total.crossJoin(squares).select(((F.col("same") / m - F.col("sq") / m / m) / F.nullif(1 - F.col("sq") / m / m, F.lit(0.0))).alias("assortativity"), (F.col("same") / m).alias("same_share"))


def farthest(arcs: DataFrame, start: int) -> tuple[int, int]:
    """(distance, least vertex at that distance) of the vertex farthest from a start."""
    seen = checkpointed(arcs.sparkSession.createDataFrame([(start,)], "id long"))
    front, d, last = seen, 0, start
    while True:
        step = front.join(arcs, front["id"] == arcs["src"]).select(F.col("dst").alias("id")).distinct()
        front = checkpointed(step.join(seen, "id", "left_anti"))
        least = front.agg(F.min("id")).first()[0]
        if least is None:
            return d, last
        d, last = d + 1, least
        seen = checkpointed(seen.unionAll(front))


def double_sweep(arcs: DataFrame, start: int, rounds: int = 10) -> DataFrame:
    """(bound): the largest distance met by going from a start to a farthest vertex and on from there, until it no longer grows."""
    best, at = 0, start
    for _ in range(rounds):
        d, at = farthest(arcs, at)
        if d <= best:
            break
        best = d
    return arcs.sparkSession.createDataFrame([(best,)], "bound long")
