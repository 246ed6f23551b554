"""Registered queries of the dictionary lens: ranks of types for vectors, top lists, their changes over layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import graph as gr
from .operators import knn as kn
from .operators import lens as ln
from .operators import order as od
from .queries import query, read

K = 3
DEPTHS = (16, 32, 48, 64)


def LENS(p: str = "", depth: int = 64, lexical: bool = False) -> str:
    vec = f"embedding[1:{depth}]::DOUBLE[]"
    own = f"SELECT vec_id, e.label own, nxt, t.v FROM (SELECT vec_id, label, lead(label) OVER (ORDER BY vec_id) nxt FROM embeddings) e JOIN {p}t t USING (label)"
    raw = f"SELECT vec_id, label own, lead(label) OVER (ORDER BY vec_id) nxt, {vec} v FROM embeddings"
    return f"""{p}t AS (SELECT label, list(m ORDER BY d) v FROM (SELECT label, d, avg(x) m FROM (SELECT label, unnest({vec}) x, generate_subscripts({vec}, 1) d FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    {p}q AS ({own if lexical else raw}),
    {p}s AS (SELECT vec_id, own, nxt, t.label, list_cosine_similarity(q.v, t.v) sim, list_dot_product(q.v, t.v) dot FROM {p}q q, {p}t t),
    {p}o AS (SELECT vec_id, max(CASE WHEN label = own THEN sim END) so, max(CASE WHEN label = nxt THEN sim END) sn FROM {p}s GROUP BY vec_id),
    {p}ranks AS (SELECT vec_id, any_value(own) own, any_value(nxt) nxt, sum((sim > so + 1e-12 AND label <> own)::INT)::BIGINT own_rank,
        CASE WHEN any_value(sn) IS NULL THEN -1 ELSE sum((sim > sn + 1e-12 AND label <> nxt)::INT) END::BIGINT next_rank, any_value(so) own_cos, any_value(sn) next_cos, arg_max(label, dot) argmax
        FROM {p}s JOIN {p}o USING (vec_id) GROUP BY vec_id),
    {p}top AS (SELECT * FROM (SELECT vec_id, own, label, sim, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, label) - 1 rank FROM {p}s) WHERE rank < {K})"""


def lens(spark, sf, depth=64, lexical=False):
    """Each vector's own type and the type of the next vector among the mean vectors of all types, in the first `depth` dimensions; lexical: the type's mean stands for the vector."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("own"), F.slice(F.col("embedding").cast("array<double>"), 1, depth).alias("vec"))
    t = kn.type_vectors(e.withColumnRenamed("own", "label"), "label")
    q = e.drop("vec").join(t.withColumnRenamed("label", "own"), "own") if lexical else e
    after = od.next_value(e.select("id", "own"), "id", "own", "nxt")  # ids and types only, the vectors stay
    return ln.ranked(q.join(after.select("id", "nxt"), "id"), t, K)


@query(f"WITH {LENS()} SELECT vec_id, own, own_rank, next_rank, round(own_cos, 6) own_sim, argmax FROM ranks")
def lens_ranks(spark, sf):
    return lens(spark, sf).select(F.col("id").alias("vec_id"), "own", "own_rank", "next_rank", F.round("own_cos", 6).alias("own_sim"), "argmax")


@query(f"WITH {LENS()} SELECT vec_id, rank::INT rank, label, round(sim, 6) cos FROM top")
def lens_topk(spark, sf):
    return ln.top_rows(lens(spark, sf)).select(F.col("id").alias("vec_id"), "rank", "label", F.round("cos", 6).alias("cos"))


STATS = f"""count(*) n, round(median(own_rank), 6) own_rank_median, round(avg(own_rank), 6) own_rank_mean, round(avg((own_rank = 0)::INT), 6) own_rank0, round(avg((own_rank < {K})::INT), 6) own_in_topk,
    round(avg(own_cos), 6) own_cos_mean, count(*) FILTER (next_rank >= 0) next_n, round(median(next_rank) FILTER (next_rank >= 0), 6) next_rank_median, round(avg(next_rank) FILTER (next_rank >= 0), 6) next_rank_mean,
    round(avg((next_rank = 0)::INT) FILTER (next_rank >= 0), 6) next_rank0, round(avg((next_rank < {K})::INT) FILTER (next_rank >= 0), 6) next_in_topk,
    round(avg(next_cos) FILTER (next_rank >= 0), 6) next_cos_mean, round(avg((next_rank < own_rank)::INT) FILTER (next_rank >= 0), 6) next_closer_than_own"""


@query(f"WITH {LENS()} SELECT own, {STATS} FROM ranks GROUP BY own")
def lens_stats(spark, sf):
    return ln.rank_stats(lens(spark, sf), ["own"], K)


PAIRS = list(zip(DEPTHS[:-1], DEPTHS[1:], strict=True))
STEPS = " UNION ALL ".join(f"SELECT {b} depth, own, count(*) FILTER (y.label IS NOT NULL) / (2 * {K} - count(*) FILTER (y.label IS NOT NULL))::DOUBLE j, x.vec_id FROM d{a}top x LEFT JOIN (SELECT vec_id, label FROM d{b}top) y USING (vec_id, label) GROUP BY x.vec_id, own" for a, b in PAIRS)


@query(f"WITH {', '.join(LENS(f'd{d}', d) for d in DEPTHS)}, j AS ({STEPS}) SELECT depth, count(*) n, round(avg(j), 6) mean, round(median(j), 6) median, round(avg((j = 0)::INT), 6) zeros FROM j GROUP BY depth")
def lens_topk_jaccard(spark, sf):
    """How much the top lists change from one depth to the next."""
    tops, out = {d: ln.top_rows(gr.checkpointed(lens(spark, sf, d))) for d in DEPTHS}, None
    for a, b in PAIRS:
        one = ln.list_jaccard(tops[a], tops[b]).withColumn("depth", F.lit(b))
        out = one if out is None else out.unionAll(one)
    r = lambda x: F.round(x, 6)
    return out.groupBy("depth").agg(F.count("*").alias("n"), r(F.avg("j")).alias("mean"), r(F.median("j")).alias("median"), r(F.avg((F.col("j") == 0).cast("int"))).alias("zeros"))


CURVE = f"WITH {', '.join(LENS(f'd{d}', d) for d in DEPTHS)}, c AS (" + " UNION ALL ".join(f"SELECT {d} depth, {STATS} FROM d{d}ranks" for d in DEPTHS) + ")"


def curve(spark, sf):
    out = None
    for d in DEPTHS:
        one = ln.rank_stats(lens(spark, sf, d).withColumn("depth", F.lit(d)), ["depth"], K)
        out = one if out is None else out.unionAll(one)
    return out


@query(f"{CURVE} SELECT * FROM c")
def lens_curve(spark, sf):
    return curve(spark, sf)


@query(f"{CURVE} SELECT min(depth) FILTER (own_rank0 > 0.5) own_layer, min(depth) FILTER (next_closer_than_own > 0.5) layer FROM c")
def lens_crossover(spark, sf):
    """The first depth at which most vectors are closest to their own type, and at which the next type is closer than the own one for most."""
    c = gr.checkpointed(curve(spark, sf))
    own = ln.first_layer(c, "depth", "own_rank0").withColumnRenamed("layer", "own_layer")
    return own.crossJoin(ln.first_layer(c, "depth", "next_closer_than_own"))  # a row each


@query(f"""WITH {LENS(lexical=True)}, x AS (SELECT r.*, t.label top1, t.sim top_cos FROM ranks r JOIN top t ON t.vec_id = r.vec_id AND t.rank = 0)
    SELECT count(*) n, sum((own_rank > 0)::INT)::BIGINT own_rank_nonzero, sum((top1 <> own)::INT)::BIGINT top1_not_own, round(coalesce(max(CASE WHEN own_rank > 0 THEN top_cos - own_cos END), 0), 6) max_gap FROM x""")
def lens_sanity(spark, sf):
    """With a type's own vector as the query no other type may be closer."""
    r = lens(spark, sf, lexical=True).withColumn("first", F.col("top")[0])
    gap = F.max(F.when(F.col("own_rank") > 0, F.col("first.cos") - F.col("own_cos")))
    return r.agg(F.count("*").alias("n"), F.sum((F.col("own_rank") > 0).cast("int")).alias("own_rank_nonzero"), F.sum((F.col("first.label") != F.col("own")).cast("int")).alias("top1_not_own"), F.round(F.coalesce(gap, F.lit(0.0)), 6).alias("max_gap"))


@query(f"""WITH {LENS()}, x AS (SELECT r.*, t.label top1 FROM ranks r JOIN top t ON t.vec_id = r.vec_id AND t.rank = 0)
    SELECT count(*) FILTER (nxt IS NOT NULL) n, round(avg((argmax = nxt)::INT) FILTER (nxt IS NOT NULL), 6) argmax_is_next, round(avg((argmax = top1)::INT), 6) argmax_is_top1 FROM x""")
def lens_agreement(spark, sf):
    r = lens(spark, sf)
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return r.agg(F.count("nxt").alias("n"), share(F.when(F.col("nxt").isNotNull(), F.col("argmax") == F.col("nxt"))).alias("argmax_is_next"), share(F.col("argmax") == F.col("top")[0]["label"]).alias("argmax_is_top1"))
