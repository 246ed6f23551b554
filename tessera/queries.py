"""Registered queries over the driver tables and their SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as tx
from .operators import community as co
from .operators import graph as gr
from .operators import knn as kn
from .operators import order as od

QUERIES: dict = {}
ORACLES: dict = {}
EPS = 1e-6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- neighbours of embeddings. Representations: L01 the vectors, L02 their first 32 dimensions, L01c centred, lex the mean vector of the type.
def vectors(spark, sf, rep="L01") -> DataFrame:
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), F.col("embedding").cast("array<double>").alias("vec"))
    if rep == "L02":
        v = v.withColumn("vec", F.slice("vec", 1, 32))
    return kn.centred(v) if rep == "L01c" else v


def raw(spark, sf, rep="L01", typed=False) -> DataFrame:
    """(id, vec) of a representation for the neighbour operators, which take vectors as they are stored; typed: with the type."""
    if rep == "L01c":
        v = vectors(spark, sf, rep)
    else:
        v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), (F.slice("embedding", 1, 32) if rep == "L02" else F.col("embedding")).alias("vec"))
    return v.select("id", "type", "vec") if typed else v.select("id", "vec")


def cands(spark, sf, k=10, rep="L01", eps=EPS) -> DataFrame:
    return kn.candidates(raw(spark, sf, rep), k, eps)


def picked(spark, sf, picks, rep="L01") -> DataFrame:
    """(pick, src, dst, sim) of several picks from one scan."""
    return kn.neighbours(raw(spark, sf, rep), picks)


def seeded(spark, sf, seeds) -> DataFrame:
    """(pick, src, dst, sim) of random ties within 0.05, a pick a seed."""
    return picked(spark, sf, [kn.Pick(10, "random", 0.05, f"7|L01|10|{i}") for i in range(seeds)])


def nn(spark, sf, k=10, rep="L01", tie="position", eps=EPS, seed="") -> DataFrame:
    return picked(spark, sf, [kn.Pick(k, tie, eps, seed)], rep).select("src", "dst", "sim")


def verts(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"))


def _vec(rep: str) -> str:
    if rep == "L01c":
        return "v0 AS (SELECT vec_id id, label, embedding::DOUBLE[] v FROM embeddings), mu AS (SELECT list(m ORDER BY d) m FROM (SELECT d, avg(x) m FROM (SELECT unnest(v) x, generate_subscripts(v,1) d FROM v0) GROUP BY d)), v AS (SELECT id, label, list_transform(list_zip(v0.v, mu.m), lambda p: p[1]-p[2]) v FROM v0, mu)"
    return f"v AS (SELECT vec_id id, label, {'embedding[1:32]' if rep == 'L02' else 'embedding'}::DOUBLE[] v FROM embeddings)"


def NN(name="nn", k=10, rep="L01", order="dst", eps="1e-6", tie=None) -> str:
    p = name
    pick = "f OR b" if tie == "all" else f"f OR turn <= {k} - nf"
    return (
        f"{_vec(rep).replace('v AS', p + '_v AS').replace('v0', p + '_v0').replace('mu', p + '_mu')}, "
        f"{p}_s AS (SELECT a.id src, b.id dst, list_cosine_similarity(a.v, b.v) sim FROM {p}_v a JOIN {p}_v b ON a.id <> b.id), "
        f"{p}_k AS (SELECT src, min(sim) sk FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) rn FROM {p}_s) WHERE rn <= {k} GROUP BY src), "
        f"{p}_b AS (SELECT src, dst, sim, sim > sk + {eps}::DOUBLE f, abs(sim - sk) <= {eps}::DOUBLE b, sk FROM {p}_s JOIN {p}_k USING (src)), "
        f"{p} AS (SELECT src, dst, sim FROM (SELECT *, sum(f::INT) OVER (PARTITION BY src) nf, row_number() OVER (PARTITION BY src, b ORDER BY {order}) turn FROM {p}_b WHERE f OR b) WHERE {pick})"
    )


E_U = "e AS (SELECT DISTINCT least(src,dst) src, greatest(src,dst) dst FROM nn), bw AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), dg AS (SELECT vec_id id, count(src) degree FROM embeddings LEFT JOIN bw ON src = vec_id GROUP BY vec_id)"
DEG_IN = "dg AS (SELECT vec_id id, count(dst) degree FROM embeddings LEFT JOIN nn ON dst = vec_id GROUP BY vec_id)"


@query(f"WITH {NN()}, {DEG_IN} SELECT id, label, degree FROM dg JOIN embeddings ON vec_id = id ORDER BY degree DESC, id LIMIT 20")
def knn_hubs(spark, sf):
    d = gr.in_degrees(nn(spark, sf), verts(spark, sf)).join(verts(spark, sf), "id")
    return d.select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(20)


@query(f"WITH {NN()} SELECT src, dst, round(sim, 6) sim FROM nn")
def knn_position(spark, sf):
    return nn(spark, sf).select("src", "dst", F.round("sim", 6).alias("sim"))


@query(f"WITH {NN(tie='all', eps='0.01')} SELECT src, dst, round(sim, 6) sim FROM nn")
def knn_all_ties(spark, sf):
    return nn(spark, sf, tie="all", eps=0.01).select("src", "dst", F.round("sim", 6).alias("sim"))


MD5 = "md5(concat_ws('|', '7|L01|10|0', src, dst)), dst"


@query(f"WITH {NN(order=MD5, eps='0.01')} SELECT src, dst FROM nn")
def knn_random_md5(spark, sf):
    return nn(spark, sf, tie="random", eps=0.01, seed="7|L01|10|0").select("src", "dst")


@query(f"WITH {NN(rep='L01c')} SELECT src, dst, round(sim, 6) sim FROM nn")
def knn_centered(spark, sf):
    return nn(spark, sf, rep="L01c").select("src", "dst", F.round("sim", 6).alias("sim"))


@query(f"WITH {_vec('L01')}, s AS (SELECT a.id src, b.label dst, max(list_cosine_similarity(a.v, b.v)) sim FROM v a JOIN v b ON a.label <> b.label GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) rn FROM s) SELECT src, dst, round(sim, 6) sim FROM r WHERE rn <= 3")
def knn_type_variant(spark, sf):
    c = kn.neighbours(raw(spark, sf, typed=True).where("type is not null"), [kn.Pick(3, eps=0.0)], typed=True)
    return c.select("src", F.col("dst").cast("int").alias("dst"), F.round("sim", 6).alias("sim"))


LEX = (
    "t AS (SELECT label, list(m ORDER BY d) v FROM (SELECT label, d, avg(x) m FROM (SELECT label, unnest(embedding::DOUBLE[]) x, generate_subscripts(embedding,1) d FROM embeddings) GROUP BY 1,2) GROUP BY 1), "
    "ts AS (SELECT a.label la, b.label lb, CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE list_cosine_similarity(a.v, b.v) END sim FROM t a, t b), "
    "lex_s AS (SELECT a.vec_id src, b.vec_id dst, sim FROM embeddings a JOIN ts ON a.label = la JOIN embeddings b ON b.label = lb WHERE a.vec_id <> b.vec_id), "
    "lex_k AS (SELECT src, min(sim) sk FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) rn FROM lex_s) WHERE rn <= 80 GROUP BY src), "
    "lex_b AS (SELECT src, dst, sim, sim > sk + 1e-6::DOUBLE f, abs(sim - sk) <= 1e-6::DOUBLE b FROM lex_s JOIN lex_k USING (src)), "
    "lex AS (SELECT src, dst, sim FROM (SELECT *, sum(f::INT) OVER (PARTITION BY src) nf, row_number() OVER (PARTITION BY src, b ORDER BY dst) turn FROM lex_b WHERE f OR b) WHERE f OR turn <= 80 - nf)"
)


@query(f"WITH {LEX} SELECT src, dst, round(sim, 6) sim FROM lex")
def lex_factorized(spark, sf):
    v = vectors(spark, sf)
    return kn.lexical_neighbours(v.select("id", "type"), kn.type_vectors(v, "type"), 80).select("src", "dst", F.round("sim", 6).alias("sim"))


@query(f"WITH {NN(eps='0.01')}, p AS (SELECT src, sum(b::INT) nb, sum(f::INT) nf FROM nn_b WHERE f OR b GROUP BY src) SELECT sum((nb > 10 - nf)::INT)::BIGINT tied_rows, max(nb)::BIGINT largest_block, round(avg(nb + nf), 6) mean_size, max(nb + nf)::BIGINT max_size FROM p")
def tie_stats(spark, sf):
    n = kn.list_sizes(raw(spark, sf), [kn.Pick(10, eps=0.01)])
    return kn.size_stats(n, 10).withColumn("mean_size", F.round("mean_size", 6))


@query("WITH " + ", ".join(NN(f"n{i}", eps=e) for i, e in enumerate(("0", "1e-6", "0.01"))) + ", u AS (" + " UNION ALL ".join(f"SELECT {e}::DOUBLE eps, src, sum(b::INT) nb, sum(f::INT) nf FROM n{i}_b WHERE f OR b GROUP BY src" for i, e in enumerate(("0", "1e-6", "0.01"))) + ") SELECT eps, sum((nb > 10 - nf)::INT)::BIGINT tied_rows, max(nb + nf)::BIGINT max_size FROM u GROUP BY eps")
def eps_sensitivity(spark, sf):
    levels = (0.0, 1e-6, 0.01)
    n = kn.list_sizes(raw(spark, sf), [kn.Pick(10, eps=e) for e in levels])
    return kn.size_stats(n, 10, "pick").select(F.array(*map(F.lit, levels))[F.col("pick")].alias("eps"), "tied_rows", "max_size")


@query(f"WITH {NN().replace('FROM embeddings)', 'FROM embeddings WHERE label <> 0)', 1)} SELECT src, dst FROM nn")
def special_excluded_knn(spark, sf):
    v = raw(spark, sf, typed=True).where("type <> 0").select("id", "vec")
    return kn.neighbours(v, [kn.Pick(10)]).select("src", "dst")


# ---- graphs
@query(f"WITH {NN()} SELECT DISTINCT src, dst FROM nn WHERE src <> dst")
def edges_directed(spark, sf):
    return gr.directed(nn(spark, sf))


@query(f"WITH {NN()}, {E_U} SELECT src, dst FROM e")
def edges_union(spark, sf):
    return gr.union(nn(spark, sf))


@query(f"WITH {NN()} SELECT a.src, a.dst FROM nn a JOIN nn b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def edges_mutual(spark, sf):
    return gr.mutual(nn(spark, sf))


@query(f"WITH {NN()}, {E_U} SELECT degree, count(*) n FROM dg GROUP BY degree")
def degree_hist(spark, sf):
    return gr.degrees(gr.union(nn(spark, sf)), verts(spark, sf)).groupBy("degree").agg(F.count("*").alias("n"))


@query(f"WITH {NN()}, {DEG_IN}, h AS (SELECT degree, count(*) n FROM dg GROUP BY degree) SELECT degree, round(p, 9) p FROM (SELECT degree, sum(n) OVER (ORDER BY degree DESC) / sum(n) OVER ()::DOUBLE p FROM h) WHERE degree > 0")
def degree_ccdf(spark, sf):
    h = gr.in_degrees(nn(spark, sf), verts(spark, sf)).groupBy("degree").agg(F.count("*").alias("n"))  # one row a distinct degree
    w = Window.orderBy(F.desc("degree"))
    return h.select("degree", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 9).alias("p")).where("degree > 0")


@query(f"WITH {NN()}, {DEG_IN} SELECT round(avg(degree), 6) mean, round(stddev_pop(degree), 6) sd, max(degree) top, round(avg((degree = 0)::INT), 6) zero_share, round(avg(power(degree - m, 3)) / power(avg(power(degree - m, 2)), 1.5), 5) skew FROM dg, (SELECT avg(degree) m FROM dg)")
def directed_stats(spark, sf):
    d = gr.in_degrees(nn(spark, sf), verts(spark, sf))
    return d.agg(F.round(F.avg("degree"), 6).alias("mean"), F.round(F.stddev_pop("degree"), 6).alias("sd"), F.max("degree").alias("top"), F.round(F.avg((F.col("degree") == 0).cast("int")), 6).alias("zero_share"), F.round(F.skewness("degree"), 5).alias("skew"))


@query(f"WITH {NN()} SELECT round(count(b.src) / count(*)::DOUBLE, 9) reciprocity FROM nn a LEFT JOIN nn b ON a.src = b.dst AND a.dst = b.src")
def reciprocity(spark, sf):
    a = nn(spark, sf).select("src", "dst")
    e = a.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return e.agg(F.round(F.sum(F.when(F.col("n") == 2, 2).otherwise(0)) / F.sum("n"), 9).alias("reciprocity"))


TRI = "tr AS (SELECT x.src a, x.dst b, y.dst c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst), tv AS (SELECT a id FROM tr UNION ALL SELECT b FROM tr UNION ALL SELECT c FROM tr), cl AS (SELECT dg.id, degree, count(tv.id) t FROM dg LEFT JOIN tv USING (id) GROUP BY dg.id, degree)"


@query(f"WITH {NN()}, {E_U}, {TRI} SELECT id, degree, t triangles, round(CASE WHEN degree >= 2 THEN 2.0::DOUBLE * t / (degree * (degree - 1)) END, 9) local FROM cl")
def triangles_clustering(spark, sf):
    return gr.clustering(gr.union(nn(spark, sf)), verts(spark, sf)).select("id", "degree", "triangles", F.round("local", 9).alias("local"))


@query(f"WITH {NN()}, {E_U}, {TRI} SELECT count(*) n, (SELECT count(*) FROM e) m, round(avg(degree), 6) mean_degree, round(coalesce(sum(t) / nullif(sum(degree * (degree - 1) / 2)::DOUBLE, 0), 0), 6) transitivity, round(avg(CASE WHEN degree >= 2 THEN 2.0::DOUBLE * t / (degree * (degree - 1)) END), 6) mean_local FROM cl")
def graph_summary(spark, sf):
    c = gr.clustering(gr.union(nn(spark, sf)), verts(spark, sf))
    return c.agg(F.count("*").alias("n"), (F.sum("degree") / 2).cast("long").alias("m"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.round(F.coalesce(F.sum("triangles") / F.nullif(F.sum(F.col("degree") * (F.col("degree") - 1) / 2), F.lit(0.0)), F.lit(0.0)), 6).alias("transitivity"), F.round(F.avg("local"), 6).alias("mean_local"))


@query(f"WITH {NN()}, w AS (SELECT src, dst, count(*) w FROM (SELECT src, dst FROM nn UNION ALL SELECT dst, src FROM nn) GROUP BY 1, 2), p AS (SELECT src id, sum(w) s, sum((w = 2)::INT) r FROM w GROUP BY src), c AS (SELECT x.src id, sum(x.w * y.w * z.w) t FROM w x JOIN w y ON x.dst = y.src JOIN w z ON y.dst = z.src AND z.dst = x.src GROUP BY x.src) SELECT vec_id id, round(CASE WHEN s * (s - 1) - 2 * r > 0 THEN coalesce(t, 0) / 2.0::DOUBLE / (s * (s - 1) - 2 * r) END, 9) local FROM embeddings LEFT JOIN p ON p.id = vec_id LEFT JOIN c ON c.id = vec_id")
def directed_clustering(spark, sf):
    return gr.directed_clustering(nn(spark, sf), verts(spark, sf)).select("id", F.round("local", 9).alias("local"))


NN3 = NN(k=2)
REACH = "bw AS (SELECT src, dst FROM nn UNION SELECT dst, src FROM nn)"


@query(f"WITH RECURSIVE {NN3}, {REACH}, r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT bw.dst, r.root FROM r JOIN bw ON bw.src = r.id) SELECT id, min(root) component FROM r GROUP BY id")
def components(spark, sf):
    return gr.components(gr.union(nn(spark, sf, k=2)), verts(spark, sf))


@query(f"WITH RECURSIVE {NN3}, {REACH}, r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT bw.dst, r.root FROM r JOIN bw ON bw.src = r.id), c AS (SELECT id, min(root) component FROM r GROUP BY id) SELECT size, count(*) n FROM (SELECT component, count(*) size FROM c GROUP BY component) GROUP BY size")
def component_sizes(spark, sf):
    c = gr.components(gr.union(nn(spark, sf, k=2)), verts(spark, sf))
    return c.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


BFS = """r(root, id, d) USING KEY (root, id) AS (SELECT vec_id, vec_id, 0 FROM embeddings UNION SELECT r.root, a.dst, min(r.d) + 1 FROM r JOIN a ON a.src = r.id
    WHERE NOT EXISTS (SELECT 1 FROM recurring.r x WHERE x.root = r.root AND x.id = a.dst) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {NN()}, a AS (SELECT src, dst FROM nn UNION SELECT dst, src FROM nn), {BFS} SELECT d::BIGINT d, count(*) pairs FROM r WHERE d > 0 GROUP BY d")
def distance_hist(spark, sf):
    """Ordered pairs of all vertices at each distance."""
    return gr.distances(gr.both_ways(gr.union(nn(spark, sf))), verts(spark, sf))


@query(f"""WITH RECURSIVE {NN()}, a AS (SELECT src, dst FROM nn), {BFS}, n AS (SELECT count(*)::DOUBLE * (count(*) - 1) n FROM embeddings)
    SELECT count(*) reached, round(avg(d), 6) mean, max(d)::BIGINT diameter, round(sum(1.0::DOUBLE / d), 6) efficiency_sum, round(count(*) / any_value(n), 9) reachable_share,
    round(sum(1.0::DOUBLE / d) / any_value(n), 9) efficiency FROM r, n WHERE d > 0""")
def directed_efficiency(spark, sf):
    """Directed distances between all vertices; share and efficiency over all ordered pairs, 1/d of an unreachable one 0."""
    h = gr.distances(nn(spark, sf), verts(spark, sf))
    all_pairs = verts(spark, sf).agg(F.nullif(F.count("*") * (F.count("*") - 1), F.lit(0)).alias("all_pairs"))
    sums = h.agg(F.sum("pairs").alias("reached"), F.round(F.sum(F.col("d") * F.col("pairs")) / F.sum("pairs"), 6).alias("mean"), F.max("d").alias("diameter"), F.sum(F.col("pairs") / F.col("d")).alias("s"))
    return sums.crossJoin(all_pairs).select("reached", "mean", "diameter", F.round("s", 6).alias("efficiency_sum"), F.round(F.col("reached") / F.col("all_pairs"), 9).alias("reachable_share"), F.round(F.col("s") / F.col("all_pairs"), 9).alias("efficiency"))


@query(f"""WITH RECURSIVE {NN(k=3)}, r(root, id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.root, nn.dst FROM r JOIN nn ON nn.src = r.id)
    SELECT a.root id, min(a.id) component FROM r a JOIN r b ON a.root = b.id AND a.id = b.root GROUP BY a.root""")
def strong_components(spark, sf):
    return gr.strong_components(nn(spark, sf, k=3), verts(spark, sf))


@query(f"WITH {NN()}, {E_U}, mx AS (SELECT p.label a, q.label b, count(*)::DOUBLE n FROM bw JOIN embeddings p ON p.vec_id = src JOIN embeddings q ON q.vec_id = dst GROUP BY 1, 2), t AS (SELECT sum(n) m, sum(CASE WHEN a = b THEN n ELSE 0 END) s FROM mx), k AS (SELECT sum(x * x) sq FROM (SELECT a, sum(n) x FROM mx GROUP BY a)) SELECT round((s / m - sq / m / m) / (1 - sq / m / m), 6) assortativity, round(s / m, 6) same_share FROM t, k")
def assortativity(spark, sf):
    a = gr.assortativity(gr.union(nn(spark, sf)), verts(spark, sf))
    return a.select(*(F.round(c, 6).alias(c) for c in a.columns))


@query(f"WITH {NN('n1')}, {NN('n2', rep='L02')}, a AS (SELECT DISTINCT least(src,dst) s, greatest(src,dst) d FROM n1), b AS (SELECT DISTINCT least(src,dst) s, greatest(src,dst) d FROM n2) SELECT round(i / (x + y - i)::DOUBLE, 9) jaccard FROM (SELECT (SELECT count(*) FROM a JOIN b USING (s, d)) i, (SELECT count(*) FROM a) x, (SELECT count(*) FROM b) y)")
def edge_jaccard(spark, sf):
    a, b = (gr.union(nn(spark, sf, rep=r)) for r in ("L01", "L02"))
    n = a.unionAll(b).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.sum(F.when(F.col("n") == 2, 1).otherwise(0)) / F.count("*"), 9).alias("jaccard"))


@query(f"""WITH {NN()}, {E_U}, h AS (SELECT src, dst, md5(concat_ws('|', src, dst)) h FROM e), n AS (SELECT count(*) n FROM embeddings),
    t AS (SELECT count(*) edges, sum(src)::BIGINT src_sum, sum(dst)::BIGINT dst_sum, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR a, sum(('0x' || substr(h, 17, 15))::BIGINT)::VARCHAR b FROM h)
    SELECT edges, src_sum, dst_sum, md5(concat_ws('|', n, edges, a, b)) digest FROM t, n""")
def graph_fingerprint(spark, sf):
    """Counts of the union graph and the digest of its edge set."""
    return gr.fingerprint(gr.union(nn(spark, sf)), verts(spark, sf))


@query(f"WITH {NN()}, {E_U} SELECT src, dst FROM e WHERE src IN (SELECT vec_id FROM embeddings WHERE label < 5) AND dst IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def induced_core(spark, sf):
    core = verts(spark, sf).where("label < 5")
    e = gr.union(nn(spark, sf))
    return e.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_semi")


# ---- neighbourhoods
J12 = f"WITH {NN('n1')}, {NN('n2', rep='L02')}, i AS (SELECT src, count(*) i FROM n1 JOIN n2 USING (src, dst) GROUP BY src), jac AS (SELECT vec_id id, label, coalesce(i, 0) / (20 - coalesce(i, 0))::DOUBLE j FROM embeddings LEFT JOIN i ON src = vec_id)"


def jac(spark, sf) -> DataFrame:
    """Per-row Jaccard of the neighbour sets in L01 and L02, from one count over both."""
    both = nn(spark, sf).select("src", "dst").unionAll(nn(spark, sf, rep="L02").select("src", "dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    j = both.groupBy(F.col("src").alias("id")).agg((F.sum((F.col("n") == 2).cast("int")) / F.count("*")).alias("j"))
    return verts(spark, sf).join(j, "id")


@query(f"{J12} SELECT id, round(j, 9) j FROM jac")
def jaccard(spark, sf):
    return jac(spark, sf).select("id", F.round("j", 9).alias("j"))


def _labelled(spark, sf, n: DataFrame) -> DataFrame:
    v = verts(spark, sf)
    return n.join(v.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(v.withColumnsRenamed({"id": "dst", "label": "b"}), "dst")


@query(f"WITH {NN('n1')}, {NN('n2', rep='L02')}, a AS (SELECT src, label, count(*) n FROM n1 JOIN embeddings ON vec_id = dst GROUP BY 1, 2), b AS (SELECT src, label, count(*) n FROM n2 JOIN embeddings ON vec_id = dst GROUP BY 1, 2) SELECT src id, round(sum(least(coalesce(a.n,0), coalesce(b.n,0))) / sum(greatest(coalesce(a.n,0), coalesce(b.n,0)))::DOUBLE, 9) jw, round(sum((a.n IS NOT NULL AND b.n IS NOT NULL)::INT) / count(*)::DOUBLE, 9) jc FROM a FULL JOIN b USING (src, label) GROUP BY src")
def weighted_jaccard(spark, sf):
    per = None
    for i, r in enumerate(("L01", "L02")):
        one = _labelled(spark, sf, nn(spark, sf, rep=r)).select("src", "b", F.lit(1 - i).alias("x"), F.lit(i).alias("y"))
        per = one if per is None else per.unionAll(one)
    c = per.groupBy("src", "b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return c.groupBy(F.col("src").alias("id")).agg(F.round(F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y")), 9).alias("jw"), F.round(F.sum(((F.col("x") > 0) & (F.col("y") > 0)).cast("int")) / F.count("*"), 9).alias("jc"))


DOM = f"WITH {NN()}, f AS (SELECT label, count(*) f FROM embeddings GROUP BY label), dom AS (SELECT src id, p.label, avg((p.label = q.label)::INT) d, least(any_value(f) - 1, 10) / 10.0::DOUBLE ceiling FROM nn JOIN embeddings p ON p.vec_id = src JOIN embeddings q ON q.vec_id = dst JOIN f ON f.label = p.label GROUP BY 1, 2)"


def dom(spark, sf) -> DataFrame:
    f = verts(spark, sf).groupBy(F.col("label").alias("a")).agg(F.count("*").alias("f"))
    d = _labelled(spark, sf, nn(spark, sf)).groupBy(F.col("src").alias("id"), "a").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("d"))
    return d.join(f, "a").select("id", F.col("a").alias("label"), "d", (F.least(F.col("f") - 1, F.lit(10)) / 10.0).cast("double").alias("ceiling"))


@query(f"{DOM} SELECT id, round(d, 9) d, round(d / nullif(ceiling, 0), 9) dn FROM dom")
def dominance(spark, sf):
    return dom(spark, sf).select("id", F.round("d", 9).alias("d"), F.round(F.col("d") / F.nullif("ceiling", F.lit(0.0)), 9).alias("dn"))


def R(i):
    return NN(f"r{i}", order=f"md5(concat_ws('|', '7|L01|10|{i}', src, dst)), dst", eps="0.05")


@query(f"WITH {R(0)}, {R(1)}, i AS (SELECT r0.src, count(*) i FROM r0 JOIN r1 USING (src, dst) GROUP BY r0.src) SELECT vec_id id, round(coalesce(i, 0) / (20 - coalesce(i, 0))::DOUBLE, 9) floor FROM embeddings LEFT JOIN i ON src = vec_id")
def noise_floor(spark, sf):
    n = seeded(spark, sf, 2).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("src").alias("id")).agg(F.round(F.sum((F.col("n") == 2).cast("int")) / F.count("*"), 9).alias("floor"))


@query(f"{J12} SELECT label, id % 3 AS grp, count(j) n, round(avg(j), 6) mean, round(median(j), 6) median, round(stddev_samp(j), 6) sd, round(quantile_cont(j, 0.25::DOUBLE), 6) q25, round(quantile_cont(j, 0.75::DOUBLE), 6) q75 FROM jac GROUP BY GROUPING SETS ((), (label), (id % 3), (label, id % 3))")
def summary_grouping_sets(spark, sf):
    j = jac(spark, sf).withColumn("grp", F.col("id") % 3)
    g = j.groupingSets([[], ["label"], ["grp"], ["label", "grp"]], "label", "grp") if hasattr(j, "groupingSets") else j.cube("label", "grp")
    r = lambda x: F.round(x, 6)
    return g.agg(F.count("j").alias("n"), r(F.avg("j")).alias("mean"), r(F.median("j")).alias("median"), r(F.stddev_samp("j")).alias("sd"), r(F.percentile("j", 0.25)).alias("q25"), r(F.percentile("j", 0.75)).alias("q75"))


K3 = [(k, NN(f"k{k}", k=k)) for k in (5, 10, 20)]


@query("WITH " + ", ".join(x for _, x in K3) + " " + " UNION ALL ".join(f"SELECT {k} k, round(avg((p.label = q.label)::INT), 6) d, count(*) arcs FROM k{k} JOIN embeddings p ON p.vec_id = src JOIN embeddings q ON q.vec_id = dst" for k, _ in K3))
def robustness_grid(spark, sf):
    ks = (5, 10, 20)
    n = _labelled(spark, sf, picked(spark, sf, [kn.Pick(k) for k in ks])).groupBy("pick").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("d"), F.count("*").alias("arcs"))
    return n.select(F.array(*map(F.lit, ks))[F.col("pick")].alias("k"), "d", "arcs")


# ---- partitions
AGREE = "n AS (SELECT sum(n)::DOUBLE t FROM c), a AS (SELECT a, sum(n)::DOUBLE s, max(n) m FROM c GROUP BY a), b AS (SELECT b, sum(n)::DOUBLE s, max(n) m FROM c GROUP BY b), ha AS (SELECT -sum(s/t*ln(s/t)) h, sum(s*(s-1)/2) p, sum(m)/any_value(t) pu FROM a, n), hb AS (SELECT -sum(s/t*ln(s/t)) h, sum(s*(s-1)/2) p, sum(m)/any_value(t) pu FROM b, n), hab AS (SELECT -sum(n.n1/t*ln(n.n1/t)) h, sum(n.n1*(n.n1-1)/2) p FROM (SELECT n::DOUBLE n1 FROM c) n, n AS tt(t)), pr AS (SELECT t*(t-1)/2 q FROM n) SELECT t::BIGINT n, round(2*(ha.h+hb.h-hab.h)/(ha.h+hb.h), 6) nmi, round((hab.p - ha.p*hb.p/q)/((ha.p+hb.p)/2 - ha.p*hb.p/q), 6) ari, round(ha.pu, 6) purity, round(hb.pu, 6) inverse_purity FROM n, ha, hb, hab, pr"


@query(f"WITH c AS (SELECT lang a, source b, count(*) n FROM documents WHERE lang <> '' AND source <> '' GROUP BY 1, 2), {AGREE}")
def partition_agreement(spark, sf):
    p = co.agreement(read(spark, sf, "documents").select(F.col("lang").alias("a"), F.col("source").alias("b")))
    return p.select("n", *(F.round(c, 6).alias(c) for c in p.columns[1:]))


@query("WITH p AS (SELECT lang, row_number() OVER (ORDER BY doc_id) i FROM documents), q AS (SELECT source, row_number() OVER (ORDER BY md5(concat_ws('|', '7', doc_id)), doc_id) i FROM documents), c AS (SELECT lang a, source b, count(*) n FROM p JOIN q USING (i) GROUP BY 1, 2), " + AGREE)
def nmi_baseline_md5(spark, sf):
    """Agreement after one seeded permutation of the labels."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "source")
    p = od.numbered(d.select("doc_id", "lang"), ["doc_id"], "i")
    q = od.numbered(d.select("doc_id", "source", F.md5(F.concat_ws("|", F.lit("7"), "doc_id")).alias("h")), ["h", "doc_id"], "i")
    r = co.agreement(p.join(q, "i").select(F.col("lang").alias("a"), F.col("source").alias("b")))
    return r.select("n", *(F.round(c, 6).alias(c) for c in r.columns[1:]))


@query(f"WITH {NN()}, {E_U}, x AS (SELECT p.label a, q.label b FROM e JOIN embeddings p ON p.vec_id = src JOIN embeddings q ON q.vec_id = dst), m AS (SELECT count(*)::DOUBLE m FROM x), d AS (SELECT c, count(*) d FROM (SELECT a c FROM x UNION ALL SELECT b FROM x) GROUP BY c), l AS (SELECT a c, count(*) l FROM x WHERE a = b GROUP BY a) SELECT round(sum(coalesce(l, 0) / m - power(d / (2 * m), 2)), 6) modularity FROM d LEFT JOIN l USING (c), m")
def modularity_labels(spark, sf):
    return co.modularity(gr.union(nn(spark, sf)), verts(spark, sf).withColumnRenamed("label", "community")).select(F.round("modularity", 6).alias("modularity"))


@query("WITH s AS (SELECT source, count(*) n, min(doc_id) f FROM documents GROUP BY source), r AS (SELECT source, row_number() OVER (ORDER BY n DESC, f) - 1 c FROM s) SELECT doc_id id, c community FROM documents JOIN r USING (source)")
def canonical_labels(spark, sf):
    return co.canonical(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("community")))


def _communities(spark, sf, method):
    e = gr.checkpointed(gr.union(nn(spark, sf)))
    p = gr.checkpointed(co.communities(e.withColumn("graph_id", F.lit("L01|k10|union")), method=method))
    best = None
    for s in range(3):
        q = co.modularity(e, p.where(F.col("seed") == s).select("id", "community")).withColumn("seed", F.lit(s))
        best = q if best is None else best.unionByName(q)
    win = best.agg(F.max_by("seed", F.struct("modularity", -F.col("seed"))).alias("seed"))
    return co.canonical(p.join(F.broadcast(win), "seed").select("id", "community"))


@query()
def leiden(spark, sf):
    return _communities(spark, sf, "leiden")


@query()
def louvain(spark, sf):
    return _communities(spark, sf, "louvain")


@query("WITH c AS (SELECT source, lang, count(*) n FROM documents GROUP BY 1, 2), t AS (SELECT source, sum(n)::BIGINT size, sum(n)::DOUBLE t FROM c GROUP BY 1), r AS (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) k FROM c) SELECT source community, size, r.lang main_class, round(r.n / t, 6) main_share, round(exp(h), 6) effective FROM t JOIN r USING (source) JOIN (SELECT source, -sum(n / t * ln(n / t)) h FROM c JOIN t USING (source) GROUP BY source) USING (source) WHERE k = 1")
def community_profile(spark, sf):
    c = read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source")
    x = c.withColumn("t", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "lang"))).withColumn("s", F.col("n") / F.col("t"))
    return x.groupBy(F.col("source").alias("community")).agg(F.sum("n").alias("size"), F.max(F.when(F.col("k") == 1, F.col("lang"))).alias("main_class"), F.round(F.max(F.when(F.col("k") == 1, F.col("s"))), 6).alias("main_share"), F.round(F.exp(-F.sum(F.col("s") * F.log("s"))), 6).alias("effective"))


@query(f"WITH {_vec('L01')} SELECT a.label, round(avg(CASE WHEN a.id % 2 = b.id % 2 THEN list_cosine_similarity(a.v, b.v) END), 6) within_mean, round(avg(CASE WHEN a.id % 2 <> b.id % 2 THEN list_cosine_similarity(a.v, b.v) END), 6) between_mean, count(*) pairs FROM v a JOIN v b ON a.label = b.label AND a.id < b.id GROUP BY a.label")
def pair_means(spark, sf):
    """Mean cosine within and between halves of each type, from sums of unit vectors instead of pairs."""
    u = vectors(spark, sf).select("type", (F.col("id") % 2).alias("h"), F.posexplode(kn.unit(F.col("vec"))).alias("dim", "x"))
    s = u.groupBy("type", "dim").agg(F.sum(F.when(F.col("h") == 0, F.col("x")).otherwise(0.0)).alias("s0"), F.sum(F.when(F.col("h") == 1, F.col("x")).otherwise(0.0)).alias("s1"))
    n = verts(spark, sf).groupBy(F.col("label").alias("type")).agg(F.sum((F.col("id") % 2 == 0).cast("int")).alias("n0"), F.sum((F.col("id") % 2 == 1).cast("int")).alias("n1"))
    d = s.groupBy("type").agg(F.sum(F.col("s0") * F.col("s0")).alias("q0"), F.sum(F.col("s1") * F.col("s1")).alias("q1"), F.sum(F.col("s0") * F.col("s1")).alias("q01")).join(n, "type")
    within = (F.col("q0") - F.col("n0") + F.col("q1") - F.col("n1")) / 2
    c2 = (F.col("n0") * (F.col("n0") - 1) + F.col("n1") * (F.col("n1") - 1)) / 2
    return d.select(F.col("type").alias("label"), F.round(within / F.nullif(c2, F.lit(0.0)), 6).alias("within_mean"), F.round(F.col("q01") / F.nullif(F.col("n0") * F.col("n1"), F.lit(0)), 6).alias("between_mean"), (c2 + F.col("n0") * F.col("n1")).cast("long").alias("pairs"))


# ---- vectors
@query("WITH n AS (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) x FROM embeddings) SELECT round(min(x), 6) lo, round(quantile_cont(x, 0.25::DOUBLE), 6) q25, round(median(x), 6) med, round(quantile_cont(x, 0.75::DOUBLE), 6) q75, round(max(x), 6) hi FROM n")
def vec_norm_quantiles(spark, sf):
    x = vectors(spark, sf).select(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)).alias("x"))
    return x.agg(F.round(F.min("x"), 6).alias("lo"), F.round(F.percentile("x", 0.25), 6).alias("q25"), F.round(F.median("x"), 6).alias("med"), F.round(F.percentile("x", 0.75), 6).alias("q75"), F.round(F.max("x"), 6).alias("hi"))


@query("SELECT d::INT dim, round(avg(abs(x)), 6) mean_abs FROM (SELECT unnest(embedding::DOUBLE[]) x, generate_subscripts(embedding,1) - 1 d FROM embeddings) GROUP BY d ORDER BY avg(abs(x)) DESC, d LIMIT 8")
def vec_top_dims(spark, sf):
    return vectors(spark, sf).select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg(F.abs("x")).alias("m")).orderBy(F.desc("m"), "dim").limit(8).select("dim", F.round("m", 6).alias("mean_abs"))


@query(f"WITH {_vec('L01')} SELECT round(avg(list_cosine_similarity(a.v, b.v)), 6) anisotropy FROM v a JOIN v b ON a.id < b.id")
def vec_anisotropy(spark, sf):
    s = vectors(spark, sf).select(F.posexplode(kn.unit(F.col("vec"))).alias("dim", "x")).groupBy("dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return s.agg(F.round((F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n") * (F.max("n") - 1)), 6).alias("anisotropy"))


# ---- text
def words(col="text"):
    return F.regexp_extract_all(F.col(col), F.lit(r"(?U)(\w+)"), F.lit(1))


DW = r"regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+')"


@query(f"SELECT lower(w) token, count(*) f FROM (SELECT unnest({DW}) w FROM documents) GROUP BY 1")
def token_counts(spark, sf):
    return read(spark, sf, "documents").select(F.explode(words()).alias("w")).groupBy(F.lower("w").alias("token")).agg(F.count("*").alias("f"))


@query("SELECT CASE WHEN l_linenumber <= 1 THEN '1' WHEN l_linenumber <= 4 THEN '2-4' ELSE '5+' END bucket, CASE WHEN l_quantity < 10 THEN '1-9' WHEN l_quantity < 30 THEN '10-29' ELSE '30+' END band, count(*) n FROM lineitem GROUP BY 1, 2")
def bands_buckets(spark, sf):
    q = F.col("l_quantity")
    b = F.when(F.col("l_linenumber") < 1, F.raise_error(F.lit("position below 1"))).when(F.col("l_linenumber") <= 1, "1").when(F.col("l_linenumber") <= 4, "2-4").otherwise("5+")
    return read(spark, sf, "lineitem").select(b.alias("bucket"), F.when(q < 10, "1-9").when(q < 30, "10-29").otherwise("30+").alias("band")).groupBy("bucket", "band").agg(F.count("*").alias("n"))


_SCRIPTS = "|".join(f"\\p{{{n}}}+" for n in tx.SCRIPTS)


@query(f"""WITH t AS (SELECT unnest(string_split_regex(text, '[ \\n]')) t FROM documents), w AS (SELECT t, regexp_replace(t, '^\\s+|\\s+$', '', 'g') x FROM t)
    SELECT CASE WHEN contains(t, chr(65533)) THEN 'byte_fragment' WHEN x = '' THEN 'whitespace' WHEN regexp_full_match(x, '\\p{{Nd}}+') THEN 'digits'
    WHEN NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]') THEN 'punctuation' WHEN regexp_full_match(x, '\\p{{Latin}}+') THEN 'latin'
    WHEN regexp_full_match(x, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]+') THEN 'cjk' WHEN regexp_full_match(x, '{_SCRIPTS}') THEN 'other_script' ELSE 'mixed' END script, count(*) n
    FROM w GROUP BY 1""")
def script_class(spark, sf):
    w = read(spark, sf, "documents").select(F.explode(F.split("text", "[ \n]")).alias("w"))
    return w.select(tx.script_class(F.col("w")).alias("script")).groupBy("script").agg(F.count("*").alias("n"))


PAR = "p AS (SELECT doc_id, lang, i, trim(x) x FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) - 1 i FROM documents) WHERE trim(x) <> '')"
KEEP = "len(regexp_extract_all(x, '[^ ]+')) >= 8 AND regexp_matches(x, '[.!?][\"''»”’)\\]]*$') AND NOT regexp_matches(x, '^[|!{*#:;]') AND length(regexp_replace(x, '[^0-9]', '', 'g')) / length(x)::DOUBLE <= 0.2"


def paragraphs(spark, sf) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    return d.withColumn("x", F.trim("x")).where("x <> ''")


def kept_paragraphs(spark, sf) -> DataFrame:
    n = F.size(F.regexp_extract_all("x", F.lit("([^ ]+)"), F.lit(1)))
    return paragraphs(spark, sf).where((n >= 8) & F.col("x").rlike("[.!?][\"'»”’)\\]]*$") & ~F.col("x").rlike("^[|!{*#:;]") & (F.length(F.regexp_replace("x", "[^0-9]", "")) / F.length("x") <= 0.2))


@query(f"WITH {PAR} SELECT doc_id, i::INT i, length(x) n FROM p WHERE {KEEP}")
def paragraph_filter(spark, sf):
    return kept_paragraphs(spark, sf).select("doc_id", "i", F.length("x").cast("long").alias("n"))


@query(f"WITH {PAR}, r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY lower(substring(x, 1, 80)) ORDER BY doc_id, i) k FROM p WHERE {KEEP}) SELECT doc_id, i::INT i FROM r WHERE k = 1")
def paragraph_dedup(spark, sf):
    """First paragraph of each opening: a minimum over (doc_id, i) instead of a window, so a common opening is no hot task."""
    return kept_paragraphs(spark, sf).groupBy(F.lower(F.substring("x", 1, 80)).alias("key")).agg(F.min(F.struct("doc_id", "i")).alias("m")).select("m.doc_id", "m.i")


# ---- sampling and quotas
@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY md5(concat_ws('|', '7', l_partkey, l_orderkey, l_linenumber)), l_orderkey, l_linenumber) k FROM lineitem) WHERE k <= 5")
def cap_uniform(spark, sf):
    w = Window.partitionBy("l_partkey").orderBy(F.md5(F.concat_ws("|", F.lit("7"), "l_partkey", "l_orderkey", "l_linenumber")), "l_orderkey", "l_linenumber")
    return read(spark, sf, "lineitem").withColumn("k", F.row_number().over(w)).where("k <= 5").select("l_partkey", "l_orderkey", "l_linenumber")


@query("WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY md5(concat_ws(':', '7', c_custkey)), c_custkey) k, c_nationkey FROM customer), g AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY k, c_nationkey, c_custkey) t FROM r) SELECT c_mktsegment, c_custkey, t turn FROM g WHERE t <= 40")
def round_robin(spark, sf):
    a = Window.partitionBy("c_mktsegment", "c_nationkey").orderBy(F.md5(F.concat_ws(":", F.lit("7"), "c_custkey")), "c_custkey")
    b = Window.partitionBy("c_mktsegment").orderBy("k", "c_nationkey", "c_custkey")
    return read(spark, sf, "customer").withColumn("k", F.row_number().over(a)).withColumn("turn", F.row_number().over(b)).where("turn <= 40").select("c_mktsegment", "c_custkey", "turn")


@query("WITH c AS (SELECT l_partkey, l_returnflag, count(*) n FROM lineitem GROUP BY 1, 2) SELECT l_partkey, sum(n)::BIGINT total, sum((n >= 5)::INT)::BIGINT themes FROM c GROUP BY 1 HAVING sum((n >= 5)::INT) >= 2")
def multitheme_eligible(spark, sf):
    c = read(spark, sf, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"))
    return c.groupBy("l_partkey").agg(F.sum("n").alias("total"), F.sum((F.col("n") >= 5).cast("int")).alias("themes")).where("themes >= 2")


@query("WITH c AS (SELECT l_partkey, l_returnflag, l_suppkey, count(*) n FROM lineitem GROUP BY 1, 2, 3) SELECT l_partkey, l_returnflag, sum(least(n, 3))::BIGINT drawable, sum(n)::BIGINT raw FROM c GROUP BY 1, 2")
def theme_counts(spark, sf):
    c = read(spark, sf, "lineitem").groupBy("l_partkey", "l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return c.groupBy("l_partkey", "l_returnflag").agg(F.sum(F.least("n", F.lit(3))).alias("drawable"), F.sum("n").alias("raw"))


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) n FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority top FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) k FROM c) WHERE k = 1")
def majority_category(spark, sf):
    c = read(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return c.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("m"), "o_orderpriority")).alias("x")).select("o_custkey", F.col("x.o_orderpriority").alias("top"))


@query("SELECT l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_strata(spark, sf):
    return read(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT n_name, sum((r_name = 'ASIA')::INT)::BIGINT asia, sum((r_name = 'EUROPE')::INT)::BIGINT europe, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def reasons_pivot(spark, sf):
    j = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.sum((F.col("r_name") == "ASIA").cast("int")).alias("asia"), F.sum((F.col("r_name") == "EUROPE").cast("int")).alias("europe"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT conv_id, turn, coalesce(md5(role), 'null') || coalesce(md5(text), 'null') p FROM conversations),
    k AS (SELECT conv_id, turn, md5(string_agg(p, '|' ORDER BY turn, p) OVER (PARTITION BY conv_id ORDER BY turn, p ROWS UNBOUNDED PRECEDING)) h FROM p),
    g AS (SELECT h, min(conv_id) first FROM k GROUP BY h HAVING count(*) > 1) SELECT conv_id, turn, first FROM k JOIN g USING (h)""")
def prefix_groups(spark, sf):
    """Turns whose prefixes, roles and whole texts up to and with them, are identical.

    A prefix is known by its length and two running sums of hashes of each turn with its place, so a row never holds the turns before it.
    """
    c = read(spark, sf, "conversations").withColumn("p", F.concat(*(F.coalesce(F.md5(x), F.lit("null")) for x in ("role", "text"))))
    w = Window.partitionBy("conv_id").orderBy("turn", "p")
    c = c.select("conv_id", "turn", "p", F.row_number().over(w).alias("size"))
    sums = [F.sum(F.xxhash64(F.lit(salt), "size", "p").cast("decimal(38,0)")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"h{salt}") for salt in (1, 2)]
    k = c.select("conv_id", "turn", "size", *sums)
    g = k.groupBy("size", "h1", "h2").agg(F.min("conv_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return k.join(g, ["size", "h1", "h2"]).select("conv_id", "turn", "first")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000")
def exceptall_diff(spark, sf):
    o = read(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").exceptAll(o.where("o_totalprice > 100000").select("o_orderkey", "o_custkey"))


CRAWL = """t AS (SELECT DISTINCT c_custkey % 97 p, o_orderkey % 211 + 1000 c FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 7 = 0
    UNION SELECT DISTINCT o_orderkey % 211 + 1000, o_custkey % 389 + 5000 FROM orders WHERE o_orderkey % 11 = 0 UNION SELECT DISTINCT o_custkey % 389 + 5000, o_custkey % 97 FROM orders WHERE o_orderkey % 13 = 0)"""


def crawl_tree(spark, sf):
    """Arcs (p, c) of a category tree with loops: three bands of nodes made of customers and orders."""
    o = read(spark, sf, "orders")
    one = o.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("o_orderkey % 7 = 0").selectExpr("c_custkey % 97 p", "o_orderkey % 211 + 1000 c")
    two = o.where("o_orderkey % 11 = 0").selectExpr("o_orderkey % 211 + 1000 p", "o_custkey % 389 + 5000 c")
    return one.unionAll(two).unionAll(o.where("o_orderkey % 13 = 0").selectExpr("o_custkey % 389 + 5000 p", "o_custkey % 97 c")).distinct()


@query(f"""WITH RECURSIVE {CRAWL}, r(root, id, depth) USING KEY (root, id) AS (SELECT x, x, 0 FROM (SELECT unnest([1::BIGINT, 2, 3]) x) UNION
    SELECT r.root, t.c, min(r.depth) + 1 FROM r JOIN t ON t.p = r.id WHERE r.depth < 3 AND NOT EXISTS (SELECT 1 FROM recurring.r x WHERE x.root = r.root AND x.id = t.c) GROUP BY 1, 2),
    f AS (SELECT a.root, a.id, a.depth, min(b.id) first FROM r a JOIN r b ON a.root = b.root AND b.depth = a.depth - 1 JOIN t ON t.p = b.id AND t.c = a.id GROUP BY 1, 2, 3)
    SELECT root, id node, depth::INT depth, first parent FROM f""")
def crawl_bfs(spark, sf):
    """Nodes that breadth-first walks from three roots reach within depth 3, each at its first depth with the least node that leads there."""
    return gr.crawl(crawl_tree(spark, sf), [1, 2, 3], 3)


@query(f"""WITH RECURSIVE {CRAWL}, up AS (SELECT c, min(p) p FROM t WHERE p < c GROUP BY c), r(id, top, steps) AS (SELECT c, p, 1 FROM up UNION ALL SELECT r.id, up.p, steps + 1 FROM r JOIN up ON up.c = r.top)
    SELECT id, min(top) root, max(steps)::INT steps FROM r GROUP BY id""")
def tree_roots(spark, sf):
    """The root and depth of each node when every node keeps its least smaller parent: parents are followed by doubling."""
    t = crawl_tree(spark, sf)
    return gr.roots(t.where("p < c").groupBy("c").agg(F.min("p").alias("p")))
