"""Registered queries of graphs, communities and vectors that reports are made of: components, seeds, egos, tables over layers, bands and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .corpus_queries import DEPTHS, _layer_sql, _layers, _steps
from .operators import community as co
from .operators import graph as gr
from .operators import knn as kn
from .operators import order as od
from .plans import graphs as plan
from .queries import DOM, E_U, EPS, KEEP, NN, NN3, PAR, REACH, R, cands, dom, kept_paragraphs, nn, picked, query, read, seeded, vectors, verts


def r6(x):
    return F.round(x, 6)


# ---- graphs
COMP = f"{NN3}, {REACH}, r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT bw.dst, r.root FROM r JOIN bw ON bw.src = r.id), c AS (SELECT id, min(root) component FROM r GROUP BY id)"
RANKED = f"{COMP}, z AS (SELECT component, count(*) size, row_number() OVER (ORDER BY count(*) DESC, component) - 1 rank FROM c GROUP BY component)"


def ranked_components(spark, sf, edges=None):
    c = gr.checkpointed(gr.components(gr.union(nn(spark, sf, k=2)) if edges is None else edges, verts(spark, sf)))
    return c, od.numbered(c.groupBy("component").agg((-F.count("*")).alias("minus")), ["minus", "component"], "rank")


@query(f"WITH RECURSIVE {RANKED} SELECT id, rank, size FROM c JOIN z USING (component)")
def component_rank(spark, sf):
    """Components numbered from 0 by falling size, then by least vertex."""
    c, z = ranked_components(spark, sf)
    return c.join(z, "component").select("id", "rank", (-F.col("minus")).alias("size"))


def largest(spark, sf):
    """(vertices, edges) of the largest component of the two-neighbour graph."""
    e = gr.checkpointed(gr.union(nn(spark, sf, k=2)))
    c, z = ranked_components(spark, sf, e)
    ids = gr.checkpointed(c.join(z.where("rank = 0"), "component").select("id"))
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return ids, gr.checkpointed(e.select("src", "dst"))


LCC = f"""{RANKED}, v AS (SELECT id FROM c JOIN z USING (component) WHERE rank = 0), a AS (SELECT src, dst FROM bw WHERE src IN (SELECT id FROM v)),
    b(root, id, d) USING KEY (root, id) AS (SELECT id, id, 0 FROM v UNION SELECT b.root, a.dst, min(b.d) + 1 FROM b JOIN a ON a.src = b.id
    WHERE NOT EXISTS (SELECT 1 FROM recurring.b x WHERE x.root = b.root AND x.id = a.dst) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {LCC} SELECT d::BIGINT d, count(*) // 2 pairs FROM b WHERE d > 0 GROUP BY d")
def lcc_distances(spark, sf):
    """Unordered pairs of the largest component at each distance."""
    ids, e = largest(spark, sf)
    return gr.distances(gr.both_ways(e), ids).select("d", (F.col("pairs") / 2).cast("long").alias("pairs"))


@query(f"WITH RECURSIVE {LCC} SELECT count(DISTINCT root) vertices, max(d)::BIGINT diameter, round(avg(d) FILTER (d > 0), 6) mean FROM b")
def lcc_summary(spark, sf):
    ids, e = largest(spark, sf)
    h = gr.distances(gr.both_ways(e), ids)
    return h.agg(F.max("d").alias("diameter"), r6(F.sum(F.col("d") * F.col("pairs")) / F.sum("pairs")).alias("mean")).crossJoin(ids.agg(F.count("*").alias("vertices"))).select("vertices", "diameter", "mean")


@query()
def double_sweep(spark, sf):
    """A lower bound of the largest component's diameter: from the least vertex to a farthest one and on from there, while the distance grows, ten times at most."""
    ids, e = largest(spark, sf)
    return gr.double_sweep(gr.both_ways(e), ids.agg(F.min("id")).first()[0])


SEEDS = ", ".join(R(i) for i in range(3))


@query(f"""WITH {SEEDS}, m AS ({' UNION ALL '.join(f"SELECT {i} seed, count(*) arcs, count(DISTINCT (least(src, dst), greatest(src, dst))) edges FROM r{i}" for i in range(3))}),
    u AS (SELECT 'mean_degree' measure, 2.0::DOUBLE * edges / (SELECT count(*) FROM embeddings) v FROM m UNION ALL SELECT 'mutual_share', (arcs - edges) / edges::DOUBLE FROM m)
    SELECT measure, round(avg(v), 6) mean, round(stddev_samp(v), 6) sd FROM u GROUP BY measure""")
def seed_means(spark, sf):
    """Mean and standard deviation over seeds of the tie draw of two measures of the union graph, as rows of a long table."""
    n = verts(spark, sf).count()
    a = seeded(spark, sf, 3).groupBy("pick", F.least("src", "dst"), F.greatest("src", "dst")).agg(F.count("*").alias("n"))
    e = a.groupBy("pick").agg(F.sum("n").alias("arcs"), F.count("*").alias("edges"))
    out = e.select((2.0 * F.col("edges") / n).alias("mean_degree"), ((F.col("arcs") - F.col("edges")) / F.col("edges")).alias("mutual_share"))
    return out.unpivot([], ["mean_degree", "mutual_share"], "measure", "v").groupBy("measure").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("sd"))


@query(f"""WITH {R(0)}, {R(1)}, {R(2)}, u AS ({' UNION ALL '.join(f'SELECT src, dst FROM r{i}' for i in range(3))}), n AS (SELECT src, dst, count(*) n FROM u GROUP BY 1, 2)
    SELECT src id, count(*) FILTER (n = 3) always, count(*) FILTER (n < 3) sometimes FROM n GROUP BY src""")
def seed_sets(spark, sf):
    """Neighbours of each row that every seed draws, and that only some do."""
    n = seeded(spark, sf, 3).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("n") == 3).alias("always"), F.count_if(F.col("n") < 3).alias("sometimes"))


@query(f"""WITH {NN('n1', k=5)}, {NN('n2', k=5, rep='L02')}, f AS (SELECT vec_id id FROM embeddings WHERE vec_id IN (3, 50, 77)), v AS (SELECT id FROM f UNION SELECT dst FROM n1 WHERE src IN (FROM f) UNION SELECT dst FROM n2 WHERE src IN (FROM f))
    SELECT 'L01' rep, src, dst FROM n1 WHERE src IN (FROM v) AND dst IN (FROM v) UNION ALL SELECT 'L02', src, dst FROM n2 WHERE src IN (FROM v) AND dst IN (FROM v)""")
def ego_graph(spark, sf):
    """Arcs of both representations among three vertices and their neighbours in either."""
    n = gr.checkpointed(nn(spark, sf, k=5).select(F.lit("L01").alias("rep"), "src", "dst").unionAll(nn(spark, sf, k=5, rep="L02").select(F.lit("L02"), "src", "dst")))
    focal = spark.createDataFrame([(3,), (50,), (77,)], "id long")
    v = focal.unionAll(n.join(focal.withColumnRenamed("id", "src"), "src", "left_semi").select("dst")).distinct()
    return n.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").select("rep", "src", "dst")


@query("""WITH a AS (SELECT o_custkey % 50 u, l_suppkey % 40 v, min(o_orderdate) = max(o_orderdate) once, bool_or(l_linenumber = 1) first, count(*) n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
    p AS (SELECT v, count(DISTINCT u) predecessors FROM a GROUP BY v) SELECT u, v, first, n, predecessors FROM a JOIN p USING (v)""")
def crawl_arcs(spark, sf):
    """Arcs of a walk once each, `first` where any visit was the first, with the number of predecessors of their end."""
    j = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = j.groupBy((F.col("o_custkey") % 50).alias("u"), (F.col("l_suppkey") % 40).alias("v")).agg(F.bool_or(F.col("l_linenumber") == 1).alias("first"), F.count("*").alias("n"))
    return a.join(a.groupBy("v").agg(F.count("u").alias("predecessors")), "v").select("u", "v", "first", "n", "predecessors")


CORE = "ce AS (SELECT src, dst FROM e WHERE src IN (SELECT vec_id FROM embeddings WHERE label < 5) AND dst IN (SELECT vec_id FROM embeddings WHERE label < 5))"


@query(f"""WITH {NN()}, {E_U}, {CORE}, b AS (SELECT src, dst FROM ce UNION ALL SELECT dst, src FROM ce), g AS (SELECT vec_id id, count(src) degree FROM embeddings LEFT JOIN b ON src = vec_id WHERE label < 5 GROUP BY vec_id),
    t AS (SELECT count(*) n FROM ce x JOIN ce y ON x.dst = y.src JOIN ce z ON z.src = x.src AND z.dst = y.dst)
    SELECT count(*) vertices, (sum(degree) // 2)::BIGINT edges, round(avg(degree), 6) mean_degree, round(sum(degree)::DOUBLE / (count(*) * (count(*) - 1)), 6) density, round(3.0::DOUBLE * any_value(t.n) / sum(degree * (degree - 1) / 2)::DOUBLE, 6) transitivity FROM g, t""")
def core_metrics(spark, sf):
    """Metrics of the union graph induced on the first five types."""
    v = verts(spark, sf).where("label < 5").select("id")
    e = gr.union(nn(spark, sf)).join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")
    c = gr.clustering(gr.checkpointed(e.select("src", "dst")), v)
    n, d = F.count("*"), F.sum("degree")
    return c.agg(n.alias("vertices"), (d / 2).cast("long").alias("edges"), r6(F.avg("degree")).alias("mean_degree"), r6(d / (n * (n - 1))).alias("density"), r6(F.sum("triangles") / F.sum(F.col("degree") * (F.col("degree") - 1) / 2)).alias("transitivity"))


@query(f"WITH {NN()} SELECT round(avg((p.label = q.label)::INT), 6) same_label, round(avg((src % 2 <> dst % 2)::INT), 6) other_position, count(*) arcs FROM nn JOIN embeddings p ON p.vec_id = src JOIN embeddings q ON q.vec_id = dst")
def arc_composition(spark, sf):
    v = verts(spark, sf)
    n = nn(spark, sf).join(v.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(v.withColumnsRenamed({"id": "dst", "label": "b"}), "dst")
    return n.agg(r6(F.avg((F.col("a") == F.col("b")).cast("int"))).alias("same_label"), r6(F.avg((F.col("src") % 2 != F.col("dst") % 2).cast("int"))).alias("other_position"), F.count("*").alias("arcs"))


@query(f"WITH {NN()}, {E_U}, m AS (SELECT count(*)::DOUBLE m FROM e), n AS (SELECT count(*)::DOUBLE n FROM embeddings) SELECT n::BIGINT vertices, m::BIGINT edges, round(2 * m / (n * (n - 1)), 9) density FROM m, n")
def graph_density(spark, sf):
    n, m = F.col("vertices"), F.col("edges")
    x = verts(spark, sf).agg(F.count("*").alias("vertices")).crossJoin(gr.union(nn(spark, sf)).agg(F.count("*").alias("edges")))  # a row each
    return x.select("vertices", "edges", F.round(2 * m / (n * (n - 1)), 9).alias("density"))


# ---- communities and classes
@query("""WITH s AS (SELECT source, count(*) n FROM documents GROUP BY 1), f AS (SELECT source, CASE WHEN row_number() OVER (ORDER BY n DESC, source) <= 5 THEN source ELSE 'other' END class FROM s)
    SELECT class, lang, count(*) n FROM documents JOIN f USING (source) GROUP BY 1, 2""")
def folded_classes(spark, sf):
    """The five most frequent sources, all others as one, by language."""
    d = read(spark, sf, "documents")
    keep = d.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5).select(F.col("source").alias("class"))
    return d.join(keep, d["source"] == keep["class"], "left").groupBy(F.coalesce("class", F.lit("other")).alias("class"), "lang").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) FILTER (lang = 'en') en, count(*) FILTER (lang = 'fr') fr, count(*) FILTER (lang = 'de') de, count(*) FILTER (lang = 'es') es, count(*) total FROM documents GROUP BY ROLLUP (source)")
def class_crosstab(spark, sf):
    """Sources by language with a row of totals."""
    langs = ["en", "fr", "de", "es"]
    n = read(spark, sf, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    cells = n.where("level in (0, 1)").groupBy("source")
    total = read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    one = lambda g: g.agg(*(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("long").alias(x) for x in langs))
    per = one(n.where("level = 0").groupBy("source")).join(cells.agg(F.sum(F.when(F.col("level") == 1, F.col("n"))).alias("total")), "source")
    return per.unionByName(one(total.groupBy()).crossJoin(total.agg(F.sum("n").alias("total"))).withColumn("source", F.lit(None).cast("string")))


@query("SELECT lang, count(*) FILTER (source = 'src0') src0, count(*) FILTER (source = 'src1') src1, count(*) FILTER (source = 'src2') src2 FROM documents GROUP BY lang")
def class_pivot(spark, sf):
    """Languages by three sources, by the pivot operator."""
    names = ["src0", "src1", "src2"]
    return read(spark, sf, "documents").groupBy("lang").pivot("source", names).agg(F.count(F.lit(1))).select("lang", *(F.coalesce(F.col(x), F.lit(0)).alias(x) for x in names))


@query("SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def class_intersection(spark, sf):
    d = read(spark, sf, "documents")
    return d.where("lang = 'en'").select("source").intersect(d.where("lang = 'fr'").select("source"))


PERMUTED = 20
NMI_SQL = """n AS (SELECT p, sum(n)::DOUBLE t FROM c GROUP BY p), a AS (SELECT p, sum(s * ln(s)) l FROM (SELECT p, a, sum(n)::DOUBLE s FROM c GROUP BY 1, 2) GROUP BY p), b AS (SELECT p, sum(s * ln(s)) l FROM (SELECT p, b, sum(n)::DOUBLE s FROM c GROUP BY 1, 2) GROUP BY p),
    ab AS (SELECT p, sum(n * ln(n::DOUBLE)) l FROM c GROUP BY p), h AS (SELECT p, ln(t) - a.l / t ha, ln(t) - b.l / t hb, ln(t) - ab.l / t hab FROM n JOIN a USING (p) JOIN b USING (p) JOIN ab USING (p)), nmi AS (SELECT p, 2 * (ha + hb - hab) / (ha + hb) nmi FROM h)"""


@query(f"""WITH x AS (SELECT lang, row_number() OVER (ORDER BY doc_id) i FROM documents), y AS (SELECT p, source, row_number() OVER (PARTITION BY p ORDER BY md5(concat_ws('|', '7', p, doc_id)), doc_id) i FROM documents, range({PERMUTED}) t(p)),
    c AS (SELECT p, lang a, source b, count(*) n FROM x JOIN y USING (i) GROUP BY 1, 2, 3), {NMI_SQL} SELECT round(avg(nmi), 6) baseline, count(*) permutations FROM nmi""")
def nmi_baseline(spark, sf):
    """Mean agreement after twenty permutations of the labels: all of them are numbered in one global order."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "source")
    n = d.count()
    x = od.numbered(d.select("doc_id", "lang"), ["doc_id"], "i").select("lang", "i")
    y = d.select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.lit(PERMUTED - 1))).alias("p"))
    y = od.numbered(y.withColumn("h", F.md5(F.concat_ws("|", F.lit("7"), "p", "doc_id"))), ["p", "h", "doc_id"], "at").select("p", "source", (F.col("at") - F.col("p") * n).alias("i"))
    return co.grouped_nmi(x.join(y, "i").select("p", F.col("lang").alias("a"), F.col("source").alias("b")), ["p"]).agg(r6(F.avg("nmi")).alias("baseline"), F.count("*").alias("permutations"))


@query(f"""WITH l AS (SELECT ntile(8) OVER (ORDER BY md5(concat_ws('|', '7', doc_id)), doc_id) p, lang a, source b FROM documents), c AS (SELECT p, a, b, count(*) n FROM l GROUP BY 1, 2, 3), {NMI_SQL} SELECT p::BIGINT part, round(nmi, 6) nmi FROM nmi""")
def nmi_by_part(spark, sf):
    """Agreement of language and source in each eighth of the documents."""
    d = read(spark, sf, "documents").withColumn("h", F.md5(F.concat_ws("|", F.lit("7"), "doc_id")))
    n = d.count()
    at = od.numbered(d.select("h", "doc_id", "lang", "source"), ["h", "doc_id"], "i")
    big, size = n % 8, n // 8  # the first n % 8 parts have one row more
    part = F.when(F.col("i") < big * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(F.floor((F.col("i") - big) / max(size, 1))) + 1
    return co.grouped_nmi(at.select(part.alias("part"), F.col("lang").alias("a"), F.col("source").alias("b")), ["part"]).select("part", r6("nmi").alias("nmi"))


@query("""WITH f AS (SELECT label, count(*) n FROM embeddings GROUP BY 1), m AS (SELECT label, avg((vec_id % 3 = 0)::INT) share FROM embeddings GROUP BY 1)
    SELECT label, CASE WHEN label IN (1, 4) THEN 'target' WHEN label = 7 THEN 'control' WHEN n >= 52 THEN 'frequent' WHEN share > 0.34 THEN 'function' ELSE 'rest' END kind FROM f JOIN m USING (label)""")
def type_groups(spark, sf):
    """The first group that claims a type: targets, the control, frequent types, those with many occurrences of a class."""
    v = verts(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("id") % 3 == 0).cast("int")).alias("share"))
    given = spark.createDataFrame([(1, "target"), (4, "target"), (7, "control")], "label int, given string")
    rest = F.when(F.col("n") >= 52, "frequent").when(F.col("share") > 0.34, "function").otherwise("rest")
    return v.join(F.broadcast(given), "label", "left").select("label", F.coalesce("given", rest).alias("kind"))


@query(f"""WITH v AS (SELECT vec_id id, label, embedding::DOUBLE[] v FROM embeddings), p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) s, a.id % 2 = b.id % 2 AS same FROM v a JOIN v b ON a.label = b.label AND a.id < b.id),
    t AS (SELECT label, avg(s) self, avg(s) FILTER (same) w, avg(s) FILTER (NOT same) b FROM p GROUP BY label) SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END band, count(*) types, round(avg(self), 6) self_mean, round(median(self), 6) self_median, round(avg(w - b), 6) gap_mean FROM t GROUP BY 1""")
def similarity_bands(spark, sf):
    """Self-similarity of types and the gap between similarity within and between halves, by bands of types, from sums of unit vectors instead of pairs."""
    u = vectors(spark, sf).select("type", (F.col("id") % 2).alias("h"), F.posexplode(kn.unit(F.col("vec"))).alias("dim", "x"))
    side = lambda h: F.sum(F.when(F.col("h") == h, F.col("x")).otherwise(0.0))
    s = u.groupBy("type", "dim").agg(side(0).alias("s0"), side(1).alias("s1")).groupBy("type").agg(F.sum(F.col("s0") ** 2).alias("q0"), F.sum(F.col("s1") ** 2).alias("q1"), F.sum(F.col("s0") * F.col("s1")).alias("q"))
    n = verts(spark, sf).groupBy(F.col("label").alias("type")).agg(F.count_if(F.col("id") % 2 == 0).alias("n0"), F.count_if(F.col("id") % 2 == 1).alias("n1"))
    n0, n1, none = F.col("n0"), F.col("n1"), F.lit(0.0)
    inner, pairs = (F.col("q0") - n0 + F.col("q1") - n1) / 2, (n0 * (n0 - 1) + n1 * (n1 - 1)) / 2
    t = s.join(n, "type").select("type", ((inner + F.col("q")) / F.nullif(pairs + n0 * n1, none)).alias("self"), (inner / F.nullif(pairs, none) - F.col("q") / F.nullif((n0 * n1).cast("double"), none)).alias("gap"))
    return t.groupBy(F.when(F.col("type") < 5, "low").otherwise("high").alias("band")).agg(F.count("*").alias("types"), r6(F.avg("self")).alias("self_mean"), r6(F.median("self")).alias("self_median"), r6(F.avg("gap")).alias("gap_mean"))


# ---- layers and vectors
NORMS = " UNION ALL ".join(f"SELECT {d} depth, vec_id, embedding[1:{d}]::DOUBLE[] v FROM embeddings" for d in DEPTHS)


@query(f"""WITH x AS ({NORMS}), s AS (SELECT depth, sqrt(list_dot_product(v, v)) n FROM x), c AS (SELECT a.depth, avg(list_cosine_similarity(a.v, b.v)) cos FROM x a JOIN x b ON a.depth = b.depth AND a.vec_id < b.vec_id GROUP BY 1)
    SELECT depth, round(avg(n), 6) mean_norm, round(median(n), 6) median_norm, round(any_value(cos), 6) mean_cos FROM s JOIN c USING (depth) GROUP BY depth""")
def layer_curve(spark, sf):
    """Norms and mean cosine over all pairs at each depth."""
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.array(*map(F.lit, DEPTHS))).alias("depth"))
    e = gr.checkpointed(e.select("depth", F.slice("e", F.lit(1), F.col("depth")).alias("v")))
    norms = e.select("depth", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("n")).groupBy("depth").agg(r6(F.avg("n")).alias("mean_norm"), r6(F.median("n")).alias("median_norm"))
    s = e.select("depth", F.posexplode(kn.unit(F.col("v"))).alias("dim", "x")).groupBy("depth", "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    cos = s.groupBy("depth").agg(r6((F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n") * (F.max("n") - 1))).alias("mean_cos"))
    return norms.join(cos, "depth")


@query("""WITH n AS (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) x FROM embeddings), q AS (SELECT unnest([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])::DOUBLE q)
    SELECT q, round(quantile_cont(x, 0.0), 6) x FROM n, q WHERE q = 0 GROUP BY q UNION ALL SELECT 0.05, round(quantile_cont(x, 0.05), 6) FROM n UNION ALL SELECT 0.25, round(quantile_cont(x, 0.25), 6) FROM n UNION ALL SELECT 0.5, round(quantile_cont(x, 0.5), 6) FROM n
    UNION ALL SELECT 0.75, round(quantile_cont(x, 0.75), 6) FROM n UNION ALL SELECT 0.95, round(quantile_cont(x, 0.95), 6) FROM n UNION ALL SELECT 1.0, round(quantile_cont(x, 1.0), 6) FROM n""")
def norm_quantiles(spark, sf):
    qs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    x = vectors(spark, sf).select(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)).alias("x")).agg(F.percentile("x", qs).alias("p"))
    return x.select(F.posexplode("p").alias("i", "x")).select(F.array(*map(F.lit, qs))[F.col("i")].alias("q"), r6("x").alias("x"))


@query("""WITH x AS (SELECT generate_subscripts(embedding, 1) - 1 d, unnest(embedding::DOUBLE[]) v FROM embeddings), m AS (SELECT d, avg(abs(v)) m, sum(v * v) s FROM x GROUP BY d), t AS (SELECT median(m) md, sum(s) al FROM m)
    SELECT d::INT dim, round(m / md, 6) to_median, round(s / al, 6) share, m > 1.2::DOUBLE * md outlier FROM m, t""")
def dim_outliers(spark, sf):
    """Each dimension's mean size against the median dimension, its share of the squared norm, and whether it stands out."""
    m = vectors(spark, sf).select(F.posexplode("vec").alias("dim", "v")).groupBy("dim").agg(F.avg(F.abs("v")).alias("m"), F.sum(F.col("v") * F.col("v")).alias("s"))
    t = m.agg(F.median("m").alias("md"), F.sum("s").alias("al"))
    return m.crossJoin(F.broadcast(t)).select("dim", r6(F.col("m") / F.col("md")).alias("to_median"), r6(F.col("s") / F.col("al")).alias("share"), (F.col("m") > 1.2 * F.col("md")).alias("outlier"))


@query("""WITH g AS (SELECT vec_id, vec_id // 4 grp, embedding::DOUBLE[] v FROM embeddings), l AS (SELECT grp, min(vec_id) lead FROM g GROUP BY grp)
    SELECT g.vec_id, lead, round(list_max(list_transform(list_zip(g.v, h.v), lambda p: abs(p[1] - p[2]))), 6) moved FROM g JOIN l USING (grp) JOIN g h ON h.vec_id = lead""")
def leader_copy(spark, sf):
    """The vector of each group's first member in place of all, and how far each moves."""
    g = vectors(spark, sf).select("id", F.floor(F.col("id") / 4).alias("grp"), "vec")
    lead = g.groupBy("grp").agg(F.min_by(F.struct("id", "vec"), "id").alias("l"))
    moved = F.array_max(F.zip_with("vec", "l.vec", lambda a, b: F.abs(a - b)))
    return g.join(lead, "grp").select(F.col("id").alias("vec_id"), F.col("l.id").alias("lead"), r6(moved).alias("moved"))


@query("""SELECT conv_id, count(*) vertices, string_agg(role, ',' ORDER BY turn) roles, max(turn) - min(turn) + 1 = count(DISTINCT turn) gapless FROM conversations GROUP BY conv_id""")
def sequence_tasks(spark, sf):
    """One task a conversation: its turns in order, and whether they have no gap."""
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("vertices"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("all"), (F.max("turn") - F.min("turn") + 1 == F.count_distinct("turn")).alias("gapless"))
    return c.select("conv_id", "vertices", F.array_join(F.transform("all", lambda s: s["role"]), ",").alias("roles"), "gapless")


@query(f"WITH {_layer_sql()} SELECT depth, label % 3 band, round(avg(j), 6) mean, round(quantile_cont(j, 0.25::DOUBLE), 6) q25, round(median(j), 6) median, round(quantile_cont(j, 0.75::DOUBLE), 6) q75 FROM jj JOIN embeddings ON vec_id = src GROUP BY 1, 2")
def jaccard_bands(spark, sf):
    """Quartiles of the change from layer to layer, by bands of types."""
    j = _steps(_layers(spark, sf)).join(verts(spark, sf).select(F.col("id").alias("src"), (F.col("label") % 3).alias("band")), "src")
    return j.groupBy("depth", "band").agg(r6(F.avg("j")).alias("mean"), r6(F.percentile("j", 0.25)).alias("q25"), r6(F.median("j")).alias("median"), r6(F.percentile("j", 0.75)).alias("q75"))


@query(f"{DOM}, s AS (SELECT label, avg(d) d, avg(d / nullif(ceiling, 0)) dn, count(*) n FROM dom GROUP BY label) SELECT CASE WHEN n < 48 THEN 'rare' WHEN n < 53 THEN 'middle' ELSE 'frequent' END band, count(*) types, round(avg(d), 6) d, round(avg(dn), 6) dn FROM s GROUP BY 1")
def dominance_bands(spark, sf):
    s = dom(spark, sf).groupBy("label").agg(F.avg("d").alias("d"), F.avg(F.col("d") / F.nullif("ceiling", F.lit(0.0))).alias("dn"), F.count("*").alias("n"))
    band = F.when(F.col("n") < 48, "rare").when(F.col("n") < 53, "middle").otherwise("frequent")
    return s.groupBy(band.alias("band")).agg(F.count("*").alias("types"), r6(F.avg("d")).alias("d"), r6(F.avg("dn")).alias("dn"))


TIES = {"position": NN("tp", eps="0.05"), "all": NN("ta", eps="0.05", tie="all"), "random": NN("tr", eps="0.05", order="md5(concat_ws('|', '7|L01|10|0', src, dst)), dst")}


@query(f"""WITH {', '.join(TIES.values())}, u AS (SELECT 'position' tie, src, dst FROM tp UNION ALL SELECT 'all', src, dst FROM ta UNION ALL SELECT 'random', src, dst FROM tr)
    SELECT tie, p.label % 2 band, round(avg((p.label = q.label)::INT), 6) d, round(count(*) / count(DISTINCT src)::DOUBLE, 6) size FROM u JOIN embeddings p ON p.vec_id = src JOIN embeddings q ON q.vec_id = dst GROUP BY 1, 2""")
def tie_variants(spark, sf):
    """Dominance and mean size of neighbour sets by tie rule and band."""
    ties = ("position", "all", "random")
    out = picked(spark, sf, [kn.Pick(10, t, 0.05, "7|L01|10|0") for t in ties]).select(F.array(*map(F.lit, ties))[F.col("pick")].alias("tie"), "src", "dst")
    v = verts(spark, sf)
    j = out.join(v.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(v.withColumnsRenamed({"id": "dst", "label": "b"}), "dst")
    return j.groupBy("tie", (F.col("a") % 2).alias("band")).agg(r6(F.avg((F.col("a") == F.col("b")).cast("int"))).alias("d"), r6(F.count("*") / F.count_distinct("src")).alias("size"))


# ---- tables of reports
@query(f"""WITH {PAR}, k AS (SELECT lang, doc_id, len(string_split(x, ' ')) n FROM p WHERE {KEEP}) SELECT lang, count(DISTINCT doc_id) articles, count(*) paragraphs, sum(n)::BIGINT words FROM k GROUP BY ROLLUP (lang)""")
def paragraph_stats(spark, sf):
    """Articles, paragraphs and words by language, with a row of totals."""
    k = kept_paragraphs(spark, sf).select("lang", "doc_id", F.size(F.split("x", " ")).alias("n"))
    return k.rollup("lang").agg(F.count_distinct("doc_id").alias("articles"), F.count("*").alias("paragraphs"), F.sum("n").alias("words"))


@query(f"""WITH {PAR}, k AS (SELECT length(x) n FROM p WHERE {KEEP}), t AS (SELECT quantile_cont(n, 0.995::DOUBLE) top, min(n) lo FROM k), b AS (SELECT least(floor((least(n, top) - lo) / ((top - lo) / 40)), 39)::INT bin FROM k, t) SELECT bin, count(*) n FROM b GROUP BY bin""")
def length_histogram(spark, sf):
    """Lengths of paragraphs in forty bins up to the 99.5 % quantile, longer ones in the last."""
    k = kept_paragraphs(spark, sf).select(F.length("x").alias("n"))
    t = k.agg(F.percentile("n", 0.995).alias("top"), F.min("n").alias("lo"))
    bin_ = F.least(F.floor((F.least(F.col("n"), F.col("top")) - F.col("lo")) / ((F.col("top") - F.col("lo")) / 40)), F.lit(39))
    return k.crossJoin(F.broadcast(t)).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {PAR}, k AS (SELECT doc_id, count(*) paragraphs, sum(len(string_split(x, ' ')))::BIGINT words FROM p WHERE {KEEP} GROUP BY 1) SELECT doc_id, coalesce(paragraphs, 0) paragraphs, coalesce(words, 0) words, paragraphs IS NULL AS unused FROM documents LEFT JOIN k USING (doc_id)""")
def article_rows(spark, sf):
    """Paragraphs and words of each document, and whether none of its text is used."""
    k = kept_paragraphs(spark, sf).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.size(F.split("x", " "))).alias("words"))
    return read(spark, sf, "documents").select("doc_id").join(k, "doc_id", "left").select("doc_id", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), F.coalesce("words", F.lit(0)).alias("words"), F.col("paragraphs").isNull().alias("unused"))


@query("WITH f AS (SELECT source, min(doc_id) f FROM documents GROUP BY source), c AS (SELECT source, row_number() OVER (ORDER BY f) - 1 code FROM f) SELECT doc_id, code FROM documents JOIN c USING (source)")
def compact_codes(spark, sf):
    """Codes of sources in the order in which they are first seen."""
    d = read(spark, sf, "documents")
    c = od.numbered(d.groupBy("source").agg(F.min("doc_id").alias("f")), ["f"], "code")
    return d.join(c, "source").select("doc_id", "code")


@query("SELECT source, count(*) n, row_number() OVER (ORDER BY CASE source WHEN 'src3' THEN 0 WHEN 'src0' THEN 1 ELSE 1000000000 END, source) - 1 place FROM documents GROUP BY source")
def given_order(spark, sf):
    """Sources in a given order, those not in it after it by name."""
    known = F.create_map(F.lit("src3"), F.lit(0), F.lit("src0"), F.lit(1))
    s = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("o", F.coalesce(known[F.col("source")], F.lit(1000000000)))
    return od.numbered(s, ["o", "source"], "place").select("source", "n", "place")


@query(f"""WITH {', '.join(NN(f'k{k}', k=k) for k in (5, 10, 20))}, m AS ({' UNION ALL '.join(f"SELECT 'k{k}' k, avg((p.label = q.label)::INT) d, count(*) / count(DISTINCT src)::DOUBLE size FROM k{k} JOIN embeddings p ON p.vec_id = src JOIN embeddings q ON q.vec_id = dst" for k in (5, 10, 20))}),
    u AS (SELECT k, 'd' measure, d v FROM m UNION ALL SELECT k, 'size', size FROM m) SELECT measure, round(max(v) FILTER (k = 'k5'), 6) k5, round(max(v) FILTER (k = 'k10'), 6) k10, round(max(v) FILTER (k = 'k20'), 6) k20 FROM u GROUP BY measure""")
def metric_matrix(spark, sf):
    """Measures as rows, neighbour counts as columns: unpivot, then pivot."""
    ks, v = ("k5", "k10", "k20"), verts(spark, sf)
    n = picked(spark, sf, [kn.Pick(int(k[1:])) for k in ks]).select(F.array(*map(F.lit, ks))[F.col("pick")].alias("k"), "src", "dst")
    j = n.join(v.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(v.withColumnsRenamed({"id": "dst", "label": "b"}), "dst")
    out = j.groupBy("k").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("d"), (F.count("*") / F.count_distinct("src")).alias("size"))
    return out.unpivot(["k"], ["d", "size"], "measure", "v").groupBy("measure").pivot("k", ["k5", "k10", "k20"]).agg(r6(F.max("v")))


VARIANTS = [("L01", 5), ("L01", 10), ("L02", 10)]


@query("WITH " + ", ".join(NN(f"g{i}", k=k, rep=r) for i, (r, k) in enumerate(VARIANTS)) + ", " + ", ".join(f"s{i} AS (SELECT count(*) edges, sum(('0x' || substr(md5(concat_ws('|', a, b)), 1, 15))::BIGINT) h FROM (SELECT DISTINCT least(src, dst) a, greatest(src, dst) b FROM g{i}))" for i in range(3))
       + ", u AS (" + " UNION ALL ".join(f"SELECT '{r}|{k}|{t}' graph, edges, h, {10 * i + j} o FROM s{i}" for i, (r, k) in enumerate(VARIANTS) for j, t in enumerate(("position", "first"))) + ") SELECT graph, edges, first_value(graph) OVER (PARTITION BY edges, h ORDER BY o) canonical FROM u")
def plan_duplicates(spark, sf):
    """Planned graphs and for each the first with the same edge set, which is the one to measure."""
    specs = plan.graph_specs([("L01", [5, 10]), ("L02", [10])], ["union"], ["position", "first"])
    edges = {}
    for rep in dict.fromkeys(s.rep for s in specs):
        ks = sorted({s.k for s in specs if s.rep == rep})
        n = gr.checkpointed(picked(spark, sf, [kn.Pick(k) for k in ks], rep).select("pick", "src", "dst"))
        edges |= {(rep, k): gr.union(n.where(F.col("pick") == i)) for i, k in enumerate(ks)}
    return plan.canonical(specs, edges)


@query(f"WITH RECURSIVE {NN()}, {E_U}, deg AS (SELECT degree FROM dg), b AS (SELECT least(floor(degree / 2), 39)::INT bin FROM deg) SELECT bin, count(*) n FROM b GROUP BY bin")
def degree_bins(spark, sf):
    d = gr.degrees(gr.union(nn(spark, sf)), verts(spark, sf))
    return d.groupBy(F.least(F.floor(F.col("degree") / 2), F.lit(39)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {NN(eps='1e-6')}, l AS (SELECT src, count(*) n, max(sim) top, min(sim) last FROM nn_b WHERE f OR b GROUP BY src) SELECT src id, n, round(top, 6) top, round(last, 6) last FROM l")
def candidate_lists(spark, sf):
    """Length and ends of each row's candidate list."""
    return picked(spark, sf, [kn.Pick(10, "all", EPS)]).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), r6(F.max("sim")).alias("top"), r6(F.min("sim")).alias("last"))


@query(f"WITH {', '.join(NN(f'm{k}', k=k) for k in (5, 10))}, u AS (SELECT 5 k, src, dst FROM m5 UNION ALL SELECT 10, src, dst FROM m10) SELECT k, 'position' tie, src, dst FROM u")
def neighbor_sets(spark, sf):
    """One table of neighbour sets for several k from one candidate list."""
    return plan.neighbor_sets(cands(spark, sf, k=10), [5, 10], ["position"]).select("k", "tie", "src", "dst")


@query("SELECT label::BIGINT own, x.dst, vec_id FROM embeddings JOIN (WITH t AS (SELECT label l, list(m ORDER BY d) v FROM (SELECT label, d, avg(x) m FROM (SELECT label, unnest(embedding::DOUBLE[]) x, generate_subscripts(embedding, 1) d FROM embeddings) GROUP BY 1, 2) GROUP BY 1), s AS (SELECT a.l src, b.l dst, list_cosine_similarity(a.v, b.v) sim FROM t a JOIN t b ON a.l <> b.l) SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) k FROM s) WHERE k <= 3) x ON x.src = label")
def lexical_types(spark, sf):
    """The three closest types of each row's type, found among types and copied to rows."""
    v = vectors(spark, sf)
    t = kn.select(kn.candidates(kn.type_vectors(v, "type").select(F.col("type").cast("long").alias("id"), "vec"), 3, 0.0), 3, 0.0)
    return v.select("id", F.col("type").cast("long").alias("src")).join(t, "src").select(F.col("src").alias("own"), F.col("dst").cast("int").alias("dst"), F.col("id").alias("vec_id"))


@query("SELECT d1.source, d1.doc_id FROM documents d1 WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d1.doc_id)")
def unlabelled(spark, sf):
    """Documents without a label: an anti join on the key."""
    return read(spark, sf, "documents").select("source", "doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("source", "doc_id")


@query(f"WITH {NN()}, w AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) rank FROM nn) SELECT src id, string_agg(dst::VARCHAR, ' ' ORDER BY rank) neighbours FROM w WHERE src IN (3, 50, 77) GROUP BY src")
def neighbour_panel(spark, sf):
    """The neighbours of three rows in order of similarity."""
    n = nn(spark, sf).where("src in (3, 50, 77)").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("m"), "dst"))).alias("all"))
    return n.select("id", F.array_join(F.transform("all", lambda s: s["dst"].cast("string")), " ").alias("neighbours"))


