"""Operators of the core package against hand-made cases, brute force and SQL."""

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import corpus_queries as more
from tessera import queries as core
from tessera.functions import text as tx
from tessera.operators import community as co
from tessera.operators import graph as gr
from tessera.operators import knn as kn
from tessera.operators import lens as ln
from tessera.operators import order as od
from tessera.plans import graphs as plan
from tessera.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def verts(spark, n):
    return spark.range(n)


def dyadic(n, seed):
    rng = np.random.default_rng(seed)
    out = np.zeros((n, 8))
    for i in range(n):
        k = rng.choice([1, 4])
        out[i, rng.choice(8, k, replace=False)] = rng.choice([-1.0, 1.0, 2.0, -2.0], 1)[0] * rng.choice([-1, 1], k)
    return out


def brute(x, k, eps, tie):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))
        sk = s[i, order[min(k, len(order)) - 1]]
        f = [j for j in order if s[i, j] > sk + eps]
        b = sorted(j for j in order if abs(s[i, j] - sk) <= eps)
        out |= {(i, j) for j in f + (b if tie == "all" else b[: k - len(f)])}
    return out


@pytest.mark.parametrize("block", [4096, 9])
@pytest.mark.parametrize("tie", ["position", "all"])
def test_knn_ties(spark, block, tie):
    x = dyadic(40, 3)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    got = kn.select(kn.candidates(v, 5, 1e-6, block), 5, 1e-6, tie).collect()
    assert {(r.src, r.dst) for r in got} == brute(x, 5, 1e-6, tie)


def test_random_ties(spark):
    x = dyadic(30, 4)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    c = gr.checkpointed(kn.candidates(v, 4))
    a, b, again = ({(r.src, r.dst) for r in kn.select(c, 4, 1e-6, "random", s).collect()} for s in ("1", "2", "1"))
    every = {(r.src, r.dst) for r in kn.select(c, 4, 1e-6, "all").collect()}
    assert a == again != b and a | b <= every
    assert all(sum(1 for s, _ in a if s == i) == 4 for i in range(30))


def test_zero_vector_is_an_error(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "id long, vec array<double>")
    with pytest.raises(Exception, match="zero or non-finite"):
        kn.candidates(v, 1).collect()


def test_hand_digraph(spark):
    arcs = edges(spark, [(0, 1), (0, 2), (1, 0), (1, 2), (2, 3), (2, 0), (3, 2), (3, 1)])
    assert gr.mutual(arcs).count() * 2 / 8 == 0.75
    hubs = {r.id: r.degree for r in gr.in_degrees(arcs, verts(spark, 4)).collect()}
    assert hubs == {0: 2, 1: 2, 2: 3, 3: 1}


def test_triangle_pendant_isolated(spark):
    c = {r.id: r for r in gr.clustering(edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3)]), verts(spark, 5)).collect()}
    local = [r.local for r in c.values() if r.local is not None]
    assert math.isclose(sum(local) / len(local), 7 / 9) and c[4].degree == 0 and c[3].local is None


def test_directed_clustering(spark):
    got = {r.id: r.local for r in gr.directed_clustering(edges(spark, [(0, 1), (1, 2), (2, 0), (3, 0), (0, 3), (4, 1)]), verts(spark, 5)).collect()}
    assert got[3] is None and got[4] is None and got[2] == 0.5


def test_components_and_strong_components(spark):
    rng = np.random.default_rng(1)
    arcs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (50, 2)) if a != b]
    reach = np.eye(40, dtype=bool)
    for a, b in arcs:
        reach[a, b] = True
    both = reach | reach.T
    for k in range(40):
        reach |= reach[:, [k]] & reach[[k], :]
        both |= both[:, [k]] & both[[k], :]
    assert {r.id: r.component for r in gr.components(edges(spark, arcs), verts(spark, 40)).collect()} == {i: int(np.flatnonzero(both[i])[0]) for i in range(40)}
    strong = reach & reach.T
    assert {r.id: r.component for r in gr.strong_components(edges(spark, arcs), verts(spark, 40)).collect()} == {i: int(np.flatnonzero(strong[i])[0]) for i in range(40)}


def test_distances(spark):
    arcs = edges(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 4)])
    assert {r.d: r.pairs for r in gr.distances(arcs, verts(spark, 5)).collect()} == {1: 5, 2: 5, 3: 5, 4: 1}
    assert gr.distances(arcs.limit(0), verts(spark, 5)).count() == 0
    ring = edges(spark, [(i, (i + 1) % 150) for i in range(150)])  # more sources than a bit set holds
    assert {r.d: r.pairs for r in gr.distances(gr.both_ways(ring), verts(spark, 150)).where("d > 73").collect()} == {74: 300, 75: 150}


def test_order(spark):
    rng = np.random.default_rng(3)
    keys = rng.permutation(500) * 37
    rows = spark.createDataFrame([(int(k), int(k) % 5) for k in keys], "k long, v long").repartition(7)
    want = sorted(int(k) for k in keys)
    assert [r.k for r in od.numbered(rows, ["k"]).orderBy("number").collect()] == want
    total = {r.k: r.t for r in od.running(rows, ["k"], od.F.col("v"), "t", 3).collect()}
    assert all(total[k] == sum(x % 5 for x in want[: i + 1]) for i, k in enumerate(want))
    after = {r.k: r.nxt for r in od.next_value(rows, "k", "v", "nxt", 1000).collect()}
    assert all(after[k] == (want[i + 1] % 5 if i + 1 < 500 else None) for i, k in enumerate(want))


def test_lens_blocks(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(60, 6)), rng.normal(size=(25, 6))
    w[7] = w[3]
    q = spark.createDataFrame([(i, i % 25, (i + 1) % 25 if i < 59 else None, r.tolist()) for i, r in enumerate(x)], "id long, own long, nxt long, vec array<double>")
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)], "label long, vec array<double>")
    cos = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (w / np.linalg.norm(w, axis=1, keepdims=True)).T, 12)
    for block in (4096, 11):
        for r in ln.ranked(q, d, 4, block).collect():
            assert r.own_rank == (cos[r.id] > cos[r.id, r.own]).sum() and r.argmax == (x[r.id] @ w.T).argmax()
            assert r.next_rank == (-1 if r.nxt is None else (cos[r.id] > cos[r.id, r.nxt]).sum())
            assert [t.label for t in r.top] == sorted(range(25), key=lambda j: (-cos[r.id, j], j))[:4]


def test_crawl_and_roots(spark):
    tree = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 6)], "p long, c long")
    assert {tuple(r) for r in gr.crawl(tree, [1], 3).collect()} == {(1, 2, 1, 1), (1, 3, 1, 1), (1, 4, 2, 2), (1, 5, 3, 4)}
    up = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (9, 8)], "c long, p long")
    assert {tuple(r) for r in gr.roots(up).collect()} == {(2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 1, 4), (9, 8, 1)}


def test_distance_queries_count_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(5)
    spark.createDataFrame([(i, i % 3, r.tolist()) for i, r in enumerate(rng.normal(size=(60, 4)))], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    arcs = [(r.src, r.dst) for r in core.nn(spark, str(tmp_path)).select("src", "dst").collect()]

    def hist(pairs):
        out, to = {}, {i: {b for a, b in pairs if a == i} for i in range(60)}
        for root in range(60):
            seen, front, d = {root}, {root}, 0
            while front := set().union(*(to[i] for i in front)) - seen:
                seen, d = seen | front, d + 1
                out[d] = out.get(d, 0) + len(front)
        return out

    assert {r.d: r.pairs for r in core.distance_hist(spark, str(tmp_path)).collect()} == hist(arcs + [(b, a) for a, b in arcs])
    want, got = hist(arcs), core.directed_efficiency(spark, str(tmp_path)).first()
    assert (got.reached, got.diameter) == (sum(want.values()), max(want))
    assert math.isclose(got.mean, sum(d * n for d, n in want.items()) / got.reached, abs_tol=1e-6)
    assert math.isclose(got.efficiency, sum(n / d for d, n in want.items()) / (60 * 59), abs_tol=1e-8) and math.isclose(got.reachable_share, got.reached / (60 * 59), abs_tol=1e-8)


def test_fingerprints_tell_graphs_apart(spark):
    def digest(pairs, n=6):
        return gr.fingerprint(edges(spark, pairs), verts(spark, n)).first().digest

    a = digest([(1, 4), (2, 3)])
    assert a == digest([(2, 3), (1, 4)]) and len({a, digest([(1, 3), (2, 4)]), digest([(1, 4), (2, 3)], 7), digest([(1, 4)])}) == 4
    assert "digest" in core.graph_fingerprint(spark, SF).columns


def test_partitions(spark):
    p = spark.createDataFrame(list(enumerate([7, 3, 3, 9, 9, 9, 7, 5])), "id long, community long")
    assert [r.community for r in co.canonical(p).orderBy("id").collect()] == [1, 2, 2, 0, 0, 0, 1, 3]
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(9)], "a int, b int")
    r = co.agreement(same).first()
    assert math.isclose(r.nmi, 1) and math.isclose(r.ari, 1) and r.purity == 1
    gaps = spark.createDataFrame([("x", "u"), ("", "u"), (None, "v"), ("y", "v")], "a string, b string")
    assert co.agreement(gaps).first().n == 2
    one = co.agreement(spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")).first()
    assert one.nmi == 0


@pytest.mark.parametrize("method", ["leiden", "louvain"])
def test_two_cliques(spark, method):
    k5 = list(itertools.combinations(range(5), 2))
    e = spark.createDataFrame([("g", a, b) for a, b in [*k5, *((a + 5, b + 5) for a, b in k5), (4, 5)]], "graph_id string, src long, dst long")
    got = co.communities(e, seeds=2, method=method).toPandas()
    for _, g in got.groupby("seed"):
        assert g[g.id < 5].community.nunique() == 1 and g.community.nunique() == 2


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if not isinstance(v, str) else v


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(core.ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(_norm(x[rel.columns.index(c)]) for c in cols) for x in rel.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "label", "degree"] and df.count() == 20


def test_entry_has_rows_for_each_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sentences(spark):
    t = 'O Dr. Silva chegou. "Sim", disse J. Prado. Às 3 h saiu! e voltou… Fim'
    d = spark.createDataFrame([(0, t), (1, None), (2, "  "), (3, "  Ao sul. Cá. d.  "), (4, "Vol. II etc. Fim. (Ver cap. 3.) Já"), (5, "Um\u001edois. Três")], "id long, text string")
    got = {}
    for r in tx.sentence_spans(d, ["id"], "text").orderBy("id", "sentence").collect():
        got.setdefault(r.id, []).append((r.start, r.end))
    assert [t[a:b] for a, b in got[0]] == ["O Dr. Silva chegou.", '"Sim", disse J. Prado.', "Às 3 h saiu! e voltou…", "Fim"]
    assert got[3] == [(2, 9), (10, 16)] and 1 not in got and 2 not in got
    u = "Vol. II etc. Fim. (Ver cap. 3.) Já"
    assert [u[a:b] for a, b in got[4]] == ["Vol. II etc. Fim.", "(Ver cap. 3.)", "Já"]
    assert got[5] == [(0, 8), (9, 13)]


def test_script_classes(spark):
    cases = {"abc é": "mixed", " abc": "latin", "12": "digits", "…!": "punctuation", " ": "whitespace", "a\ufffd": "byte_fragment", "日本": "cjk", "ひカ한": "cjk", "мир": "other_script", "мирabc": "mixed", "a1": "mixed", "αβ": "other_script"}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.script_class(od.F.col("t")).alias("c"))
    assert {r.t: r.c for r in d.collect()} == cases


def test_bands(spark):
    d = spark.createDataFrame([(v,) for v in (1, 2, 3, 9, 50)], "v long")
    got = [r.b for r in d.select(tx.band_label(od.F.col("v"), [(1, 2), (3, 3), (4, 20)], open_top=True).alias("b")).collect()]
    assert got == ["1-2", "1-2", "3", "4+", "4+"]
    with pytest.raises(Exception, match="outside the bands"):
        d.select(tx.band_label(od.F.col("v"), [(1, 2), (3, 20)])).collect()
    with pytest.raises(ValueError, match="joined intervals"):
        tx.band_label(od.F.col("v"), [(1, 2), (4, 5)])


def test_plans(spark):
    specs = plan.graph_specs([("a", [5, 10]), ("a", [10])], ["union"], ["position", "random"], seeds=2)
    assert [s.graph_id for s in specs] == ["a|5|position", "a|5|random|0", "a|5|random|1", "a|10|position", "a|10|random|0", "a|10|random|1"]
    assert plan.closest_k([5, 15], 10) == 5 and plan.closest_k([], 3) is None
    e = {("a", 5): edges(spark, [(0, 1), (2, 3)]), ("a", 10): edges(spark, [(2, 3), (0, 1)])}
    assert {r.canonical for r in plan.canonical(specs, e).collect()} == {"a|5|position"}
    x = dyadic(30, 5)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    sets = plan.neighbor_sets(kn.candidates(v, 4), [2, 4], ["position", "random"], 2).toPandas()
    assert {(r.src, r.dst) for r in sets[(sets.k == 4) & (sets.tie == "position")].itertuples()} == brute(x, 4, 1e-6, "position")
    assert len(sets) == 30 * (2 + 4) * 3


def test_double_sweep(spark):
    path = edges(spark, [(i, i + 1) for i in range(9)] + [(4, 20)])
    assert gr.double_sweep(gr.both_ways(path), 4).first().bound == 9
    assert gr.double_sweep(gr.both_ways(path), 77).first().bound == 0


def test_grouped_nmi(spark):
    rows = [("x", 1, 1), ("x", 2, 2), ("x", 2, 2), ("y", 1, 1), ("y", 1, 2), ("z", 1, 1)]
    got = {r.k: (r.n, round(r.nmi, 6)) for r in co.grouped_nmi(spark.createDataFrame(rows, "k string, a int, b int"), ["k"]).collect()}
    assert got == {"x": (3, 1.0), "y": (2, 0.0), "z": (1, 1.0)}


def test_template_names(spark):
    d = spark.createDataFrame([("{{Info/Biografia|x={{A_b}}}} {{ C }}",)], "t string")
    assert d.select(tx.template_names(od.F.col("t")).alias("n")).first().n == ["info/biografia", "a b", "c"]


def test_token_kinds():
    t = "casas 12, fim"
    kinds = tx.token_kinds(t, [(0, 3), (3, 5), (5, 6), (6, 8), (8, 9), (9, 13)])
    assert [k[0] for k in kinds] == ["word_start", "continuation", "whitespace", "number", "punctuation", "whole_word"]
    assert [k[1:] for k in kinds] == [(0, 0, 2), (0, 1, 2), (-1, -1, 0), (1, 0, 1), (-1, -1, 0), (2, 0, 1)]
    assert tx.token_kinds("ab cd", [(0, 5)])[0][1] == 0  # the earlier word on a tie


def plain_cut(text, titles):
    import re

    level, kept = 0, []
    for line in text.split("\n"):
        head = re.fullmatch(r"(={2,6})\s*(.+?)\s*\1\s*", line)
        if head and (not level or len(head[1]) <= level):
            level = len(head[1]) if head[2].lower() in titles else 0
        if not level:
            kept.append(line)
    return "\n".join(kept)


def test_cut_sections(spark):
    rng = np.random.default_rng(6)
    texts = ["top\n== A ==\nx\n== Notas ==\ny\n=== sub ===\nz\n== B ==\nw"]
    for _ in range(60):
        lines = []
        for _ in range(rng.integers(1, 14)):
            n = int(rng.integers(2, 5))
            lines.append("x" if rng.random() < 0.4 else "=" * n + f" {rng.choice(['Notas', 'A', 'refs'])} " + "=" * n)
        texts.append("\n".join(lines))
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.text for r in tx.cut_sections(d, "id", "text", ["notas", "Refs"]).collect()}
    assert got == {i: plain_cut(t, ["notas", "refs"]) for i, t in enumerate(texts)} and got[0] == "top\n== A ==\nx\n== B ==\nw"


def test_file_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, "", None), (3, "ç", float("nan"))], "id int, t string, x double")
    files.write_jsonl(df.where("id < 3"), f"{tmp_path}/j")
    assert files.difference(files.read_jsonl(spark, f"{tmp_path}/j", "id int, t string, x double"), df.where("id < 3")).isEmpty()
    files.write_csv(df, f"{tmp_path}/c", ["id", "t", "x", "more"])
    back = files.read_csv(spark, f"{tmp_path}/c", "id int, t string, x double, more string", ["id", "t", "x"]).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, "a,b", 0.5), (2, "", None), (3, "ç", None)]
    with pytest.raises(ValueError):
        files.write_csv(df, f"{tmp_path}/d", ["id"])
    v = spark.createDataFrame([(0, "x<\x01"), (1, None)], "id long, name string")
    files.write_graphml(v, edges(spark, [(0, 1), (0, 1), (1, 1)]), f"{tmp_path}/g")
    assert [tuple(r) for r in files.read_graphml_edges(spark, f"{tmp_path}/g").collect()] == [(0, 1)]
    assert spark.read.text(f"{tmp_path}/g").where("value like '%x&lt;\ufffd<%'").count() == 1


def test_bf16(spark):
    assert more.bf16_error(spark, SF).where("error > 0.00390625 or error is null").isEmpty()


def test_prefix_groups_need_whole_texts(spark, tmp_path):
    rows = [(1, 0, "user", "hello"), (1, 1, "bot", "yes"), (1, 2, "user", "a"), (2, 0, "user", "hello"), (2, 1, "bot", "yet"), (3, 0, "user", "help"), (3, 1, "bot", "yes"), (4, 0, "user", "hello"), (4, 1, "bot", "yes"), (4, 2, "user", None), (5, 0, "bot", "hello")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in core.prefix_groups(spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 1), (2, 0, 1), (4, 0, 1), (1, 1, 1), (4, 1, 1)}


def test_token_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null").fetchall():
        for kind, _, place, size in tx.token_kinds(t, tokenizer.encode(t, add_special_tokens=False).offsets):
            n, c = want.get(kind, (0, 0))
            want[kind] = (n + 1, c + (place + 1 < size))
    assert {r.category: (r.n, r.continued) for r in more.token_table(spark, SF).collect()} == want


def copies(n, seed):
    """Vectors of four types, some of them equal."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)).astype(np.float32)
    x[rng.integers(0, n, n // 3)] = x[0]
    return x, rng.integers(0, 4, n)


def vectors_of(spark, x, types):
    return spark.createDataFrame([(i, int(t), r.tolist()) for i, (r, t) in enumerate(zip(x, types, strict=True))], "id long, type int, vec array<float>")


@pytest.mark.parametrize("block", [7, 2048])
def test_neighbours_pick_in_the_scan(spark, block):
    x, types = copies(60, 5)
    v = vectors_of(spark, x, types).select("id", "vec")
    picks = [kn.Pick(4), kn.Pick(2, eps=0.05), kn.Pick(4, "all", 0.05), kn.Pick(4, "random", 0.05, "7")]
    rows = kn.neighbours(v, picks, block_rows=block)
    got = {n: {(r.src, r.dst) for r in rows.collect() if r.pick == n} for n in range(4)}
    assert got[0] == brute(x.astype(float), 4, 1e-6, "position") and got[1] == brute(x.astype(float), 2, 0.05, "position") and got[2] == brute(x.astype(float), 4, 0.05, "all")
    want = kn.select(kn.candidates(v, 4, 0.05), 4, 0.05, "random", "7").collect()
    assert got[3] == {(r.src, r.dst) for r in want}
    alone = kn.neighbours(v, [kn.Pick(4)], block_rows=block)  # equal values are cut short where only the first are wanted
    assert {(r.src, r.dst) for r in alone.collect()} == got[0]


@pytest.mark.parametrize("block", [7, 2048])
def test_neighbours_of_other_types(spark, block):
    x, types = copies(60, 6)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    want = set()
    for i in range(60):
        best = sorted(((-round(s[i, types == t].max(), 12), int(t)) for t in range(4) if t != types[i]))[:2]
        want |= {(i, t) for _, t in best}
    got = kn.neighbours(vectors_of(spark, x, types), [kn.Pick(2, eps=0.0)], typed=True, block_rows=block)
    assert {(r.src, r.dst) for r in got.collect()} == want


def test_scan_shuffles_in_proportion(spark):
    """Three times the rows, three times the shuffle once there are 36 blocks: vectors went to a number of blocks that grew with the rows."""
    size = {}
    for n in (720, 2160):
        v = spark.range(n).select("id", F.array(*(F.sin(F.col("id") * k + k).cast("float") for k in range(1, 5))).alias("vec"))
        plan = kn.neighbours(v, [kn.Pick(2)], block_rows=10)
        size[n] = plan.count(), plan.rdd.getNumPartitions()
    assert size == {720: (1440, 36), 2160: (4320, 36)}


def test_lexical_neighbours_of_frequent_types(spark):
    """Rows of a type of 3,000 get their neighbours from one short list, not from 9,000,000 pairs."""
    types = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "type int, vec array<double>")
    rows = spark.range(3003).select("id", F.when(F.col("id") >= 3000, F.col("id") - 2999).otherwise(0).cast("int").alias("type"))  # one row of type 1, two of type 2
    rows = rows.withColumn("type", F.least("type", F.lit(2)))
    got = kn.lexical_neighbours(rows, types, 3).toPandas()
    lists = got.sort_values("dst").groupby("src")["dst"].apply(list)
    assert len(got) == 3003 * 3 and lists[0] == [1, 2, 3] and lists[2] == [0, 1, 3] and lists[2999] == [0, 1, 2]
    assert lists[3000] == [0, 1, 2] and lists[3001] == [0, 3000, 3002] and lists[3002] == [0, 3000, 3001]


def test_walks_from_many_sources(spark):
    """Hubs, several blocks of sources and sources outside the graph, against joins; nothing is written by source and vertex."""
    rng = np.random.default_rng(9)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 1500, (2500, 2))} | {(int(a), 3) for a in rng.integers(0, 1500, 700)}
    arcs = edges(spark, sorted(pairs)).checkpoint()
    ids = spark.range(1600)
    got = {r.d: r.pairs for r in gr.distances(arcs, ids).collect()}
    assert got == {r.d: r.pairs for r in gr.joined_distances(arcs, ids).collect()} and len(got) > 5


def test_moves_leave_the_partition_they_start_from():
    part = np.arange(4)
    at, to = np.array([0, 1, 2, 3, 4]), np.array([1, 0, 3, 2])
    got = co._moves(4, at, to, np.ones(4), np.ones(4), 4.0, 1.0, np.random.default_rng(0), part)
    assert part.tolist() == [0, 1, 2, 3] and got[0] == got[1] != got[2] == got[3]
