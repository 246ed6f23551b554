"""Partitions: agreement measures, modularity, and Louvain and Leiden communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contingency(pairs: DataFrame) -> DataFrame:
    """(a, b, n) of pairs(a, b); rows with a null or empty label don't count."""
    ok = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return pairs.where(ok("a") & ok("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame) -> DataFrame:
    """n, nmi, ari, purity, inverse_purity of pairs(a = predicted, b = true). Both sides constant: nmi 1 and ari null; one: nmi 0."""
    c = contingency(pairs)
    side = lambda k: c.groupBy(k).agg(F.sum("n").alias("s"), F.max("n").alias("top")).agg(
        F.sum("s").alias("total"), F.sum(F.col("s") * F.log(F.col("s").cast("double"))).alias(f"l{k}"), F.sum(F.col("s") * (F.col("s") - 1) / 2).alias(f"p{k}"), F.sum("top").alias(f"t{k}"), F.count("*").alias(f"c{k}"))
    both = c.agg(F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("lab"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pab"))
    x = side("a").crossJoin(side("b").drop("total")).crossJoin(both)
    n = F.col("total").cast("double")
    ha, hb, hab = (F.log(n) - F.col(k) / n for k in ("la", "lb", "lab"))
    expected = F.col("pa") * F.col("pb") / F.nullif(n * (n - 1) / 2, F.lit(0.0))
    nmi = F.when((F.col("ca") == 1) & (F.col("cb") == 1), 1.0).when((F.col("ca") == 1) | (F.col("cb") == 1), 0.0).otherwise(2 * (ha + hb - hab) / F.nullif(ha + hb, F.lit(0.0)))
    ari = (F.col("pab") - expected) / F.nullif((F.col("pa") + F.col("pb")) / 2 - expected, F.lit(0.0))
    return x.select(F.col("total").alias("n"), nmi.alias("nmi"), ari.alias("ari"), (F.col("ta") / n).alias("purity"), (F.col("tb") / n).alias("inverse_purity"))


def modularity(edges: DataFrame, parts: DataFrame, resolution: float = 1.0) -> DataFrame:
    """modularity of undirected edges under parts(id, community)."""
    e = edges.join(parts.withColumnsRenamed({"id": "src", "community": "a"}), "src").join(parts.withColumnsRenamed({"id": "dst", "community": "b"}), "dst")
    ends = e.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    inner = e.where("a = b").groupBy(F.col("a").alias("c")).agg(F.count("*").alias("l"))
    m = e.agg(F.count("*").cast("double").alias("m"))
    return ends.join(inner, "c", "left").crossJoin(m).agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def canonical(parts: DataFrame) -> DataFrame:
    """(id, community) with labels from 0 by falling size, then by smallest id."""
    sizes = parts.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    new = sizes.withColumn("new", F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1)
    return parts.join(new, "community").select("id", F.col("new").cast("long").alias("community"))


def _moves(n, at, to, w, strength, total, resolution, rng, part):
    """The partition after moving single vertices to the neighbouring community of most gain until none gains."""
    weight = np.bincount(part, strength, minlength=n).tolist()
    waiting, queued = rng.permutation(n).tolist(), [True] * n
    part, strength, at = part.tolist(), strength.tolist(), at.tolist()  # single values of lists are read faster than those of arrays
    head = 0
    while head < len(waiting):
        v = waiting[head]
        head += 1
        queued[v] = False
        own, around = part[v], to[at[v] : at[v + 1]]
        links: dict[int, float] = {}
        for u, x in zip(around.tolist(), w[at[v] : at[v + 1]].tolist(), strict=True):
            if u != v:
                links[part[u]] = links.get(part[u], 0.0) + x
        weight[own] -= strength[v]
        best, gain = own, links.get(own, 0.0) - resolution * strength[v] * weight[own] / total
        for c in sorted(links):
            g = links[c] - resolution * strength[v] * weight[c] / total
            if g > gain + 1e-12:
                best, gain = c, g
        weight[best] += strength[v]
        if best != own:
            part[v] = best
            for u in around.tolist():
                if part[u] != best and not queued[u]:
                    queued[u] = True
                    waiting.append(u)
    return np.array(part, dtype=np.int64)


def _refine(n, at, to, w, strength, total, resolution, rng, part):
    """Within each community, merges single vertices into well-connected sub-communities, each of which is connected."""
    sub, size, alone = list(range(n)), strength.tolist(), [True] * n
    part, strength, at = part.tolist(), strength.tolist(), at.tolist()
    for v in rng.permutation(n).tolist():
        if not alone[v]:
            continue
        links: dict[int, float] = {}
        for u, x in zip(to[at[v] : at[v + 1]].tolist(), w[at[v] : at[v + 1]].tolist(), strict=True):
            if u != v and part[u] == part[v]:
                links[sub[u]] = links.get(sub[u], 0.0) + x
        best, gain = sub[v], 0.0
        for c in sorted(links):
            g = links[c] - resolution * strength[v] * size[c] / total
            if g > gain + 1e-12:
                best, gain = c, g
        if best != sub[v]:
            size[best] += strength[v]
            size[sub[v]] -= strength[v]
            alone[best] = alone[v] = False
            sub[v] = best
    return np.array(sub, dtype=np.int64)


def detect(src: np.ndarray, dst: np.ndarray, n: int, resolution: float, seed: int, leiden: bool) -> np.ndarray:
    """Community of each of n vertices by multilevel modularity; with leiden a refinement keeps communities connected."""
    rng = np.random.default_rng(seed)
    a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.ones(2 * len(src))
    member, part = np.arange(n), np.arange(n)
    total = max(1.0, float(len(w)))
    while True:
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        at = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
        strength = np.bincount(a, w, minlength=n)
        part = _moves(n, at, b, w, strength, total, resolution, rng, part)
        _, part = np.unique(part, return_inverse=True)
        if part.max(initial=-1) + 1 == n:
            return part[member]
        groups = _refine(n, at, b, w, strength, total, resolution, rng, part) if leiden else part
        _, groups = np.unique(groups, return_inverse=True)
        k = int(groups.max()) + 1
        if k == n:
            return part[member]
        upper = np.zeros(k, dtype=np.int64)
        upper[groups] = part
        key, inv = np.unique(groups[a] * k + groups[b], return_inverse=True)
        a, b, w = key // k, key % k, np.bincount(inv, w)
        member, n, part = groups[member], k, upper


def communities(graphs: DataFrame, resolution: float = 1.0, seeds: int = 3, method: str = "leiden") -> DataFrame:
    """(graph_id, seed, id, community) of graphs(graph_id, src, dst): each graph and seed is one task; graphs are independent."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        ids, both = np.unique(np.concatenate([frame["src"], frame["dst"]]), return_inverse=True)
        s, t = both[: len(frame)], both[len(frame) :]
        part = detect(s, t, len(ids), resolution, int(key[1]), method == "leiden")
        return pd.DataFrame({"graph_id": key[0], "seed": key[1], "id": ids, "community": part})

    fan = graphs.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return fan.groupBy("graph_id", "seed").applyInPandas(run, "graph_id string, seed int, id long, community long")


def grouped_nmi(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, nmi) of pairs(keys, a, b), for each group of the keys; both sides constant: 1, one: 0. Rows with a null or empty label don't count."""
    ok = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    c = pairs.where(ok("a") & ok("b")).groupBy(*keys, "a", "b").agg(F.count("*").cast("double").alias("n"))
    part = lambda df, s, name: df.groupBy(*keys).agg(F.sum(F.col(s) * F.log(s)).alias(f"l{name}"), F.count("*").alias(f"c{name}"))
    side = lambda k: part(c.groupBy(*keys, k).agg(F.sum("n").alias("s")), "s", k)
    n = c.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("lab"))
    x = n.join(side("a"), keys).join(side("b"), keys)
    ha, hb, hab = (F.log("t") - F.col(k) / F.col("t") for k in ("la", "lb", "lab"))
    nmi = F.when((F.col("ca") == 1) & (F.col("cb") == 1), 1.0).when((F.col("ca") == 1) | (F.col("cb") == 1), 0.0).otherwise(2 * (ha + hb - hab) / F.nullif(ha + hb, F.lit(0.0)))
    return x.select(*keys, F.col("t").cast("long").alias("n"), nmi.alias("nmi"))
