"""Ranks of dictionary rows for vectors: a blocked matrix product that counts, keeps top lists and forgets the similarities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import unit

DIGITS = 12  # cosines are compared after rounding, so that equal vectors tie


def ranked(queries: DataFrame, dictionary: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """id, own, nxt, own_rank, next_rank, own_cos, next_cos, argmax, top (array of structs label, cos) for each of queries(id, own, nxt, vec).

    dictionary(label, vec) has a row a label. A rank is the number of strictly larger cosines, -1 where nxt is null; argmax is the label
    of the largest dot product, the lowest on ties; top holds the k largest cosines, lower labels first on ties. Queries and dictionary
    are dealt into square blocks; a pair of blocks is one task, whose result is counts and k labels a query, never the product.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    vec = F.col("vec").cast("array<double>")
    words = dictionary.select(F.col("label").cast("long").alias("label"), vec.alias("w"), unit(vec).alias("wu"))
    q = queries.select("id", F.col("own").cast("long").alias("own"), F.col("nxt").cast("long").alias("nxt"), vec.alias("v"), unit(vec).alias("u"))
    for name in ("own", "nxt"):
        side = words.select(F.col("label").alias(name), F.col("wu").alias(f"__{name}"))
        q = q.join(side, name, "left").withColumn(f"cos_{name}", F.round(dot("u", f"__{name}"), DIGITS)).drop(f"__{name}")
    nq, nw = (max(1, -(-x.count() // block_rows)) for x in (queries, dictionary))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(F.pmod(F.hash("id"), F.lit(nq)).alias("x"), every(nw).alias("y"), "id", "own", "nxt", "cos_own", "cos_nxt", "v", "u")
    right = words.select(every(nq).alias("x"), F.pmod(F.hash("label"), F.lit(nw)).alias("y"), "label", "w", "wu")

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "own", "nxt", "cos_own", "cos_nxt", "above_own", "above_nxt", "labels", "cosines", "best", "best_dot"]
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        b = b.sort_values("label")
        label = b["label"].to_numpy()
        cos = np.round(np.stack(a["u"].to_numpy()) @ np.stack(b["wu"].to_numpy()).T, DIGITS)
        raw = np.stack(a["v"].to_numpy()) @ np.stack(b["w"].to_numpy()).T
        out = a[names[:5]].copy()
        for n, side in (("own", "cos_own"), ("nxt", "cos_nxt")):
            mine = a[n].to_numpy(dtype="float64")[:, None] == label[None, :]
            out[f"above_{n}"] = ((cos > a[side].to_numpy(dtype="float64")[:, None]) & ~mine).sum(axis=1)
        order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        out["labels"], out["cosines"] = list(label[order]), list(np.take_along_axis(cos, order, axis=1))
        at = np.round(raw, DIGITS).argmax(axis=1)
        out["best"], out["best_dot"] = label[at], np.round(raw, DIGITS)[np.arange(len(a)), at]
        return out

    schema = "id long, own long, nxt long, cos_own double, cos_nxt double, above_own long, above_nxt long, labels array<long>, cosines array<double>, best long, best_dot double"
    parts = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(block, schema)
    lists = F.array_sort(F.flatten(F.collect_list(F.arrays_zip((F.transform("cosines", lambda c: -c)).alias("minus"), F.col("labels").alias("label")))))
    found = parts.groupBy("id").agg(
        F.first("own").alias("own"), F.first("nxt").alias("nxt"), F.sum("above_own").alias("own_rank"), F.sum("above_nxt").alias("__next"), F.first("cos_own").alias("own_cos"),
        F.first("cos_nxt").alias("next_cos"), F.max_by("best", F.struct("best_dot", -F.col("best"))).alias("argmax"), lists.alias("__lists"))
    top = F.transform(F.slice("__lists", 1, k), lambda s: F.struct(s["label"].alias("label"), (-s["minus"]).alias("cos")))
    return found.select("id", "own", "nxt", "own_rank", F.when(F.col("nxt").isNull(), -1).otherwise(F.col("__next")).cast("long").alias("next_rank"), "own_cos", "next_cos", "argmax", top.alias("top"))


def rank_stats(ranks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Statistics of ranked() rows by keys, to six places; those of the next label leave out rows without one."""
    has = F.col("next_rank") >= 0
    r = lambda x: F.round(x, 6)
    share = lambda c: r(F.avg(c.cast("int")))
    on = lambda c: F.when(has, c)
    return ranks.groupBy(*keys).agg(
        F.count("*").alias("n"), r(F.median("own_rank")).alias("own_rank_median"), r(F.avg("own_rank")).alias("own_rank_mean"), share(F.col("own_rank") == 0).alias("own_rank0"),
        share(F.col("own_rank") < k).alias("own_in_topk"), r(F.avg("own_cos")).alias("own_cos_mean"), F.count(on(F.lit(1))).alias("next_n"), r(F.median(on(F.col("next_rank")))).alias("next_rank_median"),
        r(F.avg(on(F.col("next_rank")))).alias("next_rank_mean"), share(on(F.col("next_rank") == 0)).alias("next_rank0"), share(on(F.col("next_rank") < k)).alias("next_in_topk"),
        r(F.avg(on(F.col("next_cos")))).alias("next_cos_mean"), share(on(F.col("next_rank") < F.col("own_rank"))).alias("next_closer_than_own"))


def list_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, j): Jaccard of the two sides' lists (id, label), from one count over both."""
    n = a.select("id", "label").unionAll(b.select("id", "label")).groupBy("id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("id").agg((F.sum((F.col("n") == 2).cast("int")) / F.count("*")).alias("j"))


def top_rows(ranks: DataFrame) -> DataFrame:
    """(id, rank, label, cos) of ranked()'s top lists, ranks from 0."""
    return ranks.select("id", F.posexplode("top").alias("rank", "s")).select("id", "rank", "s.label", "s.cos")


def first_layer(curve: DataFrame, depth: str, share: str) -> DataFrame:
    """The least depth whose share is above one half; null where none is."""
    return curve.agg(F.min(F.when(F.col(share) > 0.5, F.col(depth))).alias("layer"))


