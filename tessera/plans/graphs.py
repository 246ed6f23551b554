"""Plans of graphs: which of representation, k, symmetrization, tie rule and seed are to be built, and which have the same edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph as gr
from ..operators import knn as kn


@dataclass(frozen=True)
class GraphSpec:
    """What identifies a graph; only random ties have seeds other than 0."""

    rep: str
    k: int
    sym: str
    tie: str
    seed: int = 0

    @property
    def graph_id(self) -> str:
        return f"{self.rep}|{self.k}|{self.tie}" + (f"|{self.seed}" if self.tie == "random" else "")


def graph_specs(reps: list[tuple[str, list[int]]], syms: list[str], ties: list[str], seeds: int = 1) -> list[GraphSpec]:
    """All combinations, each once, in order."""
    out: dict[GraphSpec, None] = {}
    for rep, ks in reps:
        for k in ks:
            if k < 1:
                raise ValueError("k must be 1 or more")
            for sym in syms:
                for tie in ties:
                    for seed in range(seeds if tie == "random" else 1):
                        out[GraphSpec(rep, k, sym, tie, seed)] = None
    return list(out)


def closest_k(known: list[int], wanted: int) -> int | None:
    """The k nearest to the one wanted, the smaller on a tie; None without any."""
    return min(known, key=lambda k: (abs(k - wanted), k), default=None)


def canonical(specs: list[GraphSpec], edges: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """(graph, edges, canonical): of each planned graph the number of edges and the first planned one with the same edge set. edges holds them by (rep, k)."""
    prints, out = {key: gr.fingerprint(e, e.select(F.col("src").alias("id")).limit(0)).select("edges", "digest") for key, e in edges.items()}, None
    prints = {key: gr.checkpointed(x) for key, x in prints.items()}  # a row each, asked for by every planned graph with these edges
    for i, s in enumerate(specs):
        one = prints[s.rep, s.k].select(F.lit(s.graph_id).alias("graph"), "edges", "digest", F.lit(i).alias("o"))
        out = one if out is None else out.unionAll(one)
    first = F.first("graph").over(Window.partitionBy("edges", "digest").orderBy("o"))  # a row a planned graph
    return out.withColumn("canonical", first).select("graph", "edges", "canonical")


def neighbor_sets(candidates: DataFrame, ks: list[int], ties: list[str], seeds: int = 1, eps: float = 1e-6, base: str = "7") -> DataFrame:
    """(k, tie, seed, src, dst) of every k, tie rule and seed, from one candidate list that is complete for the largest k."""
    c, out = gr.checkpointed(candidates), None
    for s in graph_specs([("", ks)], [""], ties, seeds):
        one = kn.select(c, s.k, eps, s.tie, f"{base}|{s.k}|{s.seed}").select(F.lit(s.k).alias("k"), F.lit(s.tie).alias("tie"), F.lit(s.seed).alias("seed"), "src", "dst")
        out = one if out is None else out.unionAll(one)
    return out
