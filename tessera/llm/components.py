"""Connected components of a link table by label propagation with pointer jumping; all state stays in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id of links(a, b): component is the smallest id reachable. Loops and repeated links are allowed; no links give no rows.

    Each round takes for every id the least label of its neighbours and of itself (summed before the shuffle, so that a hub is no hot
    key), then follows labels once. Each round is cut by a reliable checkpoint. Labels only fall, and the rounds end when none does.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        step = cut(step)
        if step.where("component < old").isEmpty():
            return step.select("id", "component")
        up = step.select(F.col("id").alias("__up"), F.col("component").alias("__top"))
        labels = cut(step.join(up, step["component"] == up["__up"], "left").select("id", F.least("component", F.coalesce("__top", "component")).alias("component")))
