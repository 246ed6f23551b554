"""Global order without one task: row numbers, running totals and the next row's value, by ranges of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import checkpointed


def running(rows: DataFrame, order: list[Column | str], value: Column, name: str, parts: int = 0) -> DataFrame:
    """rows with the total of value over all rows up to and with each, in a total order.

    Rows are dealt by ranges of the order; a window adds up within a range, and a table of one row a range holds what comes before.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.withColumn("__v", value).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part").agg(F.sum("__v").alias("__all"))
    before = totals.select("__part", (F.sum("__all").over(Window.orderBy("__part")) - F.col("__all")).alias("__before"))  # a row a range
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.sum("__v").over(w)).drop("__v", "__part", "__before")


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """rows with their place from 0 in a total order."""
    return running(rows, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def next_value(rows: DataFrame, key: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """rows(key, value, ...) with the value of the row with the next larger key, null for the last; keys are different numbers.

    Keys are dealt by buckets of `width`; only the first row of each bucket meets the other buckets.
    """
    bucketed = rows.withColumn("__b", F.floor(F.col(key) / width))
    first = bucketed.groupBy("__b").agg(F.min_by(value, key).alias("__first"))
    after = first.select("__b", F.lead("__first").over(Window.orderBy("__b")).alias("__after"))  # a row a bucket
    w = Window.partitionBy("__b").orderBy(key)
    return bucketed.join(after, "__b").withColumn(name, F.when(F.lead(F.lit(1)).over(w).isNotNull(), F.lead(value).over(w)).otherwise(F.col("__after"))).drop("__b", "__after")
