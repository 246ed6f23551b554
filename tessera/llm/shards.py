"""Sharding by a Feistel permutation with cycle walking over global row numbers, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut


@dataclass(frozen=True)
class ShardParams:
    """bucket_bits sets how many buckets the rows are numbered in; their counts are the only thing that is gathered, so that table has a fixed size."""

    shards: int = 8
    seed: int = 20240229
    rounds: int = 6
    bucket_bits: int = 13


def _feistel(x: Column, a: int, b: int, seed: int, rounds: int, inverse: bool = False) -> Column:
    """A bijection of 0..a*b-1: the remainder by a and the quotient take turns in adding a keyed hash of the other."""
    turns = [F.lit(i) for i in (range(rounds) if not inverse else reversed(range(rounds)))]
    sign = -1 if inverse else 1

    def turn(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        even = F.pmod(left + sign * F.pmod(F.xxhash64(right, i, F.lit(seed)), F.lit(a)), F.lit(a))
        odd = F.pmod(right + sign * F.pmod(F.xxhash64(left, i, F.lit(seed)), F.lit(b)), F.lit(b))
        return F.when(i % 2 == 0, F.struct(even.cast("long").alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), odd.cast("long").alias("r")))

    start = F.struct(F.pmod(x, F.lit(a)).cast("long").alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
    return F.aggregate(F.array(*turns), start, turn, lambda s: s["r"] * F.lit(a) + s["l"])


def permuted(x: Column, n: int, seed: int, rounds: int = 6, inverse: bool = False) -> Column:
    """The place of row number x (0..n-1) in a reproducible shuffle of n rows, or, with inverse, the row number of a place.

    The domain a * b is n rounded up by less than its root. Places past the end walk on along their cycle, which reaches the domain
    again after at most as many steps as there are places past the end; all such walks together take at most n steps.
    """
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    over = a * b - n
    once = _feistel(x, a, b, seed, rounds, inverse)
    if not over:
        return once
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(over)), once, lambda y, _: F.when(y < n, y).otherwise(_feistel(y, a, b, seed, rounds, inverse)))
    return F.when(once < n, once).otherwise(walk)


RUN = 10_000  # numbers that one row is expanded to at most


def numbered(rows: DataFrame, keys: list[str], bucket_bits: int) -> tuple[DataFrame, int]:
    """(the rows of `keys` with a global row_number from 0, their count), in the order of a hash of all keys, then of the keys.

    Equal rows are counted before the shuffle and numbered one after another, so a row that is repeated without end is no hot group.
    """
    h = F.xxhash64(*keys)
    some = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__h", h).withColumn("__bucket", F.shiftrightunsigned("__h", 64 - bucket_bits).cast("int")))
    counts = cut(some.groupBy("__bucket").agg(F.sum("__n").alias("__rows")))
    total = counts.agg(F.sum("__rows")).first()[0] or 0
    before = counts.select("__bucket", (F.sum("__rows").over(Window.orderBy("__bucket")) - F.col("__rows")).alias("__before"))  # at most 2**bucket_bits rows
    order = Window.partitionBy("__bucket").orderBy("__h", *keys)
    first = some.withColumn("__to", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(before), "__bucket")
    first = first.withColumn("__from", F.col("__before") + F.col("__to") - F.col("__n"))
    few = first.where(F.col("__n") <= RUN).select(*keys, F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("__n") - 1)).alias("row_number"))
    run = F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / RUN)))
    runs = first.where(F.col("__n") > RUN).select(*keys, "__from", "__n", run.alias("__run"))  # rows repeated often are dealt out anew, a run of numbers a row
    runs = runs.repartition("__from", "__run").select(*keys, (F.col("__from") + F.col("__run") * RUN).alias("__a"), (F.col("__from") + F.least((F.col("__run") + 1) * RUN, F.col("__n")) - 1).alias("__b"))
    return few.unionByName(runs.select(*keys, F.explode(F.sequence("__a", "__b")).alias("row_number"))), total


def assign(documents: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of documents(doc_id, text, ...), by the law `rows`.

    The place p of a row in the shuffle gives shard p mod shards and slot p div shards: the shards' counts differ by one at most and
    slots have no gaps. A null text has no bytes (size 1, crc 0). Rows with a null id and repeated rows are dealt out like all others;
    equal rows are exchangeable. An empty table gives no rows. Other columns aren't read. The shuffle carries three numbers a row.
    """
    p = params
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, total = numbered(rows, ["doc_id", "size", "text_crc32"], p.bucket_bits)
    placed = rows.select("doc_id", "size", "text_crc32", permuted(F.col("row_number"), total, p.seed, p.rounds).alias("__place"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("__place") % p.shards).cast("int").alias("shard"), F.floor(F.col("__place") / p.shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
