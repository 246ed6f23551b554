"""File sources and sinks: JSON lines, CSV with a declared header, bfloat16 vectors, GraphML, and the difference of two tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with these fields: a column outside them is an error, a missing one is empty; NaN and null are empty cells."""
    extra = set(df.columns) - set(fields)
    if extra:
        raise ValueError(f"undeclared columns {sorted(extra)}")
    types = dict(df.dtypes)
    cells = [(F.nanvl(F.col(f), F.lit(None).cast(types[f])) if types.get(f) in ("double", "float") else F.col(f) if f in types else F.lit(None).cast("string")).alias(f) for f in fields]
    df.select(*cells).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """The columns asked for. A quoted empty cell is an empty string, a bare one is null (the parser marks it by a character no file holds)."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", "\0").csv(path)
    return df.select(*columns) if columns else df


def parse_bool(name: str):
    """true/false, 1/0, yes/no in any case; anything else is an error."""
    x = F.lower(F.trim(F.col(name)))
    return F.when(x.isin("true", "1", "yes"), True).when(x.isin("false", "0", "no"), False).when(x.isNotNull(), F.raise_error(F.concat(F.lit("no boolean: "), x)).cast("boolean"))


def _flat(lists: pd.Series, dtype) -> tuple[np.ndarray, list[int]]:
    """All values of a batch's lists in turn, and where each but the first begins."""
    sizes = [0 if v is None else len(v) for v in lists]
    return np.concatenate([np.asarray(v, dtype=dtype) for v in lists if v is not None] or [np.zeros(0, dtype=dtype)]), np.cumsum(sizes)[:-1].tolist()


def _cut(flat: np.ndarray, at: list[int], lists: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else x for x, v in zip(np.split(flat, at), lists, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def bf16_bits(vectors: pd.Series) -> pd.Series:
    """Upper 16 bits of each float32, rounded to the nearest, ties to even."""
    x, at = _flat(vectors, np.float32)
    bits = x.view(np.uint32)
    out = (bits + np.uint32(0x7FFF) + (bits >> np.uint32(16) & np.uint32(1))) >> np.uint32(16)
    return _cut(np.where(np.isnan(x), np.uint32(0x7FC0), out).astype(np.int32), at, vectors)


@F.pandas_udf(ArrayType(FloatType()))
def bf16_floats(bits: pd.Series) -> pd.Series:
    x, at = _flat(bits, np.uint32)
    return _cut((x << np.uint32(16)).view(np.float32), at, bits)


def xml_text(column):
    """Text for XML: forbidden characters become U+FFFD, markup is escaped."""
    c = F.regexp_replace(column.cast("string"), "[^\\x09\\x0A\\x0D\\x20-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]", "�")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line) rows of a GraphML document of vertices(id, ...) and edges(src, dst); sorted by part they are the file."""
    names = [c for c in vertices.columns if c != "id"]
    data = [F.concat(F.lit(f'<data key="{n}">'), F.coalesce(xml_text(F.col(n)), F.lit("")), F.lit("</data>")) for n in names]
    node = vertices.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="n'), F.col("id").cast("string"), F.lit('">'), *data, F.lit("</node>")).alias("line"))
    edge = edges.select(F.lit(2), F.concat(F.lit('<edge source="n'), F.col("src").cast("string"), F.lit('" target="n'), F.col("dst").cast("string"), F.lit('"/>')))
    keys = "".join(f'<key id="{n}" for="node" attr.name="{n}" attr.type="string"/>' for n in names)
    ends = vertices.sparkSession.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, line string")
    return ends.unionAll(node).unionAll(edge)


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder of text parts that, joined in name order, are the document."""
    graphml_lines(vertices, edges).repartitionByRange("part").sortWithinPartitions("part").select("line").write.text(path)


def read_graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """Distinct edges (src, dst) without loops."""
    found = spark.read.text(path).select(*(F.regexp_extract("value", f'<edge [^>]*{k}="n?(\\d+)"', 1).alias(n) for k, n in (("source", "src"), ("target", "dst"))))
    return found.where("src <> ''").selectExpr("cast(src as long) src", "cast(dst as long) dst").where("src <> dst").distinct()


def difference(a: DataFrame, b: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one table that the other lacks, repeated rows counted, without the ignored columns; side says where they are."""
    names = [c for c in a.columns if c not in ignored]
    a, b = a.select(*names), b.select(*names)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))
