"""Native persistence: Parquet tables and the meta dict; half precision on request."""


import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import PropertyGraph, kept


def save_parquet(graph: PropertyGraph, path: str, validate: bool = True, partition_by: list[str] | None = None) -> None:
    """Nodes, edges and meta under ``path``."""
    if validate:
        graph = kept(graph).validate()
    graph.nodes.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/nodes")
    edges = graph.edges.write.mode("overwrite").option("compression", "zstd")
    (edges.partitionBy(*partition_by) if partition_by else edges).parquet(f"{path}/edges")
    graph.spark.createDataFrame([(json.dumps(graph.meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_parquet(spark: SparkSession, path: str) -> PropertyGraph:
    try:
        meta = spark.read.text(f"{path}/meta").first()
        return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), json.loads(meta.value) if meta else {})
    except Exception as e:
        raise RuntimeError(f"can't load the graph: {e}") from e


@F.pandas_udf(T.DoubleType())
def half(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Doubles rounded to half precision."""
    for v in values:
        with np.errstate(over="ignore"):
            rounded = v.to_numpy(dtype="float64", na_value=np.nan).astype(np.float16).astype(np.float64)
        yield pd.Series(rounded).where(v.notna().to_numpy(), None)


def _rounded(x: object) -> object:
    """A JSON value with its floats in half precision."""
    if isinstance(x, float):
        with np.errstate(over="ignore"):
            return float(np.float16(x))
    if isinstance(x, list):
        return [_rounded(v) for v in x]
    if isinstance(x, dict):
        return {k: _rounded(v) for k, v in x.items()}
    return x


def _text(x: str | None) -> str | None:
    return None if x is None else json.dumps(_rounded(json.loads(x)), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def half_json(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON of lists and dicts with its floats rounded."""
    for v in values:
        yield v.map(_text)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def halves(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrays of doubles rounded to half precision; nulls stay."""
    for v in values:
        yield v.map(lambda xs: None if xs is None else [None if x is None or x != x else _rounded(float(x)) for x in xs])


@F.pandas_udf(T.ArrayType(T.StringType()))
def halves_json(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrays of JSON texts with their floats rounded; nulls stay."""
    for v in values:
        yield v.map(lambda xs: None if xs is None else [_text(x) for x in xs])


def _halved(table: DataFrame, column: str) -> DataFrame:
    """Every float of an attribute column in half precision; integers and text stay."""
    kind = table.schema[column].dataType
    if isinstance(kind, T.MapType):
        # the values of a row go through the UDFs as arrays, so a row stays one
        values = F.map_values(column)
        parts = F.arrays_zip(values.alias("v"), halves(F.transform(values, lambda v: v["d"])).alias("d"), halves_json(F.transform(values, lambda v: v["j"])).alias("j"))
        made = F.transform(
            parts,
            lambda x: F.struct(
                F.when(x["v"]["t"] == "Float", "Half").otherwise(x["v"]["t"]).alias("t"), x["v"]["s"].alias("s"), x["v"]["i"].alias("i"), x["d"].alias("d"), x["v"]["b"].alias("b"), x["j"].alias("j")
            ),
        )
        return table.withColumn(column, F.when(F.col(column).isNotNull(), F.map_from_arrays(F.map_keys(column), made)))

    def field(at: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return half(at.cast("double")).cast(t)
        if isinstance(t, T.StructType):
            return F.struct(*(field(at[f.name], f.dataType).alias(f.name) for f in t))
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.DoubleType, T.FloatType)):
            return F.from_json(half_json(F.to_json(at)), t)
        return at

    return table.withColumn(column, field(F.col(column), kind))


def save_parquet_f16(graph: PropertyGraph, path: str) -> None:
    """As ``save_parquet``, with floats of attributes and meta in half precision."""
    halves = [[c for c in ("attr", "meta") if c in t.columns] for t in (graph.nodes, graph.edges)]
    nodes, edges = graph.nodes, graph.edges
    for c in halves[0]:
        nodes = _halved(nodes, c)
    for c in halves[1]:
        edges = _halved(edges, c)
    save_parquet(graph.replace(nodes, edges), path)
