"""Embeddings: collecting, attaching, and nearest nodes by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..schema import Attributes
from .mutate import list_append


def collect_embeddings(graph: PropertyGraph, key: str = "embedding") -> DataFrame:
    """(id, embedding) of the nodes that have one."""
    a = Attributes(graph.nodes.schema)
    at = a.get(key)
    return graph.nodes.where(a.has(key)).select("id", (F.from_json(at["j"], "array<double>") if a.dynamic else at.cast("array<double>")).alias("embedding"))


def attach_embeddings(graph: PropertyGraph, embeddings: DataFrame | None = None, key: str = "embeddings") -> PropertyGraph:
    """Append each embedding to its node's list ``key``; by default those in the graph's meta."""
    if embeddings is None:
        if "embedding" not in graph.meta or "embedding_ids" not in graph.meta:
            raise ValueError("meta has no embeddings")
        rows = list(zip(graph.meta["embedding_ids"], ([float(x) for x in v] for v in graph.meta["embedding"])))
        embeddings = graph.spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], "id string, value array<double>, at long")
    return list_append(graph, key, embeddings)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)


def nearest(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding") -> DataFrame:
    """The k rows at least cosine distance from ``query``."""
    q = F.array(*(F.lit(float(x)) for x in query))
    size = F.sqrt(dot(F.col(vector), F.col(vector))) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    distance = F.lit(1.0) - F.try_divide(dot(F.col(vector), q), size)
    return vectors.withColumn("distance", distance).orderBy("distance").limit(k)
