"""Exports: plain dicts, and networkx where it is installed."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..schema import decode_attr


def collapse_parallel(graph: PropertyGraph) -> DataFrame:
    """An edge for each pair of ends, with the attributes of the last in order."""
    return graph.edges.groupBy("src", "dst").agg(F.max_by("attr", "seq").alias("attr"), F.max("seq").alias("seq"), F.count("*").alias("parallel"))


def to_dict(graph: PropertyGraph) -> dict[str, dict[str, Any]]:
    return {r.id: decode_attr(r.attr) for r in graph.nodes.toLocalIterator()}


def to_networkx(graph: PropertyGraph) -> Any:
    """A DiGraph; parallel edges fall together and later attributes win key by key."""
    try:
        import networkx as nx
    except ImportError as e:
        raise RuntimeError("networkx is not installed") from e
    out = nx.DiGraph()
    for r in graph.nodes.toLocalIterator():
        out.add_node(r.id, **decode_attr(r.attr))
    for r in graph.edges.orderBy("seq").toLocalIterator():
        out.add_edge(r.src, r.dst, **decode_attr(r.attr))
    return out
