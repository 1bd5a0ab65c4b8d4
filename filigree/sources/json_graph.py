"""Tagged JSON interchange: ``{"nodes": {...}, "edges": {...}, "meta": {...}, "metadata": {...}}``."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph, kept
from ..schema import ATTR, EDGES, NODES, decode_attr, encode

#: Names of the value variants.
TAGS = ("String", "Int", "Float", "Half", "Bool", "None", "List", "Dict")


def tag(value: Any) -> Any:
    """A Python value in its tagged form; non-finite floats as text, which JSON can hold."""
    if value is None:
        return "None"
    if isinstance(value, bool):
        return {"Bool": value}
    if isinstance(value, str):
        return {"String": value}
    if isinstance(value, int):
        return {"Int": value}
    if isinstance(value, float):
        return {"Float": value if value - value == 0 else str(value)}
    if isinstance(value, (list, tuple)):
        return {"List": [tag(v) for v in value]}
    if isinstance(value, dict):
        return {"Dict": {str(k): tag(v) for k, v in value.items()}}
    return {"String": str(value)}


def untag(value: Any) -> Any:
    """Back from the tagged form; plain values are taken as they are."""
    if value == "None":
        return None
    if isinstance(value, dict) and len(value) == 1:
        (name, inner), = value.items()
        if name in TAGS:
            if name == "List":
                return [untag(v) for v in inner]
            if name == "Dict":
                return {k: untag(v) for k, v in inner.items()}
            return float(inner) if name in ("Float", "Half") else inner
    return value


_NAMES = ("t", "s", "i", "d", "b", "j")
_RECORD = f"kind string, id string, src string, dst string, attr {ATTR.simpleString()}, meta {ATTR.simpleString()}, seq long"


def _values(raw: dict[str, Any] | None) -> dict[str, dict[str, Any]]:
    return {k: dict(zip(_NAMES, encode(untag(v)))) for k, v in (raw or {}).items()}


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a document's nodes, edges and meta."""
    for part in batches:
        for text in part["value"]:
            doc = json.loads(text)
            rows = [("meta", None, None, None, {}, _values(doc.get("meta")), 0)]
            rows += [("node", n.get("id", k), None, None, _values(n.get("attr")), _values(n.get("meta")), i) for i, (k, n) in enumerate((doc.get("nodes") or {}).items())]
            rows += [("edge", e.get("id", k), e["from_id"], e["to_id"], _values(e.get("attr")), _values(e.get("meta")), i) for i, (k, e) in enumerate((doc.get("edges") or {}).items())]
            yield pd.DataFrame(rows, columns=["kind", "id", "src", "dst", "attr", "meta", "seq"])


def load_json(spark: SparkSession, source: str | dict[str, Any], validate: bool = True) -> PropertyGraph:
    """From a path, JSON text (it begins with a brace) or a dict.

    A file is read and parsed on the executors, a task each; ``edge_ids`` and
    the like are not needed, adjacency follows from the edges.
    """
    if isinstance(source, dict):
        source = json.dumps(source)
    if not isinstance(source, str):
        raise TypeError("a path, JSON text or a dict is needed")
    try:
        text = spark.createDataFrame([(source,)], "value string") if source.strip().startswith("{") else spark.read.text(source, wholetext=True)
        rows = text.mapInPandas(_records, _RECORD)
        meta = rows.where("kind = 'meta'").first()
    except Exception as e:
        raise RuntimeError(f"can't load the graph: {e}") from e
    nodes = rows.where("kind = 'node'").select([f.name for f in NODES])
    edges = rows.where("kind = 'edge'").select([f.name for f in EDGES])
    graph = PropertyGraph(nodes, edges, decode_attr(meta.meta) if meta else {})
    return graph.validate() if validate else graph


def tables(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes with the ids of their out- and in-edges, and edges with ids ``edge_{n}_{from}_to_{to}`` where they have none."""
    numbered = graph.edges.withColumn("id", F.coalesce("id", F.format_string("edge_%d_%s_to_%s", "seq", "src", "dst")))
    lists = lambda at, name: numbered.groupBy(F.col(at).alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("id").alias("e")))), lambda r: r["e"]).alias(name))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    nodes = graph.nodes.join(lists("src", "edge_ids"), "id", "left").join(lists("dst", "inverse_edge_ids"), "id", "left")
    own = [c for c in ("id", "attr", "meta") if c in graph.nodes.columns]
    return nodes.select(*own, empty("edge_ids"), empty("inverse_edge_ids")), numbered


def to_json(graph: PropertyGraph) -> str:
    """The document as text, for graphs that a driver holds."""
    nodes, edges = tables(kept(graph).validate())
    attrs = lambda row, name: {k: tag(v) for k, v in decode_attr(row[name]).items()} if name in row else {}
    ns = {r.id: {"id": r.id, "attr": attrs(r, "attr"), "meta": attrs(r, "meta"), "edge_ids": r.edge_ids, "inverse_edge_ids": r.inverse_edge_ids} for r in nodes.toLocalIterator()}
    es = {r.id: {"id": r.id, "from_id": r.src, "to_id": r.dst, "attr": attrs(r, "attr"), "meta": attrs(r, "meta")} for r in edges.orderBy("seq").toLocalIterator()}
    about = {"version": "1.0", "node_count": len(ns), "edge_count": len(es), "timestamp": datetime.now(timezone.utc).isoformat()}
    return json.dumps({"nodes": ns, "edges": es, "meta": {k: tag(v) for k, v in graph.meta.items()}, "metadata": about}, indent=2, ensure_ascii=False)


def save_json(graph: PropertyGraph, path: str) -> None:
    try:
        text = to_json(graph)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    except OSError as e:
        raise RuntimeError(f"can't save the graph: {e}") from e
