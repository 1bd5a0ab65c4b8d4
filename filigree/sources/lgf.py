"""LGF: an indented text format for graphs.

    # a comment
    import("other.lgf")
    alice person admin
        name = "Alice"
        tags = [a, "b, c", 3]
        -knows-> bob
            since = 2020
        <-likes- carol

One parser reads one file (with its imports) and gives records; files of a
folder are parsed side by side on the executors.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..schema import EDGES, NODES, encode_map


class LgfError(ValueError):
    """A line that can't be understood."""


def scalar(text: str) -> Any:
    """Digits are an integer, what float() takes is a float, quotes make text, true and false booleans; the rest is text."""
    text = text.strip()
    if text.isdigit():
        return int(text)
    try:
        return float(text)
    except ValueError:
        pass
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    return {"true": True, "false": False}.get(text.lower(), text)


_ITEM = re.compile(r"""\s*("[^"]*"|'[^']*'|[^,]*)\s*(?:,|$)""")


def items(text: str) -> list[Any]:
    """Elements between commas; commas in quotes do not count."""
    return [scalar(m[1]) for m in _ITEM.finditer(text) if m[1].strip()]


@dataclass
class Records:
    """What was read: nodes by id, and edges in order."""

    nodes: dict[str, dict[str, Any]] = field(default_factory=dict)
    declared: set[str] = field(default_factory=set)
    edges: list[tuple[str, str, dict[str, Any]]] = field(default_factory=list)

    def node(self, node_id: str) -> dict[str, Any]:
        return self.nodes.setdefault(node_id, {})


_FORWARD = re.compile(r"-(.+?)->\s*(.+)$")
_IMPORT = re.compile(r"import\((.*)\)\s*$")


def _inverse(line: str) -> tuple[str, str] | None:
    """Relation and source of ``<-rel- source``; the first dash that a space follows ends the relation, else the last."""
    body = line[2:]
    cut = body.find("- ")
    cut = body.rfind("-") if cut < 0 else cut
    if cut < 0:
        return None
    rel, source = body[:cut].strip(), body[cut + 1 :].strip()
    return (rel, source) if rel and source else None


def parse(text: str, into: Records | None = None, base: str | None = None, seen: frozenset[str] = frozenset()) -> Records:
    out = into if into is not None else Records()
    node: str | None = None
    edge: dict[str, Any] | None = None
    edge_indent = 0
    pending: tuple[int, str, list[Any]] | None = None  # of an open list: indent, key, elements

    def put(indent: int, name: str, value: Any, close: bool = True) -> None:
        nonlocal edge
        if edge is not None and indent > edge_indent:
            edge[name] = value
            return
        if node is None:
            raise LgfError(f"attribute '{name}' stands before any node")
        if close:
            edge = None
        out.node(node)[name] = value

    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        indent = len(raw) - len(raw.lstrip())
        if pending is not None:
            at, name, values = pending
            if "]" in line:
                values += items(line[: line.index("]")])
                put(at, name, values, close=False)
                pending = None
            else:
                values += items(line.rstrip(","))
            continue
        if indent == 0:
            node, edge = None, None
            if m := _IMPORT.match(line):
                name = m[1].strip().strip("\"'")
                path = os.path.abspath(os.path.join(base or ".", name))
                if path in seen:
                    raise LgfError(f"'{name}' imports itself")
                with open(path, encoding="utf-8") as f:
                    parse(f.read(), out, os.path.dirname(path), seen | {path})
                continue
            node, *labels = line.split()
            known = out.node(node)
            out.declared.add(node)
            known["labels"] = list(dict.fromkeys([*known.get("labels", []), *labels]))
            continue
        if line.startswith("-") and (m := _FORWARD.match(line)) and m[1].strip("- ") and node is not None:
            target = m[2].strip()
            edge, edge_indent = {"type": m[1].strip().rstrip("-").strip()}, indent
            out.node(target)
            out.edges.append((node, target, edge))
            continue
        if line.startswith("<-") and node is not None and (found := _inverse(line)):
            edge, edge_indent = {"type": found[0]}, indent
            out.node(found[1])
            out.edges.append((found[1], node, edge))
            continue
        name, _, value = (p.strip() for p in line.partition("="))
        if value.startswith("["):
            if value.endswith("]"):
                put(indent, name, items(value[1:-1]))
            else:
                pending = (indent, name, items(value[1:].rstrip(",")))
            continue
        put(indent, name, scalar(value) if value else "")
    return out


def _graph(spark: SparkSession, records: Records) -> PropertyGraph:
    return PropertyGraph.from_records(spark, list(records.nodes.items()), records.edges)


def parse_lgf(spark: SparkSession, text: str, graph: PropertyGraph | None = None, base_path: str | None = None) -> PropertyGraph:
    """A graph from text, or ``graph`` with what the text adds; labels of a node that is there already are merged."""
    records = parse(text, base=base_path)
    new = _graph(spark, records)
    return new if graph is None else merge(graph, new)


def parse_lgf_file(spark: SparkSession, path: str, graph: PropertyGraph | None = None) -> PropertyGraph:
    with open(path, encoding="utf-8") as f:
        return parse_lgf(spark, f.read(), graph, os.path.dirname(os.path.abspath(path)))


def merge(old: PropertyGraph, new: PropertyGraph) -> PropertyGraph:
    """Nodes by id, later attributes over earlier ones, labels joined; edges one after the other."""
    both = old.nodes.select("id", "attr", F.lit(0).alias("o")).unionByName(new.nodes.select("id", "attr", F.lit(1).alias("o")))
    nodes = _merged(both)
    last = old.edges.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("n")).first().n
    edges = old.edges.unionByName(new.edges.withColumn("seq", F.col("seq") + last + 1), allowMissingColumns=True)
    return old.replace(nodes, edges)


def _shaped(attrs: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """Attributes as a pandas column of the dynamic layout takes them."""
    return {k: dict(zip(("t", "s", "i", "d", "b", "j"), v)) for k, v in encode_map(attrs).items()}


def _merged(rows: DataFrame) -> DataFrame:
    """One node an id from rows (id, attr, o), by order of ``o``."""

    kind = NODES["attr"].dataType

    def one(part: pa.Table) -> pa.Table:  # Arrow, as pandas makes floats of whole numbers beside nulls
        from pyspark.sql.pandas.types import to_arrow_type

        from ..schema import decode

        attrs: dict[str, Any] = {}
        for row in sorted(part.select(["o", "attr"]).to_pylist(), key=lambda r: r["o"]):
            for k, v in row["attr"]:
                v = decode(v)
                attrs[k] = list(dict.fromkeys([*attrs.get(k, []), *v])) if k == "labels" and isinstance(v, list) else v
        return pa.table({"id": part["id"].slice(0, 1), "attr": pa.array([list(_shaped(attrs).items())], to_arrow_type(kind))})

    single = rows.groupBy("id").agg(F.count("*").alias("c"))
    twice = rows.join(single.where("c > 1").select("id"), "id", "left_semi")
    once = rows.join(single.where("c = 1").select("id"), "id", "left_semi").select("id", "attr")
    joined = twice.groupBy("id").applyInArrow(one, f"id string, attr {kind.simpleString()}")
    return once.unionByName(joined).withColumn("meta", F.create_map().cast(NODES["meta"].dataType))


def _with_imports(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The files and those that their import lines name, relative to the file itself, each once."""
    line = F.explode(F.filter(F.split("value", "\r?\n"), lambda x: x.startswith("import")))
    known = {r.file for r in files.select("file").collect()}  # names, not texts
    now = files
    while True:
        wanted = set()
        for r in now.select("file", line.alias("line")).collect():
            if m := _IMPORT.match(r.line):
                wanted.add(_beside(r.file, m[1].strip().strip("\"'")))
        fresh = sorted(wanted - known)
        if not fresh:
            return files
        now = spark.read.text(fresh, wholetext=True).select(F.input_file_name().alias("file"), "value")
        files = files.unionAll(now)
        known |= set(fresh)


def _beside(file: str, name: str) -> str:
    """The URI of ``name`` as the file at a URI means it."""
    if "://" in name:
        return name
    scheme, _, path = file.partition("://") if "://" in file else ("", "", file)
    full = posixpath.normpath(posixpath.join(posixpath.dirname(path), name))
    return f"{scheme}://{full}" if scheme else full


def read_lgf(spark: SparkSession, path: str) -> PropertyGraph:
    """All files of a path or pattern and those they import, each parsed by one task, files ordered by name."""
    files = _with_imports(spark, spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))
    schema = f"kind string, id string, dst string, file string, at long, attr {NODES['attr'].dataType.simpleString()}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for file, text in zip(part["file"], part["value"]):
                found = parse("\n".join(x for x in text.splitlines() if not _IMPORT.match(x)))
                rows += [("node", i, None, file, k, _shaped(a)) for k, (i, a) in enumerate(found.nodes.items())]
                rows += [("edge", s, d, file, k, _shaped(a)) for k, (s, d, a) in enumerate(found.edges)]
            yield pd.DataFrame(rows, columns=["kind", "id", "dst", "file", "at", "attr"])

    records = files.mapInPandas(run, schema)
    from pyspark.sql import Window

    nodes = _merged(records.where("kind = 'node'").select("id", "attr", F.struct("file", "at").cast("string").alias("o")))
    counts = records.where("kind = 'edge'").groupBy("file").agg(F.count("*").alias("n"))
    before = counts.withColumn("b", F.sum("n").over(Window.orderBy("file")) - F.col("n")).select("file", "b")  # a row a file
    edges = records.where("kind = 'edge'").join(before, "file")
    edges = edges.select(F.lit(None).cast("string").alias("id"), F.col("id").alias("src"), "dst", "attr", F.create_map().cast(EDGES["meta"].dataType).alias("meta"), (F.col("b") + F.col("at")).alias("seq"))
    return PropertyGraph(nodes, edges)
