"""PropertyGraph: an immutable directed multigraph over two DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import EdgeExpr, NodeExpr, as_column, feature_name, has_all
from .plans.lineage import hint, keep
from .schema import EDGES, NODES, Attributes, decode_attr, encode_map


class PropertyGraph:
    """``nodes(id, attr, ...)``, ``edges(id, src, dst, attr, seq, ...)`` and a small ``meta`` dict.

    Every operation returns a new graph.  ``seq`` is insertion order, which
    decides between equal choices in traversals.  Parallel edges and loops are
    allowed; edges may dangle, traversals stay inside the graph.

    ``edges`` may be a function that makes them when they are first asked for.
    ``leaving`` is ``out_edges`` of a source that can find a few ids' edges
    without placing all edges.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame | Callable[[], DataFrame], meta: dict[str, Any] | None = None, handlers: Any = None, leaving: Callable[[DataFrame, bool], DataFrame] | None = None):
        self.nodes, self._edges, self.leaving, self.meta = nodes, edges, leaving, dict(meta or {})
        if handlers is None:
            from .operators.mutate import Handlers

            handlers = Handlers()
        self.handlers = handlers

    @property
    def edges(self) -> DataFrame:
        if not isinstance(self._edges, DataFrame):
            self._edges = self._edges()
        return self._edges

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def replace(self, nodes: DataFrame | None = None, edges: DataFrame | Callable[[], DataFrame] | None = None, meta: dict[str, Any] | None = None) -> PropertyGraph:
        leaving = self.leaving if edges is None else None
        return PropertyGraph(self.nodes if nodes is None else nodes, self._edges if edges is None else edges, self.meta if meta is None else meta, self.handlers, leaving)

    # construction

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    @classmethod
    def from_records(cls, spark: SparkSession, nodes: list[tuple[str, dict[str, Any] | None]], edges: list[tuple] = (), meta: dict[str, Any] | None = None) -> PropertyGraph:
        """From (id, attr) and (src, dst, attr[, id]), or Node and Edge, in insertion order, dynamic layout."""
        nodes = [(n.id, n.attr) if isinstance(n, Node) else n for n in nodes]
        edges = [(e.src, e.dst, e.attr, e.id) if isinstance(e, Edge) else e for e in edges]
        rows = [(i, encode_map(a), {}) for i, a in nodes]
        links = [(e[3] if len(e) > 3 else None, e[0], e[1], encode_map(e[2] if len(e) > 2 else None), {}, k) for k, e in enumerate(edges)]
        return cls(spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES), meta)

    def from_nodes(self, ids: list[str] | DataFrame, ranked: bool = False) -> PropertyGraph:
        """The nodes named, with all their out-edges, which may dangle; ``ranked`` keeps their order as ``rank``."""
        if isinstance(ids, DataFrame):
            named = ids
        else:
            named = self.spark.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids))], "id string, rank long")
        plain = self.nodes.drop("rank") if ranked else self.nodes
        nodes = plain.join(named.select("id", "rank"), "id") if ranked else plain.join(named.select("id"), "id", "left_semi")
        return self.replace(nodes, self.edges.join(named.select(F.col("id").alias("src")), "src", "left_semi").select(self.edges.columns))

    def validate(self) -> PropertyGraph:
        """ValueError if an edge names a node that is not there, or an id is there twice."""
        twice = self.nodes.groupBy("id").count().where("count > 1").first()
        if twice:
            raise ValueError(f"Node with id '{twice.id}' already exists")
        for side, word in (("src", "From"), ("dst", "To")):
            lost = self.edges.join(self.nodes.select(F.col("id").alias(side)), side, "left_anti").first()
            if lost:
                raise ValueError(f"{word} node with id '{lost[side]}' not found")
        return self

    # lookup and metadata

    def get_node(self, node_id: str) -> dict[str, Any]:
        row = self.nodes.where(F.col("id") == node_id).first()
        if row is None:
            raise KeyError(node_id)
        return {"id": row.id, "attr": decode_attr(row.attr)}

    __getitem__ = get_node

    def node(self, node_id: str) -> NodeRef:
        """A handle for calls that start at a node; KeyError if it is not there."""
        if not self.has_node(node_id):
            raise KeyError(node_id)
        return NodeRef(self, node_id)

    def has_node(self, node_id: Any) -> bool:
        if isinstance(node_id, (NodeRef, dict)):
            node_id = node_id["id"] if isinstance(node_id, dict) else node_id.id
        return isinstance(node_id, str) and not self.nodes.where(F.col("id") == node_id).limit(1).isEmpty()

    __contains__ = has_node

    def keys(self) -> DataFrame:
        return self.nodes.select("id")

    def node_count(self) -> int:
        return self.nodes.count()

    __len__ = node_count

    def edge_count(self) -> int:
        return self.edges.count()

    def __iter__(self) -> Iterator[dict[str, Any]]:
        for row in self.nodes.toLocalIterator():
            yield {"id": row.id, "attr": decode_attr(row.attr)}

    def metadata(self) -> DataFrame:
        """node_count, edge_count and average_degree, lazily."""
        counts = self.nodes.agg(F.count("*").alias("node_count")).withColumn("_k", F.lit(1)).join(self.edges.agg(F.count("*").alias("edge_count")).withColumn("_k", F.lit(1)), "_k")
        average = F.when(F.col("node_count") == 0, F.lit(0.0)).otherwise(F.col("edge_count") / F.greatest("node_count", F.lit(1)))
        return counts.select("node_count", "edge_count", average.alias("average_degree"))

    def get_metadata(self, ids: bool = True) -> dict[str, Any]:
        out = self.metadata().first().asDict()
        if ids:
            out["node_ids"] = [r.id for r in self.nodes.select("id").toLocalIterator()]
        return out

    def __repr__(self) -> str:
        return f"PropertyGraph({', '.join(r.id for r in self.nodes.select('id').limit(20).collect())})"

    def edge_texts(self) -> DataFrame:
        """One line an edge: ``type: src --> dst``."""
        kind = F.coalesce(Attributes(self.edges.schema).text("type"), F.lit("unknown"))
        return self.edges.select("seq", F.format_string("%s: %s --> %s", kind, "src", "dst").alias("text"))

    # neighbourhood features

    def adjacency(self, inverse: bool = False) -> DataFrame:
        """Node id and its out- (or in-) edges in insertion order."""
        at, other = ("dst", "src") if inverse else ("src", "dst")
        lists = self.edges.groupBy(F.col(at).alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", F.col(other).alias("other"), F.col("id").alias("edge_id")))).alias("edges"))
        return self.nodes.select("id").join(lists, "id", "left").withColumn("edges", F.coalesce("edges", F.array().cast(lists.schema["edges"].dataType)))

    def degrees(self) -> DataFrame:
        """id, degree, in_degree (parallel edges count) and neighbors (distinct targets)."""
        pairs = self.edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
        out = pairs.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("degree"), F.count("*").alias("neighbors"))
        into = self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return self.nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", zero("degree"), zero("in_degree"), zero("neighbors"))

    def with_features(self, needs: set[tuple[str, ...]]) -> DataFrame:
        """Nodes with the features that a predicate used."""
        df, e = self.nodes, self.edges
        for need in sorted(needs):
            if need[0] in ("degree", "in_degree"):
                counts = e.groupBy(F.col("src" if need[0] == "degree" else "dst").alias("id")).agg(F.count("*").alias("_n"))
                df = df.join(counts, "id", "left").withColumn(f"_f_{need[0]}", F.coalesce("_n", F.lit(0))).drop("_n")
            elif need[0] == "neighbor_ids":
                # a source's edges are brought together first: sets made before the shuffle hold a whole split and shrink little
                sets = e.select(F.col("src").alias("id"), "dst").repartition("id").groupBy("id").agg(F.collect_set("dst").alias("_n"))
                df = df.join(sets, "id", "left").withColumn("_f_neighbor_ids", F.coalesce("_n", F.array().cast("array<string>"))).drop("_n")
            else:
                at, other = ("src", "dst") if need[0] == "to" else ("dst", "src")
                hit = e.where(F.col(other) == need[1]).select(F.col(at).alias("id")).distinct().withColumn("_n", F.lit(True))
                df = df.join(hit, "id", "left").withColumn(feature_name(*need), F.coalesce("_n", F.lit(False))).drop("_n")
        return df

    # filters

    def where_nodes(self, predicate: Callable | Column) -> DataFrame:
        """Nodes that satisfy a predicate; a Python callable over NodeView where it gives no Column."""
        if isinstance(predicate, Column):
            return self.nodes.where(F.coalesce(predicate, F.lit(False)))
        n = NodeExpr(Attributes(self.nodes.schema))
        kept = as_column(predicate, n)
        if kept is not None:
            return self.with_features(n.needs).where(F.coalesce(kept.cast("boolean"), F.lit(False))).select(self.nodes.columns)
        from .functions.views import node_filter

        return node_filter(self, predicate)

    def where_edges(self, wanted: dict[str, Any] | Callable | Column | None) -> DataFrame:
        if wanted is None:
            return self.edges
        a = Attributes(self.edges.schema)
        if isinstance(wanted, Column):
            return self.edges.where(F.coalesce(wanted, F.lit(False)))
        if isinstance(wanted, dict):
            return self.edges.where(has_all(a, wanted))
        if isinstance(wanted, tuple):  # criteria, and a callable for the rest
            return self.replace(edges=self.where_edges(wanted[0])).where_edges(wanted[1])
        e = EdgeExpr(a, self.nodes.schema["attr"].dataType)
        kept = as_column(wanted, e)
        if kept is not None:
            edges = self.edges
            for side in sorted(e.needs):
                edges = edges.join(self.nodes.select(F.col("id").alias(side), F.col("attr").alias(f"_{side}_attr")), side, "left")
            return edges.where(F.coalesce(kept, F.lit(False))).select(self.edges.columns)
        from .functions.views import edge_filter

        return edge_filter(self, wanted)

    def filter(self, predicate: Callable | Column | None = None, **wanted: Any) -> PropertyGraph:
        """Induced subgraph of the nodes that match a predicate, ids, an id, or attribute values."""
        if predicate is not None and wanted:
            raise ValueError("give a predicate or keyword criteria, not both")
        if predicate is None and not wanted:
            raise ValueError("a predicate or keyword criteria are needed")
        if predicate is not None:
            return self._among(self.where_nodes(predicate))
        if "ids" in wanted or "id" in wanted:
            ids = list(dict.fromkeys(wanted["ids"] if "ids" in wanted else [wanted["id"]]))
            named = self.spark.createDataFrame([(i,) for i in ids], "id string")
            lost = named.join(self.nodes, "id", "left_anti").first()
            if lost:
                raise ValueError(f"Node with id '{lost.id}' not found")
            return self.induced(named)
        return self._among(self.nodes.where(has_all(Attributes(self.nodes.schema), wanted)))

    def induced(self, ids: DataFrame) -> PropertyGraph:
        """Nodes named in ``ids`` and the edges between them."""
        return self._among(self.nodes.join(ids.select("id"), "id", "left_semi"))

    def _among(self, nodes: DataFrame) -> PropertyGraph:
        """Some of the nodes and the edges between them; their ids are written once, when the edges are first asked for."""

        @cache
        def edges() -> DataFrame:
            ids = keep(nodes.select("id"), "ids")
            return self.out_edges(ids).join(hint(ids).select(F.col("id").alias("dst")), "dst", "left_semi").select(self.edges.columns)

        return self.replace(nodes, edges)

    def out_edges(self, ids: DataFrame, placed: bool = True) -> DataFrame:
        """The edges whose source is in ``ids``, a kept table; without ``placed`` nobody will ask for their ``seq``."""
        if self.leaving is not None:
            return self.leaving(ids, placed)
        return self.edges.join(hint(ids).select(F.col("id").alias("src")), "src", "left_semi").select(self.edges.columns)

    def prune(self) -> tuple[PropertyGraph, int]:
        """Without dangling edges, and how many ends were cut: out-edges whose target and in-edges whose source is absent."""
        return self.replace(edges=self._inner_edges()), self.dangling().count()

    def dangling(self) -> DataFrame:
        """A row for each end to cut, of edges with one end in the graph."""
        ids = self.nodes.select("id")
        out = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select("seq", "src", "dst")
        into = self.edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").join(ids.select(F.col("id").alias("src")), "src", "left_anti").select("seq", "src", "dst")
        return out.unionByName(into)

    def _inner_edges(self) -> DataFrame:
        ids = self.nodes.select("id")
        return self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(self.edges.columns)

    # operators that live in modules of their own

    def traverse(self, start: str, depth: int | None = None, filter: Any = None, edge_filter: Callable | None = None) -> PropertyGraph:  # noqa: A002
        from .operators.traverse import dfs

        return dfs(self, start, depth, one_filter(filter, edge_filter))

    def bfs(self, start: str, depth: int | None = None, filter: Any = None, edge_filter: Callable | None = None, ordered: bool = True) -> PropertyGraph:  # noqa: A002
        from .operators.traverse import bfs

        return bfs(self, start, depth, one_filter(filter, edge_filter), ordered)

    def bfs_search(self, start: str, target: str, depth: int | None = None, filter: Any = None, edge_filter: Callable | None = None) -> dict[str, Any] | None:  # noqa: A002
        from .operators.traverse import bfs_search

        return bfs_search(self, start, target, depth, one_filter(filter, edge_filter))

    def shortest_path_bfs(self, root: str, target: str, max_depth: int | None = None) -> PropertyGraph:
        from .operators.traverse import shortest_path

        return shortest_path(self, root, target, max_depth)

    def expand(self, source: PropertyGraph, depth: int = 1) -> PropertyGraph:
        from .operators.traverse import expand

        return expand(self, source, depth)

    def random_walks(self, start: str | None = None, max_length: int = 10, num_attempts: int = 10, **options: Any) -> DataFrame:
        from .operators.walks import random_walks

        return random_walks(self, start, max_length, num_attempts, **options)


def kept(graph: PropertyGraph) -> PropertyGraph:
    """The graph with its tables written once, for those that go through them several times."""
    return graph.replace(keep(graph.nodes, "nodes"), keep(graph.edges, "edges"))


def one_filter(wanted: Any, edge_filter: Callable | None) -> Any:
    """A single edge criterion from the two arguments."""
    if edge_filter is None:
        return wanted
    if wanted is None:
        return edge_filter
    if not isinstance(wanted, dict):
        raise ValueError("give one callable, as filter or as edge_filter")
    return wanted, edge_filter


class NodeRef:
    """A node of a graph, for calls that start there."""

    def __init__(self, graph: PropertyGraph, node_id: str):
        self.graph, self.id = graph, node_id

    def attr_get(self, key: str) -> Any:
        return self.graph.get_node(self.id)["attr"].get(key)

    def edges(self) -> DataFrame:
        return self.graph.edges.where(F.col("src") == self.id).orderBy("seq")

    def inverse_edges(self) -> DataFrame:
        return self.graph.edges.where(F.col("dst") == self.id).orderBy("seq")

    def traverse(self, depth: int | None = None, filter: Any = None, edge_filter: Callable | None = None) -> PropertyGraph:  # noqa: A002
        return self.graph.traverse(self.id, depth, filter, edge_filter)

    def bfs(self, depth: int | None = None, filter: Any = None, edge_filter: Callable | None = None) -> PropertyGraph:  # noqa: A002
        return self.graph.bfs(self.id, depth, filter, edge_filter)

    def bfs_search(self, target: str, depth: int | None = None, filter: Any = None, edge_filter: Callable | None = None) -> dict[str, Any] | None:  # noqa: A002
        return self.graph.bfs_search(self.id, target, depth, filter, edge_filter)

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, NodeRef) and other.id == self.id

    def __hash__(self) -> int:
        return hash(self.id)

    def __repr__(self) -> str:
        return self.id


@dataclass
class Node:
    """A node by itself, to build graphs from."""

    id: str
    attr: dict[str, Any] = field(default_factory=dict)
    meta: dict[str, Any] = field(default_factory=dict)

    def to_json(self) -> dict[str, Any]:
        return {"id": self.id, "attr": dict(self.attr), "meta": dict(self.meta)}

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, Node) and other.id == self.id

    def __hash__(self) -> int:
        return hash(self.id)


@dataclass
class Edge:
    """An edge by itself, to build graphs from."""

    src: str
    dst: str
    attr: dict[str, Any] = field(default_factory=dict)
    id: str | None = None
    meta: dict[str, Any] = field(default_factory=dict)

    def to_json(self) -> dict[str, Any]:
        return {"id": self.id, "from_id": self.src, "to_id": self.dst, "attr": dict(self.attr), "meta": dict(self.meta)}


class Path:
    """A list of node ids."""

    def __init__(self, nodes: list[str]):
        self.nodes = list(nodes)

    def to_json(self) -> list[str]:
        return list(self.nodes)

    def __repr__(self) -> str:
        return f"Path([{', '.join(self.nodes)}])"


