"""Fallback for predicates that are plain Python: rows become views, batches go through Arrow."""

from __future__ import annotations

import dis
from collections.abc import Callable, Iterator
from itertools import repeat
from types import CodeType, FunctionType
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..schema import decode_attr

if TYPE_CHECKING:
    from ..graph import PropertyGraph


class Plain:
    """Attributes of one row, for the predicates that also work on columns."""

    def __init__(self, attrs: dict[str, Any]):
        self.attrs = attrs

    def equals(self, key: str, value: Any) -> bool:
        return bool(self.attrs.get(key) == value)

    def has(self, key: str) -> bool:
        return key in self.attrs

    def contains(self, key: str, member: Any) -> bool:
        at = self.attrs.get(key)
        if isinstance(at, str):
            return isinstance(member, str) and member in at
        return isinstance(at, (list, tuple, set, dict)) and member in at


class NodeView:
    """A node as a predicate sees it, read-only."""

    def __init__(self, node_id: str, attrs: dict[str, Any], meta: dict[str, Any], out: list[str], into: list[str]):
        self.id, self.attrs, self.meta = node_id, attrs, meta
        self.edges, self.inverse_edges = out, into
        self._a = Plain(attrs)

    @property
    def node(self) -> NodeView:
        return self

    @property
    def type(self) -> Any:
        return self.attrs.get("type")

    @property
    def degree(self) -> int:
        return len(self.edges)

    @property
    def in_degree(self) -> int:
        return len(self.inverse_edges)

    @property
    def neighbor_ids(self) -> set[str]:
        return set(self.edges)

    def attr(self, key: str, default: Any = None) -> Any:
        return self.attrs.get(key, default)

    def has_attr(self, key: str) -> bool:
        return key in self.attrs

    def has_edge_to(self, other: str) -> bool:
        return other in self.edges

    def has_edge_from(self, other: str) -> bool:
        return other in self.inverse_edges

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, NodeView) and other.id == self.id

    def __hash__(self) -> int:
        return hash(self.id)

    def __repr__(self) -> str:
        return f"NodeView({self.id!r})"


class EdgeView:
    """An edge as a predicate sees it; its ends know their attributes, not their neighbours."""

    def __init__(self, edge_id: str | None, src: str, dst: str, attrs: dict[str, Any], ends: tuple[dict[str, Any], dict[str, Any]] | None = ({}, {})):
        self.id, self.from_id, self.to_id, self.attrs, self._ends = edge_id, src, dst, attrs, ends

    def _end(self, i: int) -> NodeView:
        if self._ends is None:
            raise RuntimeError("the predicate was taken not to ask for an edge's ends")
        return NodeView((self.from_id, self.to_id)[i], self._ends[i], {}, [], [])

    # made for predicates that ask for them: most look at few things, at many edges

    @property
    def from_node(self) -> NodeView:
        return self._end(0)

    @property
    def to_node(self) -> NodeView:
        return self._end(1)

    @property
    def _a(self) -> Plain:
        return Plain(self.attrs)

    @property
    def type(self) -> Any:
        return self.attrs.get("type")

    def attr(self, key: str, default: Any = None) -> Any:
        return self.attrs.get(key, default)

    def has_attr(self, key: str) -> bool:
        return key in self.attrs

    def __repr__(self) -> str:
        return f"EdgeView({self.from_id!r} -> {self.to_id!r})"


def _attrs(value: Any) -> dict[str, Any]:
    if isinstance(value, list):  # a map column
        value = dict(value)
    if isinstance(value, dict) and not all(isinstance(v, dict) and "t" in v and "j" in v for v in value.values()):
        return {k: v for k, v in value.items() if v is not None}
    return decode_attr(value)


def node_filter(graph: PropertyGraph, predicate: Callable[[NodeView], Any]) -> DataFrame:
    """Nodes for which ``predicate`` is truthy."""
    lists = [graph.edges.groupBy(F.col(a).alias("id")).agg(F.collect_list(b).alias(n)) for a, b, n in (("src", "dst", "_out"), ("dst", "src", "_in"))]
    rows = graph.nodes.join(lists[0], "id", "left").join(lists[1], "id", "left")
    columns = graph.nodes.columns
    at = {c: columns.index(c) for c in ("id", "attr", "meta") if c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n = len(part)
            read = lambda c, p=part, n=n: p.column(at[c]).to_pylist() if c in at else [None] * n
            lists = (part.column(len(columns) + k).to_pylist() for k in (0, 1))
            kept = [bool(predicate(NodeView(i, _attrs(a), _attrs(m), o or [], x or []))) for i, a, m, o, x in zip(read("id"), read("attr"), read("meta"), *lists)]
            yield part.select(range(len(columns))).filter(pa.array(kept, pa.bool_()))

    return rows.select(*columns, "_out", "_in").mapInArrow(run, graph.nodes.schema)


#: Builtins that get at no attribute by its name.
_PLAIN_CALLS = frozenset("abs all any bool dict enumerate float frozenset int isinstance len list max min range round set sorted str sum tuple zip".split())
_VALUES = (str, bytes, int, float, bool, type(None))


def _value(x: Any) -> bool:
    """Whether ``x`` is plain data, that can't ask an edge for anything."""
    if type(x) in (list, tuple, set, frozenset):
        return all(_value(v) for v in x)
    if type(x) is dict:
        return all(_value(v) for kv in x.items() for v in kv)
    return type(x) in _VALUES


def asks_for_ends(predicate: Callable) -> bool:
    """Whether a predicate may look at the nodes at an edge's ends; no only where its code shows all that it can reach."""
    if type(predicate) is not FunctionType or not _value([*(predicate.__defaults__ or ()), *(predicate.__kwdefaults__ or {}).values()]):
        return True
    try:
        if not all(_value(cell.cell_contents) for cell in predicate.__closure__ or ()):
            return True
    except ValueError:  # an empty cell
        return True
    codes = [predicate.__code__]
    for code in codes:
        codes += [c for c in code.co_consts if isinstance(c, CodeType)]
        for step in dis.get_instructions(code):
            name = step.argval
            if "IMPORT" in step.opname:
                return True
            if step.opname in ("LOAD_GLOBAL", "LOAD_NAME"):
                own = predicate.__globals__
                if not (_value(own[name]) if name in own else name in _PLAIN_CALLS):
                    return True
            elif "ATTR" in step.opname or "METHOD" in step.opname:
                if name in ("from_node", "to_node", "format", "format_map") or str(name).startswith("_"):
                    return True
    return False


def _dicts(column: pa.Array) -> list[dict[str, Any]]:
    """Attributes of a batch; the fields of a typed layout are read a column at a time."""
    if not pa.types.is_struct(column.type) or any(pa.types.is_struct(f.type) for f in column.type):
        return [_attrs(v) for v in column.to_pylist()]
    names = [f.name for f in column.type]
    return [{k: v for k, v in zip(names, row) if v is not None} for row in zip(*(c.to_pylist() for c in column.flatten()))]


def edge_filter(graph: PropertyGraph, predicate: Callable[[EdgeView], bool]) -> DataFrame:
    """Edges for which ``predicate`` is True; anything but a bool is an error.

    Only what the predicate may ask for goes to Python: other columns stay
    behind, and the nodes are joined only where it may look at an edge's ends.
    """
    ends = asks_for_ends(predicate)

    def kept(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for ids, src, dst, attr, *sides in batches:
            around = zip(*(_dicts(x) for x in sides)) if ends else repeat(None)
            verdicts = [predicate(EdgeView(*row)) for row in zip(ids.to_pylist(), src.to_pylist(), dst.to_pylist(), _dicts(attr), around)]
            if any(v is not True and v is not False for v in verdicts):
                raise TypeError("an edge predicate must return a bool")
            yield pa.array(verdicts, pa.bool_())

    wide = graph.edges
    for side in ("src", "dst") if ends else ():
        wide = wide.join(graph.nodes.select(F.col("id").alias(side), F.col("attr").alias(f"_{side}_attr")), side, "left")
    keeps = F.arrow_udf(kept, "boolean", ArrowUDFType.SCALAR_ITER)
    return wide.where(keeps("id", "src", "dst", "attr", *(f"_{side}_attr" for side in ("src", "dst") if ends))).select(graph.edges.columns)
