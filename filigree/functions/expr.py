"""Predicates over nodes and edges as Column expressions with Python's two-valued logic.

``==`` and ``!=`` are null-safe and every comparison yields true or false, so
a predicate keeps what the same Python lambda would keep.  Ordering against an
absent value is false (Python would raise).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Attributes, number


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class Value:
    """An attribute, or a default where its key is absent."""

    def __init__(self, attributes: Attributes, key: str, default: Any = None):
        self.a, self.key, self.default = attributes, key, default

    def _plain(self, like: Any) -> Column:
        """The value as a column comparable with ``like``."""
        at = self.a.get(self.key)
        if self.a.dynamic:
            at = at["s"] if isinstance(like, str) else number(at)
        return at if self.default is None else F.when(self.a.has(self.key), at).otherwise(F.lit(self.default))

    def __eq__(self, other: Any) -> Column:  # type: ignore[override]
        same = self.a.equals(self.key, other)
        if self.default is None:
            return same
        return F.when(self.a.has(self.key), same).otherwise(F.lit(self.default == other))

    def __ne__(self, other: Any) -> Column:  # type: ignore[override]
        return ~(self == other)

    def __lt__(self, other: Any) -> Column:
        return _sure(self._plain(other) < other)

    def __le__(self, other: Any) -> Column:
        return _sure(self._plain(other) <= other)

    def __gt__(self, other: Any) -> Column:
        return _sure(self._plain(other) > other)

    def __ge__(self, other: Any) -> Column:
        return _sure(self._plain(other) >= other)

    __hash__ = None  # type: ignore[assignment]

    def contains(self, member: Any) -> Column:
        return contains(self.a, self.key, member)

    def startswith(self, text: str) -> Column:
        return _sure(self.a.text(self.key).startswith(text))

    def endswith(self, text: str) -> Column:
        return _sure(self.a.text(self.key).endswith(text))

    def isin(self, *values: Any) -> Column:
        options = values[0] if len(values) == 1 and isinstance(values[0], (list, set, tuple)) else values
        return reduce(lambda x, y: x | y, (self == v for v in options), F.lit(False))

    def is_none(self) -> Column:
        return self == None  # noqa: E711

    @property
    def column(self) -> Column:
        return self._plain("") if isinstance(self.a.type_of(self.key), T.StringType) else self.a.get(self.key)

    def __bool__(self) -> bool:
        raise TypeError("a Value stands for many rows")


class NodeExpr:
    """What a node predicate gets; features of the neighbourhood are joined only if used."""

    def __init__(self, attributes: Attributes):
        self._a, self.needs = attributes, set()

    @property
    def id(self) -> Column:
        return F.col("id")

    @property
    def type(self) -> Value:
        return Value(self._a, "type")

    @property
    def attrs(self) -> Column:
        return F.col("attr")

    @property
    def meta(self) -> Column:
        return F.col("meta")

    def attr(self, key: str, default: Any = None) -> Value:
        return Value(self._a, key, default)

    def has_attr(self, key: str) -> Column:
        return self._a.has(key)

    def _feature(self, *need: str) -> Column:
        self.needs.add(need)
        return F.col("_".join(("_f", *need)) if len(need) == 1 else feature_name(*need))

    @property
    def degree(self) -> Column:
        return self._feature("degree")

    @property
    def in_degree(self) -> Column:
        return self._feature("in_degree")

    @property
    def neighbor_ids(self) -> Column:
        return self._feature("neighbor_ids")

    def has_edge_to(self, other: str) -> Column:
        return self._feature("to", other)

    def has_edge_from(self, other: str) -> Column:
        return self._feature("from", other)

    def __bool__(self) -> bool:
        raise TypeError("a NodeExpr stands for many rows")


def feature_name(kind: str, other: str) -> str:
    return f"_f_{kind}_{other.encode().hex()}"


class EndExpr:
    """The node at an end of an edge."""

    def __init__(self, side: str, kind: T.DataType):
        self.id = F.col(side)
        self._a = Attributes(T.StructType([T.StructField(f"_{side}_attr", kind)]), f"_{side}_attr")

    @property
    def type(self) -> Value:
        return Value(self._a, "type")

    def attr(self, key: str, default: Any = None) -> Value:
        return Value(self._a, key, default)

    def has_attr(self, key: str) -> Column:
        return self._a.has(key)


class EdgeExpr:
    """What an edge predicate gets; its ends' nodes are joined only if used."""

    def __init__(self, attributes: Attributes, nodes: T.DataType | None = None):
        self._a, self._nodes, self.needs = attributes, nodes, set()

    def _end(self, side: str) -> EndExpr:
        if self._nodes is None:
            raise AttributeError("no nodes are known here")
        self.needs.add(side)
        return EndExpr(side, self._nodes)

    @property
    def from_node(self) -> EndExpr:
        return self._end("src")

    @property
    def to_node(self) -> EndExpr:
        return self._end("dst")

    id, from_id, to_id = (property(lambda self, c=c: F.col(c)) for c in ("id", "src", "dst"))

    @property
    def type(self) -> Value:
        return Value(self._a, "type")

    @property
    def attrs(self) -> Column:
        return F.col("attr")

    def attr(self, key: str, default: Any = None) -> Value:
        return Value(self._a, key, default)

    def has_attr(self, key: str) -> Column:
        return self._a.has(key)

    def __bool__(self) -> bool:
        raise TypeError("an EdgeExpr stands for many rows")


Predicate = Callable[[Any], Any]


def as_column(predicate: Callable, row: NodeExpr | EdgeExpr) -> Column | None:
    """What the predicate says of all rows at once, or None where it needs real values.

    That is where it asks a Column or a Value for its truth, type or content.
    Anything else that it raises, such as a name it spells wrongly, is an error.
    """
    from .views import EdgeView, NodeView

    try:
        kept = predicate(row)
    except AttributeError as e:
        view = NodeView if isinstance(e.obj, (NodeExpr, EndExpr)) else EdgeView if isinstance(e.obj, EdgeExpr) else None
        if not (isinstance(e.obj, (Value, Column)) or view and (hasattr(view, e.name) or e.name in ("edges", "inverse_edges", "node"))):
            raise
        return None
    except (TypeError, ValueError):  # PySpark's own is a ValueError
        return None
    return kept if isinstance(kept, Column) else None


def contains(a: Any, key: str, member: Any) -> Any:
    """Python's ``in``: list membership, substring, or key of a dict; false for anything else."""
    if not isinstance(a, Attributes):
        return a.contains(key, member)
    at = a.get(key)
    if not a.dynamic:
        kind = a.type_of(key)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType) == isinstance(member, str):
            return _sure(F.array_contains(at, member))
        if isinstance(kind, T.StringType) and isinstance(member, str):
            return _sure(F.contains(at, F.lit(member)))
        if isinstance(kind, T.MapType):
            return _sure(F.map_contains_key(at, member))
        return F.lit(False)
    items = F.from_json(at["j"], "array<string>")
    keys = F.json_object_keys(at["j"])
    if isinstance(member, str):
        # elements keep their JSON text only if they are no strings, so quotes tell "1" from 1
        quoted = F.lit(__import__("json").dumps(member, ensure_ascii=False))
        inside = F.array_contains(items, member) & F.contains(at["j"], quoted)
        return _sure(F.when(at["t"] == "List", inside).when(at["t"] == "String", F.contains(at["s"], F.lit(member))).when(at["t"] == "Dict", F.array_contains(keys, member)))
    numbers = F.transform(items, lambda x: F.when(x == "true", 1.0).when(x == "false", 0.0).otherwise(x.try_cast("double")))
    return _sure(F.when(at["t"] == "List", F.array_contains(numbers, F.lit(float(member))))) if isinstance(member, (bool, int, float)) else F.lit(False)


def attr_equals(key: str, value: Any) -> Predicate:
    return lambda n: n._a.equals(key, value)


def attr_contains(key: str, member: Any) -> Predicate:
    return lambda n: contains(n._a, key, member)


def _joined(verdicts: list, column: Callable, plain: Callable, empty: bool) -> Any:
    """Of real rows a bool, of all rows a Column."""
    return plain(verdicts) if verdicts and all(isinstance(v, bool) for v in verdicts) else reduce(column, verdicts, F.lit(empty))


def p_and(*parts: Predicate) -> Predicate:
    return lambda n: _joined([p(n) for p in parts], lambda x, y: x & y, all, True)


def p_or(*parts: Predicate) -> Predicate:
    return lambda n: _joined([p(n) for p in parts], lambda x, y: x | y, any, False)


def p_not(part: Predicate) -> Predicate:
    def negated(n: Any) -> Any:
        verdict = part(n)
        return not verdict if isinstance(verdict, bool) else ~_sure(verdict)

    return negated


def has_all(a: Attributes, wanted: dict[str, Any]) -> Column:
    """Every key present and equal."""
    return reduce(lambda x, y: x & y, (a.equals(k, v) & (a.has(k) if a.dynamic or v is not None else F.lit(True)) for k, v in wanted.items()), F.lit(True))
