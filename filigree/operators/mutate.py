"""Batch changes to a graph, the change feed they give, and the handlers that watch it.

Graphs are immutable: a change returns a new graph.  Handlers get the delta as
a DataFrame; one that returns exactly False stops the handlers after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import PropertyGraph
from ..schema import EDGES, NODES, VALUE, Attributes, encode, encode_map


@dataclass
class Handlers:
    """Chains of handlers, shared by a graph and all graphs made from it."""

    node_add: list[Callable] = field(default_factory=list)
    edge_add: list[Callable] = field(default_factory=list)
    node_update: list[Callable] = field(default_factory=list)
    edge_update: list[Callable] = field(default_factory=list)

    def fire(self, kind: str, graph: PropertyGraph, delta: DataFrame) -> None:
        for handler in getattr(self, kind):
            if handler(graph, delta) is False:
                break


def _rows(graph: PropertyGraph, rows: Any, schema: T.StructType) -> DataFrame:
    return rows if isinstance(rows, DataFrame) else graph.spark.createDataFrame(rows, schema)


def add_nodes(graph: PropertyGraph, rows: DataFrame | list[tuple[str, dict[str, Any] | None]], validate: bool = True) -> PropertyGraph:
    """With more nodes; ValueError for an id that is there already or twice among the new."""
    if not isinstance(rows, DataFrame):
        rows = _rows(graph, [(r[0], encode_map(r[1] if len(r) > 1 else None), {}) for r in rows], NODES)
    if validate:
        twice = rows.groupBy("id").count().where("count > 1").select("id").unionAll(rows.select("id").join(graph.nodes.select("id"), "id", "left_semi")).first()
        if twice:
            raise ValueError(f"Node with id '{twice.id}' already exists")
    out = graph.replace(graph.nodes.unionByName(rows, allowMissingColumns=True))
    graph.handlers.fire("node_add", out, rows)
    return out


def add_edges(graph: PropertyGraph, rows: DataFrame | list[tuple], validate: bool = True) -> PropertyGraph:
    """With more edges, after those there are; ValueError for an unknown end."""
    if not isinstance(rows, DataFrame):
        rows = _rows(graph, [(None, r[0], r[1], encode_map(r[2] if len(r) > 2 else None), {}, k) for k, r in enumerate(rows)], EDGES)
    if validate:
        ends = rows.select(F.col("src").alias("id")).unionAll(rows.select(F.col("dst").alias("id"))).distinct()
        lost = ends.join(graph.nodes.select("id"), "id", "left_anti").first()
        if lost:
            raise ValueError(f"Node with id '{lost.id}' not found")
    last = graph.edges.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("n")).first().n
    if "seq" in rows.columns:
        rows = rows.withColumn("seq", F.col("seq") + last + 1)
    else:
        rows = rows.withColumn("seq", F.monotonically_increasing_id() + last + 1)
    out = graph.replace(edges=graph.edges.unionByName(rows, allowMissingColumns=True))
    graph.handlers.fire("edge_add", out, rows)
    return out


def _update(table: DataFrame, key: str, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of changes (key, name, value, at), applied in order of ``at``: the new table and the change feed."""
    a = Attributes(table.schema)
    names = [r.name for r in changes.select("name").distinct().orderBy("name").collect()]  # attribute names, few by nature
    order = Window.partitionBy(key, "name").orderBy("at")
    if a.dynamic:
        old = table.select(key, F.explode(F.map_entries("attr")).alias("e")).select(key, F.col("e.key").alias("name"), F.col("e.value").alias("was"))
    else:
        parts = [table.select(key, F.lit(n).alias("name"), a.get(n).alias("was")) for n in names if n in a.kind.names]
        old = parts[0] if parts else None
        for p in parts[1:]:
            old = old.unionByName(p)
    steps = changes.join(table.select(key), key, "left_semi")
    steps = steps.join(old, [key, "name"], "left") if old is not None else steps.withColumn("was", F.lit(None).cast(changes.schema["value"].dataType))
    before = F.when(F.row_number().over(order) == 1, F.col("was")).otherwise(F.lag("value").over(order))
    fresh = F.row_number().over(order) == 1
    absent = fresh & F.col("was").isNull()
    feed = steps.select(key, "name", F.col("value").alias("new"), before.alias("old"), "at", absent.alias("_absent"))
    feed = feed.where(~_same(a, "new", "old") | F.col("_absent")).select(key, "name", "new", "old", "at")
    last = changes.groupBy(key, "name").agg(F.max_by("value", "at").alias("value"))
    if a.dynamic:
        new = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_new"))
        merged = F.map_concat(F.map_filter("attr", lambda k, v: ~F.map_contains_key(F.col("_new"), k)), "_new")
        out = table.join(new, key, "left").withColumn("attr", F.when(F.col("_new").isNull(), F.col("attr")).otherwise(merged)).drop("_new")
    else:
        wide = last.groupBy(key).agg(
            *(F.max_by("value", (F.col("name") == n).cast("int")).alias(f"_v_{n}") for n in names), *(F.max((F.col("name") == n).cast("int")).alias(f"_h_{n}") for n in names)
        )
        out = table.join(wide, key, "left")
        for n in names:
            value = F.when(F.col(f"_h_{n}") == 1, F.col(f"_v_{n}")).otherwise(a.get(n) if n in a.kind.names else F.lit(None).cast(changes.schema["value"].dataType))
            out = out.withColumn("attr", F.col("attr").withField(n, value))
        out = out.select(table.columns)
    return out.select(table.columns), feed


def _same(a: Attributes, x: str, y: str) -> Any:
    """Python's ``==`` of two stored values, never null."""
    if not a.dynamic:
        return F.col(x).eqNullSafe(F.col(y))
    from ..schema import number

    u, v = F.col(x), F.col(y)
    numbers = number(u).isNotNull() & (number(u) == number(v))
    text = (u["t"] == v["t"]) & (u["s"].eqNullSafe(v["s"])) & (u["j"].eqNullSafe(v["j"])) & number(u).isNull() & number(v).isNull()
    return F.coalesce(numbers, F.lit(False)) | F.coalesce(text, F.lit(False))


def update_nodes(graph: PropertyGraph, changes: DataFrame | list[tuple[str, str, Any]]) -> tuple[PropertyGraph, DataFrame]:
    """Set attributes of nodes; the feed has what changed: id, name, new, old, at."""
    changes = changes if isinstance(changes, DataFrame) else _changes(graph, changes, "id")
    table, feed = _update(graph.nodes, "id", changes)
    out = graph.replace(table)
    graph.handlers.fire("node_update", out, feed)
    return out, feed


def update_edges(graph: PropertyGraph, changes: DataFrame | list[tuple[int, str, Any]]) -> tuple[PropertyGraph, DataFrame]:
    """Set attributes of edges, which ``seq`` names."""
    changes = changes if isinstance(changes, DataFrame) else _changes(graph, changes, "seq")
    table, feed = _update(graph.edges, "seq", changes)
    out = graph.replace(edges=table)
    graph.handlers.fire("edge_update", out, feed)
    return out, feed


def _changes(graph: PropertyGraph, changes: list[tuple], key: str) -> DataFrame:
    schema = T.StructType([T.StructField(key, T.StringType() if key == "id" else T.LongType()), T.StructField("name", T.StringType()), T.StructField("value", VALUE), T.StructField("at", T.LongType())])
    return graph.spark.createDataFrame([(k, n, encode(v), i) for i, (k, n, v) in enumerate(changes)], schema)


def list_append(graph: PropertyGraph, key: str, values: DataFrame) -> PropertyGraph:
    """Append ``values(id, value)`` to the list attribute ``key``, in order of ``at`` if there is one; no handlers.

    An absent list is created; TypeError if some value there is no list.
    """
    a = Attributes(graph.nodes.schema)
    order = F.col("at") if "at" in values.columns else F.lit(0)
    if a.dynamic:
        if not graph.nodes.join(values, "id", "left_semi").where(a.has(key) & (a.get(key)["t"] != "List")).isEmpty():
            raise TypeError(f"attribute '{key}' is not a list")
        text = F.to_json(F.array("value")) if not isinstance(values.schema["value"].dataType, T.StructType) else F.to_json(F.array(F.coalesce("value.s", F.col("value.i").cast("string"))))
        inner = F.expr("substring(_j, 2, length(_j) - 2)")
        more = values.withColumn("_j", text).select("id", order.alias("at"), inner.alias("_x")).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "_x"))), lambda r: r["_x"]), ", ").alias("_x"))
        old = F.coalesce(a.get(key)["j"], F.lit("[]"))
        joined = F.when(old == "[]", F.concat(F.lit("["), "_x", F.lit("]"))).otherwise(F.concat(F.expr(f"substring(attr['{key}'].j, 1, length(attr['{key}'].j) - 1)"), F.lit(", "), "_x", F.lit("]")))
        value = F.struct(F.lit("List").alias("t"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("b"), joined.alias("j"))
        merged = F.map_concat(F.map_filter("attr", lambda k, v: k != key), F.create_map(F.lit(key), value))
        nodes = graph.nodes.join(more, "id", "left").withColumn("attr", F.when(F.col("_x").isNull(), F.col("attr")).otherwise(merged)).drop("_x")
    else:
        kind = a.type_of(key)
        if kind is not None and not isinstance(kind, T.ArrayType):
            raise TypeError(f"attribute '{key}' is not a list")
        more = values.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("at"), "value"))), lambda r: r["value"]).alias("_x"))
        empty = F.array().cast(more.schema["_x"].dataType)
        old = F.coalesce(a.get(key), empty) if kind is not None else empty
        nodes = graph.nodes.join(more, "id", "left").withColumn("attr", F.col("attr").withField(key, F.when(F.col("_x").isNull(), a.get(key) if kind is not None else F.lit(None).cast(more.schema["_x"].dataType)).otherwise(F.concat(old, "_x")))).drop("_x")
    return graph.replace(nodes.select(graph.nodes.columns))


class ObservedDictionary:
    """A small string-keyed map of one owner; callbacks of a key get (owner, key, new, old) when its value changes."""

    def __init__(self, owner: Any, callbacks: dict[str, list[Callable]] | None = None):
        self.owner, self.callbacks, self._values = owner, dict(callbacks or {}), {}

    def __setitem__(self, key: str, value: Any) -> None:
        absent = key not in self._values
        old = self._values.get(key)
        self._values[key] = value
        if absent or old != value:
            for call in self.callbacks.get(key, []):
                call(self.owner, key, value, old)

    def __getitem__(self, key: str) -> Any:
        return self._values[key]


def observed_changes(events: DataFrame, owner: str, key: str, value: str, order: str) -> DataFrame:
    """The same over a table of settings: those that differ from the one before of their owner and key."""
    before = Window.partitionBy(owner, key).orderBy(order)
    first = F.row_number().over(before) == 1
    old = F.lag(value).over(before)
    return events.select(owner, key, F.col(value).alias("new"), old.alias("old"), order, (first | ~F.col(value).eqNullSafe(old)).alias("_c")).where("_c").drop("_c")
