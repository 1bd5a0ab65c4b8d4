"""Random walks: uniform ones advance together, a join a step; visit-balanced ones are sequential.

Choices come from a hash of seed, attempt and step, so that a task that runs
twice walks the same way.  A walk stops where no edge is eligible; lengths
count nodes; equal walks are reported once, the earliest attempt's.
"""

from __future__ import annotations

import hashlib
import math
from bisect import insort
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import hint, keep, size
from ..schema import Attributes


def _check(graph: PropertyGraph, start: str | None, max_length: int, min_length: int, stratified: bool) -> None:
    if graph.nodes.isEmpty():
        raise ValueError("the graph has no nodes")
    if start is None and not stratified:
        raise ValueError("a start node is needed unless walks are stratified")
    if start is not None and not graph.has_node(start):
        raise ValueError(f"Node with id '{start}' not found")
    if max_length <= 0:
        raise ValueError("max_length must be positive")
    if min_length > max_length:
        raise ValueError("min_length must not exceed max_length")


def pick(seed: int, walk: Column, step: int, size: Column) -> Column:
    """A number under ``size`` from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), walk.cast("string"), F.lit(str(step)))), 1, 8), 16, 10).cast("long") % size


def random_walks(
    graph: PropertyGraph,
    start: str | None = None,
    max_length: int = 10,
    num_attempts: int = 10,
    min_length: int = 1,
    allow_revisit: bool = False,
    include_edge_types: bool = False,
    edge_type_field: str = "type",
    stratified: bool = False,
    mode: str = "exact",
    seed: int = 0,
) -> DataFrame:
    """(attempt, path, types, walk): ``walk`` interleaves nodes and edge types if asked, never ending with a type.

    ``stratified`` prefers nodes seldom visited, with weight 1 / (1 + visits),
    counted over all attempts: ``exact`` in one task; ``batched`` counts
    visits once a step over all walks at once, which scales and is an
    approximation.
    """
    _check(graph, start, max_length, min_length, stratified)
    kind = F.coalesce(Attributes(graph.edges.schema).text(edge_type_field), F.lit("unknown"))
    if stratified and mode == "exact":
        walks = _sequential(graph, kind, start, max_length, num_attempts, allow_revisit, seed)
    else:
        walks = _together(graph, kind, start, max_length, num_attempts, allow_revisit, seed, stratified)
    walks = walks.where(F.size("path") >= min_length)
    first = Window.partitionBy("path", *(["types"] if include_edge_types else [])).orderBy("attempt")
    walks = walks.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    mixed = F.flatten(F.zip_with("path", "types", lambda p, t: F.when(t.isNull(), F.array(p)).otherwise(F.array(p, t))))
    return walks.withColumn("walk", mixed if include_edge_types else F.col("path"))


def _together(graph: PropertyGraph, kind: Column, start: str | None, max_length: int, attempts: int, revisit: bool, seed: int, balanced: bool) -> DataFrame:
    spark = graph.spark
    begin = spark.range(attempts).select(F.col("id").alias("attempt"))
    if start is None:
        # no node has been visited yet: those of least hash, as many as there are walks, and round again
        by_hash = [F.xxhash64("id", F.lit(seed)), F.col("id")]
        first = graph.nodes.select("id").orderBy(*by_hash).limit(attempts)
        numbered = keep(first.select("id", (F.row_number().over(Window.orderBy(*by_hash)) - 1).alias("k")), "starts")  # a row a walk at most
        walks = begin.withColumn("k", F.col("attempt") % numbered.count()).join(numbered, "k").select("attempt", F.array("id").alias("path"), F.array().cast("array<string>").alias("types"))
    else:
        walks = begin.select("attempt", F.array(F.lit(start)).alias("path"), F.array().cast("array<string>").alias("types"))
    walks = keep(walks.withColumn("open", F.lit(True)), "walks")
    whole = None  # of a graph that can't find a node's edges without all of them, what a step needs is written once
    if max_length > 2 and graph.leaving is None:
        whole = graph.replace(edges=keep(graph.edges.select("src", "dst", "seq", kind.alias("kind")), "edges"))
    for step in range(1, max_length):
        ends = keep(walks.where("open").select(F.element_at("path", -1).alias("id")).distinct(), "ends")
        if not size(ends):
            break
        out = whole.out_edges(ends) if whole else graph.out_edges(ends).select("src", "dst", "seq", kind.alias("kind"))
        out = _inside(graph, keep(out, "out"))
        near = hint(walks).withColumn("src", F.when(F.col("open"), F.element_at("path", -1)))
        if balanced:
            visits = walks.select(F.explode("path").alias("dst")).groupBy("dst").agg(F.count("*").alias("v"))
            each = near.join(out, "src")
            if not revisit:
                each = each.where(~F.array_contains("path", F.col("dst")))
            each = each.select("attempt", F.struct("seq", "dst", "kind").alias("e"), "dst").join(visits, "dst", "left")
            # exponential race: the least of -log(u) * (1 + visits) wins with weight 1 / (1 + visits)
            u = (pick(seed, F.concat_ws("/", "attempt", F.col("e.seq")), step, F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
            chosen = each.groupBy("attempt").agg(F.min_by("e", -F.log(u) * (1 + F.coalesce("v", F.lit(0)))).alias("e"))
        else:
            # an end's edges are numbered once for all walks there; a walk steps over the numbers of those to nodes it has met
            out = keep(out.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("seq", "dst", "kind")) - 1), "numbered")
            choices = near.where("open").join(hint(keep(out.groupBy("src").agg(F.count("*").alias("n")), "sizes")), "src").select("attempt", "path", "src", "n")
            if revisit:
                choices = choices.withColumn("met", F.array().cast("array<int>"))
            else:
                # an end of many edges may be met by many walks, so what they have met is looked up from their side
                past = keep(near.where("open").select("attempt", "src", F.explode("path").alias("dst")).distinct(), "past")
                met = out.join(hint(past), ["src", "dst"]).groupBy("attempt").agg(F.sort_array(F.collect_list("r")).alias("met"))
                choices = choices.join(met, "attempt", "left").withColumn("met", F.coalesce("met", F.array().cast("array<int>")))
            left = F.col("n") - F.size("met")
            place = F.aggregate("met", pick(seed, F.col("attempt"), step, F.greatest(left, F.lit(1))).cast("int"), lambda at, x: F.when(x <= at, at + 1).otherwise(at))
            places = keep(choices.where(left > 0).select("attempt", "src", place.alias("r")), "places")
            chosen = out.join(hint(places), ["src", "r"]).select("attempt", F.struct("seq", "dst", "kind").alias("e"))
        go = F.col("e").isNotNull()
        walks = keep(
            walks.join(hint(keep(chosen, "chosen")), "attempt", "left").select(
                "attempt",
                F.when(go, F.concat("path", F.array("e.dst"))).otherwise(F.col("path")).alias("path"),
                F.when(go, F.concat("types", F.array("e.kind"))).otherwise(F.col("types")).alias("types"),
                go.alias("open"),
            ),
            "walks",
        )
    return walks.select("attempt", "path", "types")


def _inside(graph: PropertyGraph, out: DataFrame) -> DataFrame:
    """Edges of a kept table whose target is a node of the graph."""
    met = keep(out.select(F.col("dst").alias("id")).distinct(), "met")
    nodes = keep(graph.nodes.select("id").join(hint(met), "id", "left_semi"), "inside")
    return out.join(hint(nodes).select(F.col("id").alias("dst")), "dst", "left_semi")


def _numbered(graph: PropertyGraph) -> tuple[DataFrame, int]:
    """Ids with their number ``n`` in order, and how many there are; no task orders them all."""
    ids = keep(graph.nodes.select("id").distinct(), "ids")
    parts = min(1 + size(ids) // 200_000, 10_000)
    placed = keep(ids.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("place", F.monotonically_increasing_id()), "ordered")
    counts = sorted((r.part, r.rows) for r in placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("rows")).collect())  # a row a part
    before = [(part, sum(rows for _, rows in counts[:i])) for i, (part, _) in enumerate(counts)]
    first = graph.spark.createDataFrame(before, "part long, first long")
    at = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(first), "part")
    return at.select("id", (F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("n")), size(ids)


def _sequential(graph: PropertyGraph, kind: Column, start: str | None, max_length: int, attempts: int, revisit: bool, seed: int) -> DataFrame:
    """Each choice depends on all before it, so one task makes them all.

    It knows nodes by their numbers in order of ids and edges by their numbers
    at their source: 12 bytes an edge while they come in and four afterwards,
    and 20 a node; walks of one node need no edges.
    """
    names, total = _numbered(graph)
    names = keep(names, "names")
    first = names.where(F.col("id") == start).first().n if start is not None else None
    # a row that is no edge, so that the task has work where there are none
    rows = graph.spark.range(1).select(*(F.lit(-1).alias(c) for c in ("src", "r", "dst")))
    if max_length > 1:
        end = lambda side: hint(names).select(F.col("id").alias(side), F.col("n").alias(f"_{side}"))
        steps = graph.edges.select("src", "dst", "seq", kind.alias("kind")).join(end("dst"), "dst").join(end("src"), "src")
        r = F.row_number().over(Window.partitionBy("_src").orderBy("seq", "dst", "kind")) - 1
        steps = keep(steps.select(F.col("_src").cast("int").alias("src"), r.alias("r"), F.col("_dst").cast("int").alias("dst"), "kind"), "steps")
        rows = rows.unionByName(steps.select("src", "r", "dst"))

    def uniform(*parts: Any) -> float:
        return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:13], 16) / 16**13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sizes = [], np.zeros(total + 1, np.int64)
        for batch in batches:
            part = np.stack([c.to_numpy() for c in batch.columns])
            part = part[:, part[0] >= 0]
            np.add.at(sizes, part[0] + 1, 1)
            parts.append(part)
        begin = np.cumsum(sizes)
        targets = np.empty(begin[-1], np.int32)
        while parts:
            src, r, dst = parts.pop()
            targets[begin[src] + r] = dst
        visits, seen, found = np.zeros(total, np.int32), [], []

        def weighted(weights: np.ndarray, *at: Any) -> int:
            upto = np.cumsum(weights)
            return min(int(np.searchsorted(upto, uniform(*at) * upto[-1], side="right")), len(upto) - 1)

        def any_node(attempt: int) -> int:
            """As ``weighted`` over all nodes, of which only those visited weigh less than one."""
            marks = np.array(seen, np.int64)
            lost = np.cumsum(1 - 1 / (1 + visits[marks]))
            aim = uniform(attempt, 0) * (total - (lost[-1] if seen else 0))
            j = int(np.searchsorted(marks + 1 - lost, aim, side="right"))
            low, high = marks[j - 1] + 1 if j else 0, marks[j] if j < len(seen) else total - 1
            return int(min(max(math.floor(aim + (lost[j - 1] if j else 0)), low), high))

        def visit(node: int) -> None:
            if not visits[node]:
                insort(seen, node)
            visits[node] += 1

        for attempt in range(attempts):
            at = first if first is not None else any_node(attempt)
            path = [at]
            visit(at)
            while len(path) < max_length:
                out = targets[begin[at] : begin[at + 1]]
                free = np.arange(len(out)) if revisit else np.flatnonzero(~np.isin(out, path))
                if not len(free):
                    break
                r = int(free[weighted(1 / (1 + visits[out[free]]), attempt, len(path))])
                found.append((attempt, len(path) - 1, at, r))
                at = int(out[r])
                path.append(at)
                visit(at)
            found.append((attempt, len(path) - 1, at, None))
        yield pa.RecordBatch.from_pydict({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("attempt", "k", "n", "r"))})

    picks = keep(rows.coalesce(1).mapInArrow(run, "attempt long, k long, n long, r long"), "picks")
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c])
    walks = names.join(hint(picks), "n").groupBy("attempt").agg(in_order("id").alias("path"))
    if max_length == 1:
        return walks.withColumn("types", F.array().cast("array<string>"))
    taken = hint(picks).where("r is not null").select("attempt", "k", F.col("n").cast("int").alias("src"), F.col("r").cast("int").alias("r"))
    types = steps.join(taken, ["src", "r"]).groupBy("attempt").agg(in_order("kind").alias("types"))
    return walks.join(types, "attempt", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
