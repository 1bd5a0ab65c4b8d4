"""Traversals: frontier joins for any size, one task where order is sequential or the graph is known to be small.

A traversal narrows the edges to ``(src, dst, seq)`` once, with the filter
applied and targets inside the graph.  If those are at most ``LOCAL_EDGES``
(counted, not guessed), levels cost more than the data, and the walk is done
in memory; above that each level is a join with the frontier, a distinct and
an anti-join, written out to keep the plan short.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import forget, hint, keep, size

LOCAL_EDGES = 300_000
VISITED = "id string, depth long, rank long, parent string"


def _narrow(graph: PropertyGraph, wanted: Any) -> DataFrame:
    ids = graph.nodes.select(F.col("id").alias("dst"))
    return graph.where_edges(wanted).select("src", "dst", "seq").join(ids, "dst", "left_semi").select("src", "dst", "seq")


class _Small:
    """Adjacency of a graph that fits the driver, by node number, in insertion order."""

    def __init__(self, table: pa.Table):
        ends = pa.chunked_array(table["src"].chunks + table["dst"].chunks, type=table["src"].type)
        code = ends.combine_chunks().dictionary_encode() if len(ends) else None
        n = len(table)
        self.names: list[str] = code.dictionary.to_pylist() if code is not None else []
        self.number = {name: i for i, name in enumerate(self.names)}
        codes = code.indices.to_numpy() if code is not None else np.zeros(0, np.int64)
        order = np.lexsort((table["seq"].to_numpy(), codes[:n]))
        self.dst = codes[n:][order]
        self.begin = np.searchsorted(codes[:n][order], np.arange(len(self.names) + 1))

    def out(self, i: int) -> list[int]:
        return self.dst[self.begin[i] : self.begin[i + 1]].tolist()

    def bfs(self, starts: list[str], depth: int | None, target: str | None = None) -> list[tuple[str, int, int, str | None]]:
        """(id, depth, rank, parent) in visiting order; up to ``target`` if it is named."""
        out = [(s, 0, i, None) for i, s in enumerate(starts)]
        if target in starts:
            return out
        queue = deque((self.number[s], 0) for s in starts if s in self.number)
        seen = {i for i, _ in queue}
        goal = self.number.get(target) if target is not None else None
        while queue:
            i, d = queue.popleft()
            if depth is not None and d >= depth:
                continue
            for j in self.out(i):
                if j not in seen:
                    seen.add(j)
                    out.append((self.names[j], d + 1, len(out), self.names[i]))
                    if j == goal:
                        return out
                    queue.append((j, d + 1))
        return out

    def dfs(self, start: str, depth: int | None) -> list[tuple[str, int, int, str | None]]:
        """Preorder; a node keeps the depth at which it was first touched."""
        out: list[tuple[str, int, int, str | None]] = [(start, 0, 0, None)]
        if start not in self.number:
            return out
        seen = {self.number[start]}
        stack = [(self.number[start], 0, iter(self.out(self.number[start])))] if depth is None or depth > 0 else []
        while stack:
            i, d, rest = stack[-1]
            j = next((x for x in rest if x not in seen), None)
            if j is None:
                stack.pop()
                continue
            seen.add(j)
            out.append((self.names[j], d + 1, len(out), self.names[i]))
            if depth is None or d + 1 < depth:
                stack.append((j, d + 1, iter(self.out(j))))
        return out


def _small(graph: PropertyGraph, wanted: Any) -> _Small | None:
    """The narrowed edges in memory, if there are no more than LOCAL_EDGES before they are held against the nodes.

    They are counted without their places and targets, which costs no shuffle.
    """
    if graph.where_edges(wanted).select("src").count() > LOCAL_EDGES:
        return None
    return _Small(_narrow(graph, wanted).toArrow())


#: From so many levels on, the narrowed edges are kept between levels; a few are cheaper to read again.
KEEP_LEVELS = 4
Near = Callable[[DataFrame, bool], DataFrame]


def _near(graph: PropertyGraph, wanted: Any) -> Near | None:
    """Finds the edges that leave a level's nodes; None where the filter is a callable, which may cost more than a level."""
    if wanted is not None and not isinstance(wanted, (dict, Column)):
        return None

    def near(level: DataFrame, placed: bool) -> DataFrame:
        edges = graph.out_edges(level, placed)
        return edges if wanted is None else graph.replace(edges=edges).where_edges(wanted)

    return near


def frontier(starts: DataFrame, edges: DataFrame, depth: int | None, ordered: bool = False, target: str | None = None, nodes: DataFrame | None = None, near: Near | None = None) -> DataFrame:
    """Visited nodes level by level: id, depth, and with ``ordered`` rank and parent of the first discoverer.

    With ``nodes``, what a level meets is held against them, which costs a
    level's size; without, all targets are taken to be nodes.  ``near`` finds
    the edges of the first KEEP_LEVELS levels; ``edges`` serve those after.
    """

    def inside(df: DataFrame, name: str) -> DataFrame:
        if nodes is None or near is not None and not by_level:
            return df
        met = keep(df, name)  # its size decides how it meets the nodes
        return nodes.select("id").join(hint(met), "id").select(df.columns)

    level = keep(starts.select("id", F.lit(0).cast("long").alias("depth"), *([F.col("rank"), F.lit(None).cast("string").alias("parent")] if ordered else [])), "level0")
    visited, levels, d = level, [level], 0
    columns = ["src", "dst", *(["seq"] if ordered else [])]
    edges = edges.select(columns)
    long, held = depth is None or depth >= KEEP_LEVELS, False
    base = size(level) if ordered else 0
    while depth is None or d < depth:
        if target is not None and not visited.where(F.col("id") == target).isEmpty():
            break
        d += 1
        by_level = near is not None and d <= KEEP_LEVELS
        if long and not held and not by_level:
            edges, held = edges.persist(), True
        source = near(level, ordered).select(columns) if by_level else edges
        met = hint(level).select(F.col("id").alias("src"), *([F.col("rank").alias("from_rank")] if ordered else [])).join(source, "src")
        if ordered:
            first = met.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("from_rank", "seq", "src")).alias("by"))
            fresh = inside(first.join(visited.select("id"), "id", "left_anti"), f"met{d}")
            # a level's order is global, so it is numbered in one task; ordered traversals are for results that fit one
            rank = F.row_number().over(Window.orderBy("by.from_rank", "by.seq")) - 1 + base
            fresh = fresh.select("id", F.lit(d).cast("long").alias("depth"), rank.cast("long").alias("rank"), F.col("by.src").alias("parent"))
        else:
            fresh = inside(met.select(F.col("dst").alias("id")).distinct().join(visited.select("id"), "id", "left_anti"), f"met{d}").select("id", F.lit(d).cast("long").alias("depth"))
        if d == depth and not ordered:  # nothing follows, so nothing waits for it
            return visited.unionByName(fresh)
        level = keep(fresh, f"level{d}")
        n = size(level)
        if not n:
            break
        base += n
        levels.append(level)
        visited = visited.unionByName(level)
        if len(levels) > 24:  # many short levels: one table again
            visited, old = keep(visited, "visited"), levels
            for x in old[:-1]:
                forget(x)
            levels = [visited, level]
    if held:
        edges.unpersist()
    return visited


def visit(graph: PropertyGraph, starts: list[str] | DataFrame, depth: int | None, wanted: Any = None, ordered: bool = False, target: str | None = None) -> DataFrame:
    """(id, depth, rank, parent) of the nodes reached from ``starts``."""
    spark = graph.spark
    short = depth is not None and depth < KEEP_LEVELS and not ordered
    if isinstance(starts, list) and not short and (small := _small(graph, wanted)):
        out = spark.createDataFrame(small.bfs(starts, depth, target), VISITED)
    else:
        if isinstance(starts, list):
            starts = spark.createDataFrame([(s, i) for i, s in enumerate(starts)], "id string, rank long")
        near = _near(graph, wanted)
        out = frontier(starts, graph.where_edges(wanted) if short else _narrow(graph, wanted), depth, ordered, target, graph.nodes if short or near else None, near)
    return out if ordered else out.select("id", "depth", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("string").alias("parent"))


def _known(graph: PropertyGraph, *ids: str) -> None:
    found = {r.id for r in graph.nodes.where(F.col("id").isin(*ids)).select("id").collect()}
    for i in ids:
        if i not in found:
            raise ValueError(f"Node with id '{i}' not found")


def _result(graph: PropertyGraph, visited: DataFrame) -> PropertyGraph:
    """The visited nodes with depth and rank, and all their out-edges."""
    visited = keep(visited.select("id", "depth", "rank"), "visited")
    nodes = graph.nodes.drop("depth", "rank").join(hint(visited), "id")
    return graph.replace(nodes, cache(lambda: graph.out_edges(visited)))


def bfs(graph: PropertyGraph, start: str, depth: int | None = None, wanted: Any = None, ordered: bool = True) -> PropertyGraph:
    _known(graph, start)
    return _result(graph, visit(graph, [start], depth, wanted, ordered))


def dfs(graph: PropertyGraph, start: str, depth: int | None = None, wanted: Any = None) -> PropertyGraph:
    """Preorder with insertion order among edges.

    The set is first narrowed by a breadth-first search of the same depth,
    which reaches all that a depth-first one can; the order itself is
    sequential by definition and found in one task.
    """
    _known(graph, start)
    if small := _small(graph, wanted):
        return _result(graph, graph.spark.createDataFrame(small.dfs(start, depth), VISITED))
    edges, near = _narrow(graph, wanted), _near(graph, wanted)
    reach = keep(frontier(graph.spark.createDataFrame([(start,)], "id string"), edges, depth, nodes=graph.nodes if near else None, near=near), "reach")
    out = near(reach, True) if near else edges.join(hint(reach).select(F.col("id").alias("src")), "src", "left_semi")
    inner = keep(out.select("src", "dst", "seq").join(hint(reach).select(F.col("id").alias("dst")), "dst", "left_semi"), "inner")

    def run(table: pa.Table) -> pa.Table:
        rows = _Small(table).dfs(start, depth)
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("id", pa.string()), ("depth", pa.int64()), ("rank", pa.int64()), ("parent", pa.string())))})

    if inner.isEmpty():
        return _result(graph, graph.spark.createDataFrame([(start, 0, 0, None)], VISITED))
    return _result(graph, inner.select("src", "dst", "seq", F.lit(1).alias("one")).groupBy("one").applyInArrow(run, VISITED))


def bfs_search(graph: PropertyGraph, start: str, target: str, depth: int | None = None, wanted: Any = None) -> dict[str, Any] | None:
    """The target node, or None if it is not within reach; start and target may be one, whatever the filter."""
    _known(graph, start)
    if start != target and visit(graph, [start], depth, wanted, target=target).where(F.col("id") == target).isEmpty():
        return None
    return graph.get_node(target)


def path_ids(graph: PropertyGraph, root: str, target: str, max_depth: int | None = None) -> list[str]:
    """Node ids of the shortest path that is found first."""
    _known(graph, root, target)
    if small := _small(graph, None):
        by = {r[0]: r[3] for r in small.bfs([root], max_depth, target)}
        parent = by.get
    else:
        start = graph.spark.createDataFrame([(root, 0)], "id string, rank long")
        visited = frontier(start, _narrow(graph, None), max_depth, True, target, graph.nodes, _near(graph, None))

        def parent(at: str) -> str | None:  # a lookup for each level
            row = visited.where(F.col("id") == at).select("parent").first()
            return row.parent if row else None

    out, at = [target], target
    while at != root:
        above = parent(at)
        if above is None:
            raise ValueError(f"No path from '{root}' to '{target}'")
        at = above
        out.append(at)
    return out[::-1]


def shortest_path(graph: PropertyGraph, root: str, target: str, max_depth: int | None = None) -> PropertyGraph:
    """The path's nodes, ranked from the root, and all edges among them; none if root and target are one."""
    ids = path_ids(graph, root, target, max_depth)
    ranks = graph.spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, rank long")
    sub = graph.induced(ranks)
    edges = sub.edges.limit(0) if len(ids) == 1 else sub.edges
    return sub.replace(sub.nodes.drop("rank").join(ranks, "id"), edges)


def expand(sub: PropertyGraph, source: PropertyGraph, depth: int = 1) -> PropertyGraph:
    """Induced subgraph of ``source`` on what its out-edges reach from the nodes of ``sub`` in ``depth`` hops."""
    seeds = sub.nodes.select("id").join(source.nodes.select("id"), "id", "left_semi")
    reached = frontier(seeds, source.edges if depth < KEEP_LEVELS else _narrow(source, None), depth, nodes=source.nodes, near=_near(source, None))
    return source.replace(meta={}).induced(reached)


