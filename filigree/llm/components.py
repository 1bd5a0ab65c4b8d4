"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, keep, let_go

_CHUNK = 2_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction; ``edges`` have a > b and each node points to smaller ones afterwards."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges and the least node that each reaches through them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        if not apart.any():
            break
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:  # to the roots
            up = root[root]
            if (up == root).all():
                break
            root = up
    return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges that a task has, a bounded number at a time, become stars around their least nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        node, least = least_reached(a, b)
        moved = node != least
        return pa.record_batch({"a": node[moved], "b": least[moved]})

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= _CHUNK:
            yield stars(held)
            held, size = [], 0
    if size:
        yield stars(held)


def components(links: DataFrame, max_rounds: int = 60, local: int = _CHUNK) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b longs); the component is its least node.

    The edges that lie together in a task are contracted first.  Once a count
    shows at most ``local`` edges (``_CHUNK`` at most), one task contracts them
    all; until then each round makes two stars over all and contracts again, so
    rounds are logarithmic in the longest path at most.  Both give the same
    result.  Tables are written between rounds, so lineage stays short and lost
    executors cost one round at most.
    """
    now = keep(links.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long"), "links")
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
        if seen.n <= min(local, _CHUNK):
            small = keep(now.coalesce(1).mapInArrow(_contract, "a long, b long"), "small")
            forget(now)
            now = small
            break
        large = keep(_star(now, True), "large")
        small = keep(_star(large, False).mapInArrow(_contract, "a long, b long"), "small")
        forget(now)
        forget(large)
        now = small
    else:
        raise RuntimeError("components did not settle")
    let_go(links.sparkSession)  # each round has left the files of some ten exchanges
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
