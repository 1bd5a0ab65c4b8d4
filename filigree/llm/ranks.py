"""Gapless ranks that need neither one global sort nor a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

MOST_PARTS = 10_000


def spread_sort(df: DataFrame, order: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """``df`` (a kept table) in total order over range partitions, with each row's place, and the partitions' first ranks.

    Equal rows may lie in several partitions.  There are at most MOST_PARTS
    partitions, so their counts are a table of proven bound.
    """
    ranges = df.repartitionByRange(max(1, min(parts, MOST_PARTS)), *order).sortWithinPartitions(*order)
    placed = keep(ranges.withColumn("_place", F.monotonically_increasing_id()), "sorted")
    counts = placed.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count("*").alias("_n"))
    return placed, counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))


def numbered(placed: DataFrame, first: DataFrame, name: str = "rank") -> DataFrame:
    """The rows of ``spread_sort`` with their rank from 0."""
    at = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_row", F.col("_place").bitwiseAND((1 << 33) - 1))
    return at.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_row")).drop("_part", "_row", "_first", "_place")


def spread_rank(df: DataFrame, group: str, tie: Column, order: list[str], parts: int, name: str = "rank", total: bool = False) -> DataFrame:
    """Add ``name``: the rank from 0 of each row, within ``group`` or (``total``) over all groups in order.

    A group is cut into ``parts`` by the hash ``tie``; rows are numbered within
    a part and the parts' counts are summed up before them.  A task holds one
    part's rows, or the ``parts`` counts of one group, or (``total``) one count
    a group, so ``group`` must have few values there.
    """
    cut = df.withColumn("_part", F.pmod(tie, F.lit(parts)))
    counts = cut.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    within = Window.partitionBy(group).orderBy("_part")
    before = counts.withColumn("_before", F.sum("_n").over(within) - F.col("_n")).select(group, "_part", "_before")
    if total:
        groups = counts.groupBy(group).agg(F.sum("_n").alias("_all"))
        first = groups.withColumn("_first", F.sum("_all").over(Window.orderBy(group)) - F.col("_all")).select(group, "_first")
        before = before.join(F.broadcast(first), group).select(group, "_part", (F.col("_before") + F.col("_first")).alias("_before"))
    row = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return cut.withColumn("_row", row).join(before, [group, "_part"]).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")
