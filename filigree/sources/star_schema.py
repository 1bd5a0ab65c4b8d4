"""Graphs over the driver's tables, typed layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import hint, is_few, keep, ready

NODE_ATTR = "struct<type:string,name:string,segment:string,status:string,balance:double,price:double,size:int>"
EDGE_ATTR = "struct<type:string,quantity:double,price:double>"


#: The key that an edge of the table is placed by; no other row has it, but lines of one order, which are numbered.
PLACED_BY = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _attr(schema: str, **values: Column | str) -> Column:
    """A struct of the layout's fields; those not given are absent."""
    fields = [f.split(":") for f in schema[len("struct<") : -1].split(",")]
    return F.struct(*((F.lit(v) if isinstance(v := values.get(n), str) else F.lit(None) if v is None else v).cast(t).alias(n) for n, t in fields)).alias("attr")


def commerce(spark: SparkSession, sf_dir: str, reverse: bool = False) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders; edges along foreign keys, with ``reverse`` also against them."""
    t = {n: _table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    nodes = [
        t["region"].select(key("r", "r_regionkey").alias("id"), _attr(NODE_ATTR, type="region", name=F.col("r_name"))),
        t["nation"].select(key("n", "n_nationkey").alias("id"), _attr(NODE_ATTR, type="nation", name=F.col("n_name"))),
        t["customer"].select(key("c", "c_custkey").alias("id"), _attr(NODE_ATTR, type="customer", name=F.col("c_name"), segment=F.col("c_mktsegment"), balance=F.col("c_acctbal"))),
        t["supplier"].select(key("s", "s_suppkey").alias("id"), _attr(NODE_ATTR, type="supplier", name=F.col("s_name"), balance=F.col("s_acctbal"))),
        t["part"].select(key("p", "p_partkey").alias("id"), _attr(NODE_ATTR, type="part", name=F.col("p_name"), price=F.col("p_retailprice"), size=F.col("p_size"))),
        t["orders"].select(key("o", "o_orderkey").alias("id"), _attr(NODE_ATTR, type="order", status=F.col("o_orderstatus"), price=F.col("o_totalprice"))),
    ]
    pairs = [
        ("nation", "n", "n_nationkey", "r", "n_regionkey", "in_region", "has_nation"),
        ("customer", "c", "c_custkey", "n", "c_nationkey", "located_in", "has_customer"),
        ("supplier", "s", "s_suppkey", "n", "s_nationkey", "located_in", "has_supplier"),
        ("orders", "c", "o_custkey", "o", "o_orderkey", "placed", "placed_by"),
        ("lineitem", "o", "l_orderkey", "p", "l_partkey", "contains", "contained_in"),
        ("lineitem", "s", "l_suppkey", "p", "l_partkey", "supplies", "supplied_by"),
    ]

    def between(k: int, r: int, rows: DataFrame) -> DataFrame:
        """Edges of the ``k``-th key forth, or back (``r``), of some of the table's rows; of lines, all of an order or none."""
        name, a, src, b, dst, forth, back = pairs[k]
        own = {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice")} if forth == "contains" else {}
        # an order that follows from the data, so that it is the same in every run and in SQL, and no two edges share a place
        among = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) if name == "lineitem" else F.lit(0)
        place = (F.col(PLACED_BY.get(name, src)).cast("long") * 4096 + among) * 16 + k * 2
        ends = (key(b, dst), key(a, src)) if r else (key(a, src), key(b, dst))
        kind = back if r else forth
        return rows.select(F.lit(None).cast("string").alias("id"), ends[0].alias("src"), ends[1].alias("dst"), _attr(EDGE_ATTR, type=kind, **own), (place + r).alias("seq"))

    every = [(k, r) for k in range(len(pairs)) for r in range(1 + reverse)]
    edges = reduce(DataFrame.unionByName, [between(k, r, t[pairs[k][0]]) for k, r in every])

    def leaving(ids: DataFrame, placed: bool) -> DataFrame:
        """Only tables with keys of the ids' kinds are read, and only orders that have a line to give to a few ids are numbered."""
        letters = {x.a for x in ids.select(F.substring("id", 1, 1).alias("a")).where(F.col("a").isin(*"rncspo")).distinct().collect()}
        few = hint(ids).select(F.col("id").alias("src"))
        found, whole = [], {}
        for k, r in every:
            name, a, src, b, dst, *_ = pairs[k]
            letter, column = (b, dst) if r else (a, src)
            if letter not in letters:
                continue
            rows = t[name]
            if name == "lineitem" and column == "l_orderkey":
                rows = rows.withColumn("src", key(letter, column)).join(few, "src", "left_semi")
            elif name == "lineitem" and placed and is_few(ids):
                if letter not in whole:
                    hit = rows.select("l_orderkey", key(letter, column).alias("src")).join(few, "src", "left_semi")
                    whole[letter] = keep(hit.select("l_orderkey").distinct(), "orders")
                rows = rows.join(hint(whole[letter]), "l_orderkey", "left_semi")
            found.append(between(k, r, rows).join(few, "src", "left_semi").select(edges.columns))
        return reduce(DataFrame.unionByName, found) if found else edges.where(F.lit(False))

    return PropertyGraph(reduce(DataFrame.unionByName, nodes), edges, leaving=leaving)


def event_users(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """User to the user of the next event: a cyclic multigraph."""
    e = _table(spark, sf_dir, "events")
    # numbered by buckets of ids, so that no task orders all events
    bucket = F.floor(F.col("event_id") / 10_000)
    w = Window.partitionBy("b").orderBy("event_id")
    rows = e.select("event_id", "user_id", "event_type", bucket.alias("b"))
    inside = rows.withColumn("nxt", F.lead("user_id").over(w))
    first = rows.groupBy("b").agg(F.min_by("user_id", "event_id").alias("f")).select((F.col("b") - 1).alias("b"), "f")
    linked = inside.join(first, "b", "left").withColumn("nxt", F.coalesce("nxt", "f")).where("nxt is not null")
    edges = linked.select(F.lit(None).cast("string").alias("id"), key("u", "user_id").alias("src"), key("u", "nxt").alias("dst"), _attr(EDGE_ATTR, type=F.col("event_type")), F.col("event_id").alias("seq"))
    return PropertyGraph(e.select(key("u", "user_id").alias("id")).distinct().select("id", _attr(NODE_ATTR, type="user")), edges)


def event_chain(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Each user's events, one after the other: long paths."""
    e = _table(spark, sf_dir, "events")
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    edges = e.select("event_id", "event_type", nxt.alias("nxt")).where("nxt is not null").select(F.lit(None).cast("string").alias("id"), key("e", "event_id").alias("src"), key("e", "nxt").alias("dst"), _attr(EDGE_ATTR, type="next"), F.col("event_id").alias("seq"))
    return PropertyGraph(e.select(key("e", "event_id").alias("id"), _attr(NODE_ATTR, type=F.col("event_type"))), edges)


def dialogues(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Turns of conversations; each turn points to the next."""
    c = _table(spark, sf_dir, "conversations")
    at = lambda turn: F.concat_ws(":", F.lit("d"), F.col("conv_id").cast("string"), turn.cast("string"))
    nodes = c.select(at(F.col("turn")).alias("id"), _attr(NODE_ATTR, type=F.col("role"))).dropDuplicates(["id"])
    edges = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).select("conv_id", "turn").distinct()
    edges = edges.select(F.lit(None).cast("string").alias("id"), at(F.col("turn")).alias("src"), at(F.col("turn") + 1).alias("dst"), _attr(EDGE_ATTR, type="reply"), (F.col("conv_id") * 10_000 + F.col("turn")).alias("seq"))
    return PropertyGraph(nodes, edges)
