"""Queries of the graph operators over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import attr_contains, attr_equals, p_and, p_not, p_or
from ..graph import PropertyGraph, one_filter
from ..operators import embed, mutate, traverse
from ..operators.walks import random_walks
from ..schema import Attributes
from ..sources import columnar, export, json_graph, lgf, star_schema
from .lineage import hint, keep, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS name, NULL::VARCHAR AS segment, NULL::VARCHAR AS status, NULL::DOUBLE AS balance, NULL::DOUBLE AS price, NULL::INT AS size FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'customer', c_name, c_mktsegment, NULL, c_acctbal, NULL, NULL FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, NULL, NULL, s_acctbal, NULL, NULL FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'part', p_name, NULL, NULL, NULL, p_retailprice, p_size FROM part
  UNION ALL SELECT 'o' || o_orderkey, 'order', NULL, NULL, o_orderstatus, NULL, o_totalprice, NULL FROM orders)"""
_PAIRS = [
    ("nation", "n", "n_nationkey", "r", "n_regionkey", "in_region", "has_nation"),
    ("customer", "c", "c_custkey", "n", "c_nationkey", "located_in", "has_customer"),
    ("supplier", "s", "s_suppkey", "n", "s_nationkey", "located_in", "has_supplier"),
    ("orders", "c", "o_custkey", "o", "o_orderkey", "placed", "placed_by"),
    ("lineitem", "o", "l_orderkey", "p", "l_partkey", "contains", "contained_in"),
    ("lineitem", "s", "l_suppkey", "p", "l_partkey", "supplies", "supplied_by"),
]


def _edges(reverse: bool = False) -> str:
    parts = []
    for k, (table, a, src, b, dst, forth, back) in enumerate(_PAIRS):
        own = "l_quantity AS quantity, l_extendedprice AS price" if forth == "contains" else "NULL::DOUBLE AS quantity, NULL::DOUBLE AS price"
        among = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)" if table == "lineitem" else "0"
        place = f"({star_schema.PLACED_BY.get(table, src)}::BIGINT * 4096 + {among}) * 16 + {k * 2}"
        parts.append(f"SELECT '{a}' || {src} AS src, '{b}' || {dst} AS dst, '{forth}' AS type, {own}, {place} AS seq FROM {table}")
        if reverse:
            parts.append(f"SELECT '{b}' || {dst}, '{a}' || {src}, '{back}', {own}, {place} + 1 FROM {table}")
    return "edges AS (" + " UNION ALL ".join(parts) + ")"


_GRAPH = f"WITH RECURSIVE {_NODES}, {_edges()}"
_BOTH = f"WITH RECURSIVE {_NODES}, {_edges(True)}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _reach(start: str, depth: int | None, edges: str = "edges", where: str = "true", graph: str = _GRAPH) -> str:
    limit = f"AND w.depth < {depth}" if depth is not None else ""
    return f"""{graph}, w AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN {edges} e ON e.src = w.id WHERE {where} {limit}), reach AS (SELECT id, min(depth)::BIGINT AS depth FROM w GROUP BY id)"""


# Lookup, cardinality, metadata


@query(f"{_GRAPH} SELECT n AS node_count, m AS edge_count, CASE WHEN n = 0 THEN 0.0 ELSE m / n END AS average_degree FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)")
def graph_metadata(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).metadata()


@query(f"{_GRAPH} SELECT id, type, segment, balance FROM nodes WHERE id = 'c7'")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    node = star_schema.commerce(spark, d).get_node("c7")
    return spark.createDataFrame([(node["id"], *(node["attr"][k] for k in ("type", "segment", "balance")))], "id string, type string, segment string, balance double")


@query(f"{_GRAPH} SELECT q.id, EXISTS (SELECT 1 FROM nodes n WHERE n.id = q.id) AS present FROM (VALUES ('c1'), ('zz'), ('p3')) q(id)")
def has_node(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    return spark.createDataFrame([(i, g.has_node(i)) for i in ("c1", "zz", "p3")], "id string, present boolean")


@query(f"{_GRAPH} SELECT id FROM nodes")
def node_keys(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).keys()


@query(f"{_GRAPH} SELECT id, (SELECT count(*) FROM edges WHERE src = n.id) AS degree, (SELECT count(*) FROM edges WHERE dst = n.id) AS in_degree, (SELECT count(DISTINCT dst) FROM edges WHERE src = n.id) AS neighbors FROM nodes n")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).degrees()


@query(f"{_GRAPH} SELECT src AS id, count(*) AS n, string_agg(dst, ',' ORDER BY seq, dst) AS targets FROM edges WHERE type = 'placed' GROUP BY src")
def adjacency_lists(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    lists = g.replace(edges=g.where_edges({"type": "placed"})).adjacency().where(F.size("edges") > 0)
    return lists.select("id", F.size("edges").cast("long").alias("n"), F.array_join(F.transform("edges", lambda e: e["other"]), ",").alias("targets"))


@query(f"{_GRAPH} SELECT seq, coalesce(type, 'unknown') || ': ' || src || ' --> ' || dst AS text FROM edges WHERE type IN ('placed', 'in_region')")
def edge_texts(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    return g.replace(edges=g.where_edges(lambda e: e.type.isin("placed", "in_region"))).edge_texts()


# Node filters and predicates


@query(f"{_GRAPH} SELECT id FROM nodes WHERE type = 'customer' AND segment = 'BUILDING'")
def filter_attr_eq(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).filter(type="customer", segment="BUILDING").keys()


@query(f"{_GRAPH}, k AS (SELECT * FROM nodes WHERE id IN ('c1', 'c2', 'n3', 'o5')) SELECT k.id, (SELECT count(*) FROM edges e WHERE e.src = k.id AND e.dst IN (SELECT id FROM k)) AS degree FROM k")
def filter_ids(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).filter(ids=["c1", "c2", "n3", "o5", "c1"]).degrees().select("id", "degree")


@query(f"{_GRAPH} SELECT id FROM nodes WHERE starts_with(id, 'p') AND coalesce(size, 0) > 25 AND price < 1200")
def filter_lambda(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).filter(lambda n: n.id.startswith("p") & (n.attr("size", 0) > 25) & (n.attr("price") < 1200.0)).keys()


@query(f"{_GRAPH} SELECT id FROM nodes WHERE status IS DISTINCT FROM 'F' AND type <> 'part'")
def filter_not_missing(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).filter(lambda n: (n.attr("status") != "F") & (n.type != "part")).keys()


@query(f"{_GRAPH} SELECT id FROM nodes WHERE (type = 'supplier' OR segment IN ('BUILDING', 'MACHINERY')) AND NOT (contains(coalesce(name, ''), '7'))")
def filter_predicates(spark: SparkSession, d: str) -> DataFrame:
    either = p_or(attr_equals("type", "supplier"), attr_equals("segment", "BUILDING"), attr_equals("segment", "MACHINERY"))
    return star_schema.commerce(spark, d).filter(p_and(either, p_not(attr_contains("name", "7")))).keys()


@query(f"{_GRAPH} SELECT id FROM nodes WHERE type = 'supplier' AND balance > 0")
def filter_python(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).filter(lambda n: n.type == "supplier" and (n.attr("balance") or 0) > 0).keys()


@query(f"{_GRAPH} SELECT id, EXISTS (SELECT 1 FROM edges e WHERE e.src = n.id AND e.dst = 'n3') AS to_n3, EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id AND e.src = 'c7') AS from_c7 FROM nodes n WHERE type IN ('customer', 'order')")
def has_edge(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    from ..functions.expr import NodeExpr

    n = NodeExpr(Attributes(g.nodes.schema))
    to, back = n.has_edge_to("n3"), n.has_edge_from("c7")
    return g.with_features(n.needs).where(F.col("attr.type").isin("customer", "order")).select("id", to.alias("to_n3"), back.alias("from_c7"))


@query(f"{_GRAPH} SELECT id FROM nodes n WHERE (SELECT count(*) FROM edges WHERE src = n.id) >= 5 AND (SELECT count(*) FROM edges WHERE dst = n.id) >= 1 AND NOT EXISTS (SELECT 1 FROM edges WHERE src = n.id AND dst = 'p1')")
def filter_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).filter(lambda n: (n.degree >= 5) & (n.in_degree >= 1) & ~F.array_contains(n.neighbor_ids, "p1")).keys()


@query(f"{_GRAPH}, k AS (SELECT id FROM nodes WHERE type IN ('customer', 'nation') OR price > 200000) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def induced_subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    return g.filter(lambda n: n.type.isin("customer", "nation") | (n.attr("price") > 200000.0)).edges.select("src", "dst", "attr.type")


@query(f"{_GRAPH}, k AS (SELECT id FROM nodes WHERE type = 'customer') SELECT (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM k)) AS before, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM k) AND dst NOT IN (SELECT id FROM k)) AS removed")
def prune_count(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    sub = g.from_nodes(g.nodes.where("attr.type = 'customer'").select("id"))
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
    return one(sub.edges, "before").join(one(sub.dangling(), "removed"), "_k").drop("_k")


# Edge filters


@query(f"{_GRAPH} SELECT src, dst, quantity FROM edges WHERE type = 'contains' AND quantity = 7")
def edge_dict_filter(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).where_edges({"type": "contains", "quantity": 7}).select("src", "dst", "attr.quantity")


@query(f"{_GRAPH} SELECT src, dst, type FROM edges WHERE quantity IS NULL AND type <> 'supplies' OR price > 90000")
def edge_lambda_filter(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    return g.where_edges(lambda e: (~e.has_attr("quantity") & (e.type != "supplies")) | (e.attr("price") > 90000.0)).select("src", "dst", "attr.type")


@query(f"{_GRAPH} SELECT e.src, e.dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type = 'placed' AND a.segment = 'BUILDING' AND b.status IS DISTINCT FROM 'F'")
def edge_ends_filter(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    return g.where_edges(lambda e: (e.type == "placed") & (e.from_node.attr("segment") == "BUILDING") & (e.to_node.attr("status") != "F")).select("src", "dst")


@query(f"{_GRAPH} SELECT src, dst, quantity FROM edges WHERE type = 'contains' AND quantity > 45 AND substr(dst, -1) = '7'")
def edge_python_filter(spark: SparkSession, d: str) -> DataFrame:
    """A predicate that needs real values: an edge at a time, in Arrow batches."""
    g = star_schema.commerce(spark, d)
    return g.where_edges(lambda e: e.type == "contains" and e.attr("quantity", 0) > 45 and e.to_id[-1] == "7").select("src", "dst", "attr.quantity")


@query(f"{_GRAPH} SELECT src, dst, quantity FROM edges WHERE type = 'contains' AND quantity = 9 AND NOT (contains(dst, '3'))")
def edge_dict_and_python(spark: SparkSession, d: str) -> DataFrame:
    """Criteria as a plan, and a callable for the edges that meet them."""
    g = star_schema.commerce(spark, d)
    return g.where_edges(one_filter({"type": "contains", "quantity": 9}, lambda e: "3" not in e.to_id)).select("src", "dst", "attr.quantity")


@query(f"{_GRAPH} SELECT id FROM nodes n WHERE type = 'customer' AND segment = 'BUILDING' AND NOT contains(name, '7') AND (SELECT count(*) FROM edges WHERE src = n.id) > 3")
def filter_predicates_in_python(spark: SparkSession, d: str) -> DataFrame:
    """Ready predicates called on real nodes inside a lambda."""
    building = p_and(attr_equals("segment", "BUILDING"), p_not(attr_contains("name", "7")))
    return star_schema.commerce(spark, d).filter(lambda n: n.type == "customer" and building(n) and len(n.edges) > 3).keys()


@query(f"{_GRAPH} SELECT id, type FROM nodes WHERE id = 'c7'")
def filter_id(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).filter(id="c7").nodes.select("id", "attr.type")


@query("SELECT * FROM (VALUES ('o5', 0::BIGINT, 'order'), ('c1', 1, 'customer'), ('r2', 2, 'region')) t(id, rank, type)")
def from_nodes_ranked(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.commerce(spark, d).from_nodes(["o5", "c1", "o5", "r2"], ranked=True).nodes.select("id", "rank", "attr.type")


@query("SELECT 0::BIGINT AS node_count, 0::BIGINT AS edge_count, 0.0::DOUBLE AS average_degree")
def empty_graph(spark: SparkSession, d: str) -> DataFrame:
    return PropertyGraph.empty(spark).metadata()


@query("SELECT message FROM (VALUES ('From node with id ''zz'' not found'), ('Node with id ''c1'' already exists'), ('Node with id ''zz'' not found'), ('To node with id ''zz'' not found')) t(message)")
def reference_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is said of edges without nodes, nodes that are there already and unknown ids."""
    g = star_schema.commerce(spark, d)
    edge = lambda src, dst: g.replace(edges=g.edges.limit(1).withColumns({"src": F.lit(src), "dst": F.lit(dst)}))
    calls = [lambda: edge("zz", "c1").validate(), lambda: edge("c1", "zz").validate(), lambda: g.filter(ids=["c1", "zz"]), lambda: mutate.add_nodes(g, g.nodes.where("id = 'c1'"))]
    said = []
    for call in calls:
        try:
            call()
        except ValueError as e:
            said.append((str(e),))
    return spark.createDataFrame(said, "message string")


@query(f"{_GRAPH} SELECT id, type FROM nodes WHERE type IN ('nation', 'region')")
def node_iteration(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d).filter(lambda n: n.type.isin("nation", "region"))
    return spark.createDataFrame([(n["id"], n["attr"]["type"]) for n in g], "id string, type string")


# Traversals


def _start(g: PropertyGraph, start: str, depth: int | None, wanted: object = None, **how: object) -> DataFrame:
    return traverse.visit(g, [start], depth, wanted, **how)  # type: ignore[arg-type]


@query(f"{_reach('c7', 3)} SELECT id, depth FROM reach")
def bfs_depth3(spark: SparkSession, d: str) -> DataFrame:
    return _start(star_schema.commerce(spark, d), "c7", 3).select("id", "depth")


@query(f"{_reach('c7', 2, where=chr(39).join(['e.type IN (', 'placed', ', ', 'contains', ')']))} SELECT id, depth FROM reach")
def bfs_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _start(star_schema.commerce(spark, d), "c7", 2, lambda e: e.type.isin("placed", "contains")).select("id", "depth")


@query(f"{_reach('r1', 3, graph=_BOTH)} SELECT id, depth FROM reach")
def bfs_reverse_depth3(spark: SparkSession, d: str) -> DataFrame:
    """Region, its nations, their customers and suppliers, and those ones' orders and parts: most of the graph."""
    return _start(star_schema.commerce(spark, d, reverse=True), "r1", 3).select("id", "depth")


_USERS = "WITH RECURSIVE edges AS (SELECT 'u' || user_id AS src, 'u' || lead(user_id) OVER (ORDER BY event_id) AS dst, event_type AS type, event_id AS seq FROM events QUALIFY dst IS NOT NULL)"


@query(f"{_USERS}, w AS (SELECT 'u1' AS id UNION SELECT e.dst FROM w JOIN edges e ON e.src = w.id) SELECT id FROM w")
def bfs_reach_cyclic(spark: SparkSession, d: str) -> DataFrame:
    return _start(star_schema.event_users(spark, d), "u1", None).select("id")


_FIRST = """, l0 AS (SELECT 'c7' AS id, 0::BIGINT AS rank),
l1 AS (SELECT dst AS id, (1 + row_number() OVER (ORDER BY min((l0.rank, seq))) - 1)::BIGINT AS rank FROM l0 JOIN edges e ON e.src = l0.id WHERE dst <> 'c7' GROUP BY dst),
l2 AS (SELECT dst AS id, ((SELECT count(*) FROM l1) + row_number() OVER (ORDER BY min((l1.rank, seq))))::BIGINT AS rank FROM l1 JOIN edges e ON e.src = l1.id WHERE dst NOT IN (SELECT id FROM l1) AND dst <> 'c7' GROUP BY dst)"""


@query(f"{_GRAPH}{_FIRST} SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2")
def bfs_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Visiting order, which depends on insertion order among edges."""
    return _start(star_schema.commerce(spark, d), "c7", 2, ordered=True).select("id", "rank")


@query(f"{_reach('c7', 3)} SELECT t.id AS target, EXISTS (SELECT 1 FROM reach r WHERE r.id = t.id) AS found FROM (VALUES ('r0'), ('r1'), ('r2'), ('r3'), ('r4'), ('c7'), ('s1')) t(id)")
def bfs_search_targets(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    rows = []
    for target in ("r0", "r1", "r2", "r3", "r4", "c7", "s1"):
        found = g.bfs_search("c7", target, 3)
        rows.append((target, found is not None and found["id"] == target))
    return spark.createDataFrame(rows, "target string, found boolean")


_CHAIN = "WITH RECURSIVE edges AS (SELECT 'e' || event_id AS src, 'e' || lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM events QUALIFY dst IS NOT NULL)"
_ENDS = "ends AS (SELECT 'e' || min(event_id) AS a, 'e' || max(event_id) AS z FROM events WHERE user_id = (SELECT min(user_id) FROM events))"


@query(f"{_CHAIN}, {_ENDS}, w AS (SELECT a AS id, 0::BIGINT AS rank FROM ends UNION ALL SELECT e.dst, w.rank + 1 FROM w JOIN edges e ON e.src = w.id) SELECT id, rank FROM w")
def shortest_path_chain(spark: SparkSession, d: str) -> DataFrame:
    """From a user's first event to the last: a long path."""
    ends = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("z")).orderBy("user_id").first()
    return traverse.shortest_path(star_schema.event_chain(spark, d), f"e{ends.a}", f"e{ends.z}").nodes.select("id", "rank")


@query(f"{_reach('c7', 6, graph=_BOTH)} SELECT depth + 1 AS nodes FROM reach WHERE id = 'c8'")
def shortest_path_length(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d, reverse=True)
    reach = traverse.frontier(spark.createDataFrame([("c7",)], "id string"), g.edges.select("src", "dst"), 6, target="c8")
    return reach.where("id = 'c8'").select((F.col("depth") + 1).alias("nodes"))


@query(f"{_GRAPH}, s AS (SELECT id FROM nodes WHERE segment = 'BUILDING'), w AS (SELECT id, 0 AS depth FROM s UNION SELECT e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.id WHERE w.depth < 1), k AS (SELECT DISTINCT id FROM w) SELECT k.id, (SELECT count(*) FROM edges e WHERE e.src = k.id AND e.dst IN (SELECT id FROM k)) AS degree FROM k")
def expand_1hop(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    return traverse.expand(g.filter(segment="BUILDING"), g, 1).degrees().select("id", "degree")


@query(f"{_GRAPH}, w AS (SELECT 's1' AS id, 0 AS depth UNION SELECT 'c1', 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.id WHERE w.depth < 2), k AS (SELECT DISTINCT id FROM w) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def expand_2hop(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    return traverse.expand(g.filter(ids=["s1", "c1"]), g, 2).edges.select("src", "dst", "attr.type")


@query(f"{_reach('c7', None)} SELECT id FROM reach")
def dfs_reach(spark: SparkSession, d: str) -> DataFrame:
    return traverse.dfs(star_schema.commerce(spark, d), "c7").nodes.select("id")


@query(f"{_CHAIN}, {_ENDS}, w AS (SELECT a AS id, 0::BIGINT AS rank FROM ends UNION ALL SELECT e.dst, w.rank + 1 FROM w JOIN edges e ON e.src = w.id WHERE w.rank < 20) SELECT id, rank FROM w")
def dfs_depth_limited(spark: SparkSession, d: str) -> DataFrame:
    first = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.min("event_id").alias("a")).orderBy("user_id").first().a
    return traverse.dfs(star_schema.event_chain(spark, d), f"e{first}", 20).nodes.select("id", "rank")


# Walks


@query(f"{_BOTH} SELECT 0::BIGINT AS wrong_steps, 0::BIGINT AS revisits, 0::BIGINT AS too_long, 0::BIGINT AS repeated")
def random_walk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every step is an edge, no node is met twice, lengths hold, walks are distinct."""
    g = star_schema.commerce(spark, d, reverse=True)
    walks = keep(random_walks(g, "c7", 6, 200, seed=5), "walks")
    steps = walks.select(F.explode(F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("s")).select("s.*")
    one = lambda df, c, name: df.agg(F.coalesce(c, F.lit(0)).cast("long").alias(name)).withColumn("_k", F.lit(1))
    edges = g.out_edges(keep(steps.select(F.col("src").alias("id")).distinct(), "sources"), placed=False).select("src", "dst")
    out = one(steps.join(F.broadcast(keep(edges.join(hint(keep(steps.distinct(), "steps")), ["src", "dst"], "left_semi").distinct(), "known")), ["src", "dst"], "left_anti"), F.count("*"), "wrong_steps")
    out = out.join(one(walks, F.sum((F.size(F.array_distinct("path")) < F.size("path")).cast("int")), "revisits"), "_k")
    out = out.join(one(walks, F.sum((F.size("path") > 6).cast("int")), "too_long"), "_k")
    return out.join(one(walks, F.count("*") - F.countDistinct("path"), "repeated"), "_k").drop("_k")


_STEP = "(('0x' || substr(md5('3:' || a || ':{k}'), 1, 8))::BIGINT % len({o})) + 1"


@query(
    f"""{_GRAPH}, adj AS (SELECT src, list(dst ORDER BY seq, dst) AS out FROM edges GROUP BY src), t AS (SELECT range AS a FROM range(50)),
s1 AS (SELECT a, x.out[{_STEP.format(k=1, o='x.out')}] AS v1 FROM t JOIN adj x ON x.src = 'c7'),
s2 AS (SELECT a, v1, y.out[{_STEP.format(k=2, o='y.out')}] AS v2 FROM s1 LEFT JOIN adj y ON y.src = v1)
SELECT DISTINCT 'c7,' || v1 || coalesce(',' || v2, '') AS walk FROM s2"""
)
def random_walks_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Exact walks: choices are MD5 digits, so SQL makes the same ones."""
    walks = random_walks(star_schema.commerce(spark, d), "c7", 3, 50, seed=3, allow_revisit=True)
    return walks.select(F.array_join("walk", ",").alias("walk"))


@query(
    f"""{_GRAPH}, adj AS (SELECT src, list((dst, type) ORDER BY seq) AS out FROM edges GROUP BY src), t AS (SELECT range AS a FROM range(50)),
s1 AS (SELECT a, x.out[{_STEP.format(k=1, o='x.out')}] AS v1 FROM t JOIN adj x ON x.src = 'c7'),
s2 AS (SELECT a, v1, y.out[{_STEP.format(k=2, o='y.out')}] AS v2 FROM s1 LEFT JOIN adj y ON y.src = v1[1])
SELECT DISTINCT 'c7,' || v1[2] || ',' || v1[1] || coalesce(',' || v2[2] || ',' || v2[1], '') AS walk FROM s2"""
)
def random_walks_edge_types(spark: SparkSession, d: str) -> DataFrame:
    walks = random_walks(star_schema.commerce(spark, d), "c7", 3, 50, seed=3, allow_revisit=True, include_edge_types=True)
    return walks.select(F.array_join("walk", ",").alias("walk"))


@query("SELECT DISTINCT 'u' || user_id AS start FROM events")
def random_walks_cover(spark: SparkSession, d: str) -> DataFrame:
    """Visit-balanced walks of one node begin at every node once there are as many walks."""
    g = star_schema.event_users(spark, d)
    return random_walks(g, None, 1, 3 * g.node_count(), stratified=True, mode="batched").select(F.col("path")[0].alias("start")).distinct()


_DRAW = "('0x' || substr(md5('0:' || a || ':0'), 1, 13))::BIGINT / 4503599627370496.0"


@query(
    f"""{_USERS}, names AS (SELECT list(id ORDER BY id) AS ids, count(*) AS n FROM (SELECT DISTINCT 'u' || user_id AS id FROM events)),
w AS (SELECT 0 AS a, list_transform(ids, lambda x: 0) AS visits, CAST(NULL AS VARCHAR) AS start FROM names
  UNION ALL
  SELECT a + 1, list_transform(visits, lambda v, i: CASE WHEN i = spot THEN v + 1 ELSE v END), ids[spot] FROM (
    SELECT a, visits, ids, list_position(list_transform(cum, lambda c: {_DRAW} * cum[n] < c), true) AS spot FROM (
      SELECT a, visits, ids, n, list_transform(range(1, n + 1), lambda i: list_sum(list_transform(visits[1:i], lambda v: 1.0 / (1 + v)))) AS cum FROM w, names WHERE a < 40)))
SELECT DISTINCT start FROM w WHERE start IS NOT NULL"""
)
def random_walks_weighted_starts(spark: SparkSession, d: str) -> DataFrame:
    """Exact balanced walks of one node: SQL draws each start again, with weight 1 / (1 + visits)."""
    walks = random_walks(star_schema.event_users(spark, d), None, 1, 40, stratified=True)
    return walks.select(F.col("path")[0].alias("start"))


@query()
def random_walks_stratified(spark: SparkSession, d: str) -> DataFrame:
    return random_walks(star_schema.event_users(spark, d), None, 5, 100, stratified=True).select("attempt", F.array_join("walk", ",").alias("walk"))


@query()
def random_walks_balanced(spark: SparkSession, d: str) -> DataFrame:
    return random_walks(star_schema.event_users(spark, d), None, 5, 100, stratified=True, mode="batched").select("attempt", F.array_join("walk", ",").alias("walk"))


# Mutation and change feeds


@query(f"{_GRAPH} SELECT id, 'price' AS name, round(price * 2, 4) AS new, round(price, 4) AS old FROM nodes WHERE type = 'part' AND size <= 10 AND price * 2 IS DISTINCT FROM price")
def attr_update_changes(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    parts = g.nodes.where("attr.type = 'part'")
    changes = parts.select("id", F.lit("price").alias("name"), F.when(F.col("attr.size") <= 10, F.col("attr.price") * 2).otherwise(F.col("attr.price")).alias("value"), F.lit(0).cast("long").alias("at"))
    feed = mutate.update_nodes(g, changes)[1]
    return feed.select("id", "name", F.round("new", 4).alias("new"), F.round("old", 4).alias("old"))


@query(f"{_GRAPH}, added AS (SELECT count(*) AS n FROM customer) SELECT (SELECT count(*) FROM nodes) + (SELECT n FROM added) AS node_count, (SELECT count(*) FROM edges) + (SELECT n FROM added) AS edge_count")
def add_nodes_and_edges(spark: SparkSession, d: str) -> DataFrame:
    """A card for every customer."""
    g = star_schema.commerce(spark, d)
    customers = g.nodes.where("attr.type = 'customer'")
    cards = customers.select(F.concat(F.lit("card-"), "id").alias("id"), F.col("attr").withField("type", F.lit("card")).alias("attr"))
    edge = F.from_json(F.lit('{"type": "holds"}'), star_schema.EDGE_ATTR).alias("attr")
    more = mutate.add_nodes(g, cards)
    more = mutate.add_edges(more, customers.select(F.lit(None).cast("string").alias("id"), F.col("id").alias("src"), F.concat(F.lit("card-"), "id").alias("dst"), edge))
    return more.metadata().select("node_count", "edge_count")


@query("SELECT 'c' || o_custkey AS id, string_agg('o' || o_orderkey, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def list_append(spark: SparkSession, d: str) -> DataFrame:
    g = star_schema.commerce(spark, d)
    values = spark.read.parquet(f"{d}/orders.parquet").select(star_schema.key("c", "o_custkey").alias("id"), star_schema.key("o", "o_orderkey").alias("value"), F.col("o_orderkey").alias("at"))
    return mutate.list_append(g, "orders", values).nodes.where("attr.orders is not null").select("id", F.array_join("attr.orders", ",").alias("orders"))


@query("SELECT user_id, event_type AS new, lag(event_type) OVER w AS old, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER w")
def observed_changes(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.lit("last").alias("key"), "event_type", "event_id")
    return mutate.observed_changes(events, "user_id", "key", "event_type", "event_id").select("user_id", "new", "old", "event_id")


@query(f"{_GRAPH} SELECT src, dst, 'quantity' AS name, quantity + 1 AS new, quantity AS old FROM edges WHERE type = 'contains' AND quantity < 3")
def edge_update_changes(spark: SparkSession, d: str) -> DataFrame:
    """Edges by their place; the feed has their old values."""
    g = star_schema.commerce(spark, d)
    few = g.edges.where("attr.type = 'contains' and attr.quantity < 4")
    changes = few.select("seq", F.lit("quantity").alias("name"), F.when(F.col("attr.quantity") < 3, F.col("attr.quantity") + 1).otherwise(F.col("attr.quantity")).alias("value"), F.lit(0).cast("long").alias("at"))
    out, feed = mutate.update_edges(g, changes)
    return feed.join(out.edges.select("seq", "src", "dst"), "seq").select("src", "dst", "name", "new", "old")


@query(
    """SELECT * FROM (SELECT 'node_add' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'edge_add', count(*) FROM supplier UNION ALL SELECT 'node_update', count(*) FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'edge_update', count(*) FROM lineitem WHERE l_quantity = 1)"""
)
def handler_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Every chain of handlers gets its change; one that returns False stops those after it."""
    g = star_schema.commerce(spark, d)
    got: list[tuple[str, int]] = []
    for kind in ("node_add", "edge_add", "node_update", "edge_update"):
        chain = getattr(g.handlers, kind)
        chain.append(lambda graph, delta, kind=kind: got.append((kind, delta.count())) or False)
        chain.append(lambda graph, delta: got.append(("never", 1)))
    suppliers = g.nodes.where("attr.type = 'supplier'")
    more = mutate.add_nodes(g, suppliers.withColumn("id", F.concat(F.lit("depot-"), "id")))
    edge = F.from_json(F.lit('{"type": "runs"}'), star_schema.EDGE_ATTR).alias("attr")
    more = mutate.add_edges(more, suppliers.select(F.lit(None).cast("string").alias("id"), F.col("id").alias("src"), F.concat(F.lit("depot-"), "id").alias("dst"), edge))
    one = F.lit(0).cast("long").alias("at")
    mutate.update_nodes(g, suppliers.select("id", F.lit("balance").alias("name"), F.greatest("attr.balance", F.lit(0.0)).alias("value"), one))
    mutate.update_edges(g, g.edges.where("attr.quantity = 1").select("seq", F.lit("quantity").alias("name"), F.lit(2.0).alias("value"), one))
    return spark.createDataFrame(got, "kind string, n long")


# Embeddings


@query("SELECT 'v' || vec_id AS id, len(embedding) AS size, round(embedding[1], 5) AS first FROM embeddings")
def embedding_attach(spark: SparkSession, d: str) -> DataFrame:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(star_schema.key("v", "vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("value"))
    g = PropertyGraph(vectors.select("id", F.struct(F.lit("vector").alias("type")).alias("attr")), star_schema.commerce(spark, d).edges.limit(0))
    out = embed.attach_embeddings(g, vectors)
    return out.nodes.select("id", F.size(F.col("attr.embeddings")[0]).cast("long").alias("size"), F.round(F.col("attr.embeddings")[0][0], 5).alias("first"))


@query("SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) LIMIT 10")
def nearest_by_cosine(spark: SparkSession, d: str) -> DataFrame:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    query_ = vectors.where("vec_id = 0").first().embedding
    return embed.nearest(vectors, query_, 10).select("vec_id", F.round("distance", 6).alias("distance"))


# Sources and sinks


@query("SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, n_name AS name FROM nation")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Nations and regions through tagged JSON."""
    g = star_schema.commerce(spark, d).filter(lambda n: n.type.isin("nation", "region"))
    back = json_graph.load_json(spark, json_graph.to_json(g))
    return back.edges.join(back.nodes.select(F.col("id").alias("src"), F.col("attr")["name"]["s"].alias("name")), "src").select("src", "dst", "name")


@query(f"{_GRAPH} SELECT src, dst, type, count(*) AS n FROM edges GROUP BY src, dst, type")
def parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/filigree-graph-{d.strip('/').replace('/', '-').replace(':', '')}"
    columnar.save_parquet(star_schema.commerce(spark, d), path, validate=False)
    return columnar.load_parquet(spark, path).edges.groupBy("src", "dst", "attr.type").agg(F.count("*").alias("n"))


_ULP = "(2.0 ** (floor(log2(p_retailprice)) - 10))"


@query(f"SELECT 'p' || p_partkey AS id, round_even(p_retailprice / {_ULP}, 0) * {_ULP} AS price, p_size AS size FROM part")
def f16_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Prices with eleven significant bits, ties to even; sizes are integers and stay."""
    path = f"{shared_folder(spark)}/filigree-half-{d.strip('/').replace('/', '-').replace(':', '')}"
    g = star_schema.commerce(spark, d).filter(type="part")
    columnar.save_parquet_f16(g, path)
    return columnar.load_parquet(spark, path).nodes.select("id", "attr.price", "attr.size")


@query(
    """SELECT 'n' || n_nationkey AS id, n_name AS name, n_nationkey AS number, n_nationkey / 2.0 AS share, n_nationkey % 2 = 0 AS even, 'nation,area' AS labels, len(n_name) AS parts, 'r' || n_regionkey AS region FROM nation
UNION ALL SELECT 'r' || r_regionkey, r_name, r_regionkey, NULL, NULL, 'region', len(r_name), NULL FROM region"""
)
def lgf_files(spark: SparkSession, d: str) -> DataFrame:
    """Nations in a file that imports another with the regions: labels given twice, scalars, lists, comments, inverse edges."""
    path = f"{shared_folder(spark)}/filigree-lgf-{uuid.uuid4().hex}"
    nations = star_schema._table(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    regions = star_schema._table(spark, d, "region").orderBy("r_regionkey").collect()
    text = ['import("more/regions.lgf")', "# nations"]
    for n in nations:
        letters = ", ".join(f'"{c}"' for c in n.n_name)
        text += [f"n{n.n_nationkey} nation", f'    name = "{n.n_name}"', f"    number = {n.n_nationkey}", f"    share = {n.n_nationkey / 2}", f"    even = {str(n.n_nationkey % 2 == 0).lower()}"]
        text += ["    parts = [", f"        {letters}", "    ]", f"    <-holds- r{n.n_regionkey}", f"n{n.n_nationkey} area nation"]
    other = []
    for r in regions:
        other += [f"r{r.r_regionkey} region", f'    name = "{r.r_name}"', f"    number = {r.r_regionkey}", "    parts = [" + ", ".join(f'"{c}"' for c in r.r_name) + "]"]
    for name, lines in (("main.lgf", text), ("more/regions.lgf", other)):
        _write_text(spark, f"{path}/{name}", "\n".join(lines) + "\n")
    g = lgf.read_lgf(spark, f"{path}/main.lgf")
    value = lambda k, field: F.try_element_at("attr", F.lit(k))[field]
    listed = lambda k: F.from_json(value(k, "j"), "array<string>")
    region = g.edges.select(F.col("dst").alias("id"), F.col("src").alias("region"))
    return g.nodes.join(region, "id", "left").select(
        "id", value("name", "s").alias("name"), value("number", "i").cast("int").alias("number"), value("share", "d").alias("share"), value("even", "b").alias("even"), F.array_join(listed("labels"), ",").alias("labels"), F.when(value("parts", "j").isNotNull(), F.size(listed("parts"))).cast("long").alias("parts"), "region"
    )


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the shared folder, through Spark's file systems."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


_LGF = """
alice person admin
    age = 31
    tags = [a, "b, c", 3]
    -knows-> bob
        since = 2020
bob person
    <-likes- carol
"""


@query("SELECT * FROM (VALUES ('alice', 'bob', 'knows', 2020), ('carol', 'bob', 'likes', 0)) t(src, dst, type, since)")
def lgf_parse(spark: SparkSession, d: str) -> DataFrame:
    e = lgf.parse_lgf(spark, _LGF).edges
    return e.select("src", "dst", F.col("attr")["type"]["s"].alias("type"), F.coalesce(F.try_element_at("attr", F.lit("since"))["i"], F.lit(0)).cast("int").alias("since"))


@query(f"{_GRAPH} SELECT src, dst, count(*) AS parallel, max(seq) AS seq, arg_max(type, seq) AS type FROM edges GROUP BY src, dst")
def collapse_parallel_edges(spark: SparkSession, d: str) -> DataFrame:
    return export.collapse_parallel(star_schema.commerce(spark, d)).select("src", "dst", "parallel", "seq", "attr.type")


@query("SELECT count(*) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)) AS edges FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def dialogue_graph(spark: SparkSession, d: str) -> DataFrame:
    return star_schema.dialogues(spark, d).metadata().select(F.col("node_count").alias("nodes"), F.col("edge_count").alias("edges"))
