"""What a query looks at and sends about: these keep its cost from growing faster than the tables."""

import re

import pytest
from filigree import PropertyGraph
from filigree.operators import traverse
from filigree.operators.walks import random_walks
from filigree.sources import columnar, json_graph, star_schema
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def guarded(spark, reverse=False):
    """The commerce graph, and the same with edges that can't all be read."""
    g = star_schema.commerce(spark, DATA, reverse)
    return PropertyGraph(g.nodes, g.edges), PropertyGraph(g.nodes, g.edges.withColumn("src", F.raise_error(F.lit("all edges were read")).cast("string")), leaving=g.leaving)


def found(walks):
    return [(r.attempt, r.path, r.types) for r in walks.orderBy("attempt").collect()]


@pytest.mark.parametrize("typed", [False, True])
def test_walks_read_the_edges_of_their_ends(spark, typed):
    """F1, F12."""
    plain, guard = guarded(spark)
    got, want = (found(random_walks(g, "c7", 3, 30, seed=3, allow_revisit=True, include_edge_types=typed)) for g in (guard, plain))
    assert got == want and len(got) > 1


def test_long_walks_read_the_edges_of_their_ends(spark):
    """also against the keys, from where a line's place is found by its order."""
    plain, guard = guarded(spark, reverse=True)
    got, want = (found(random_walks(g, "c7", 5, 25, seed=5)) for g in (guard, plain))
    assert got == want and max(len(p) for _, p, _ in got) == 5


def test_walks_that_avoid_their_past_choose_as_from_a_list(spark):
    """A walk's choice among the edges to nodes it has not met, with parallel ones, drawn again here."""
    import hashlib
    import random

    rng = random.Random(2)
    edges = [(f"v{rng.randrange(6)}", f"v{rng.randrange(7)}") for _ in range(60)]
    g = PropertyGraph.from_records(spark, [(f"v{i}", {}) for i in range(7)], edges + [("v0", "nowhere")])
    want = {}
    for attempt in range(60):
        path = ["v0"]
        while len(path) < 6 and (ways := [b for a, b in edges if a == path[-1] and b not in path]):
            path.append(ways[int(hashlib.md5(f"9:{attempt}:{len(path)}".encode()).hexdigest()[:8], 16) % len(ways)])
        want.setdefault(tuple(path), attempt)
    assert {tuple(p): a for a, p, _ in found(random_walks(g, "v0", 6, 60, seed=9))} == want


def test_balanced_walks_of_one_node_read_no_edges(spark):
    """F2."""
    nodes = [(f"k{i:02}", {}) for i in range(12)]
    lone = PropertyGraph.from_records(spark, nodes, [("k01", "k02")])
    guard = lone.replace(edges=lone.edges.withColumn("dst", F.raise_error(F.lit("edges were read")).cast("string")))
    assert found(random_walks(guard, None, 1, 30, stratified=True)) == found(random_walks(lone, None, 1, 30, stratified=True)) != []


def test_balanced_walks_send_numbers_to_their_task(spark, monkeypatch):
    """no ids and no types, and the same choices as from lists of them."""
    import hashlib
    import random
    from collections import Counter

    frame = type(spark.range(1))
    sent, real = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: (sent.append(self.schema.simpleString()), real(self, *a, **k))[1])
    rng = random.Random(4)
    names = [f"v{i}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice([*names, "nowhere"]), rng.choice(["x", "y"])) for _ in range(150)]
    g = PropertyGraph.from_records(spark, [(n, {}) for n in names], [(a, b, {"type": t}) for a, b, t in edges])
    seen, want = Counter(), []

    def choose(options, of, *at):
        weights = [1 / (1 + seen[of(o)]) for o in options]
        left = int(hashlib.md5(":".join(map(str, (6, *at))).encode()).hexdigest()[:13], 16) / 16**13 * sum(weights)
        for o, w in zip(options, weights):
            left -= w
            if left < 0:
                return o
        return options[-1]

    for attempt in range(50):
        path, types = [choose(sorted(names), lambda x: x, attempt, 0)], []
        seen[path[0]] += 1
        while len(path) < 5 and (ways := [(b, t) for a, b, t in edges if a == path[-1] and b in names and b not in path]):
            to, kind = choose(ways, lambda e: e[0], attempt, len(path))
            path.append(to)
            types.append(kind)
            seen[to] += 1
        if path not in [p for _, p, _ in want]:
            want.append((attempt, path, types))
    assert found(random_walks(g, None, 5, 50, stratified=True, seed=6)) == want
    assert sent == ["struct<src:int,r:int,dst:int>"]


def test_python_edge_filters_join_and_place_nothing_they_do_not_ask_for(spark):
    """F4."""
    from filigree.functions.views import asks_for_ends

    g = star_schema.commerce(spark, DATA)
    few = g.where_edges(lambda e: e.type == "contains" and e.attr("quantity", 0) > 45 and e.to_id[-1] == "7").select("src", "dst", "attr.quantity")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and few.count() == g.edges.where("attr.type = 'contains' and attr.quantity > 45 and dst like '%7'").count() > 0
    limit, inner = 3, lambda e: e.from_node.id == "c1"
    assert not asks_for_ends(lambda e: e.attr("n", 0) > limit and len(e.to_id) > 2)
    for other in (inner, lambda e: inner(e) and True, lambda e: getattr(e, "from_" + "node").id == "c1", lambda e: any(x.to_node for x in [e]), lambda e: "{0.to_node}".format(e) == "", print):
        assert asks_for_ends(other)


def test_depth_first_reads_the_edges_of_what_it_reaches(spark, monkeypatch):
    """F6."""
    monkeypatch.setattr(traverse, "LOCAL_EDGES", 0)
    plain, guard = guarded(spark)
    got, want = (sorted((r.id, r.rank) for r in traverse.dfs(g, "c7").nodes.collect()) for g in (guard, plain))
    assert got == want and len(got) > 5


def test_ordered_breadth_first_reads_the_edges_of_its_levels(spark, monkeypatch):
    """F7."""
    monkeypatch.setattr(traverse, "LOCAL_EDGES", 0)
    plain, guard = guarded(spark)
    got, want = (sorted((r.id, r.rank, r.parent or "") for r in traverse.visit(g, ["c7"], 2, ordered=True).collect()) for g in (guard, plain))
    assert got == want and len(got) > 5


def test_documents_read_the_edges_of_their_nodes(spark):
    """F9."""
    plain, guard = guarded(spark)
    docs = [json_graph.to_json(g.filter(lambda n: n.type.isin("nation", "region"))) for g in (guard, plain)]
    first, second = (re.sub('"timestamp": "[^"]*"', "", d) for d in docs)
    assert sorted(first.splitlines()) == sorted(second.splitlines()) and '"edge_count": 25' in first


def test_files_of_some_nodes_read_the_edges_of_those(spark, tmp_path):
    """F10."""
    _, guard = guarded(spark)
    columnar.save_parquet_f16(guard.filter(type="part"), str(tmp_path / "g"))
    back = columnar.load_parquet(spark, str(tmp_path / "g"))
    assert back.nodes.count() == guard.nodes.where("attr.type = 'part'").count() > 0 and back.edges.count() == 0


def test_sets_of_neighbours_are_made_after_their_shuffle(spark):
    """F8: sets of a split's sources before it hold the whole split in a task."""
    g = star_schema.commerce(spark, DATA)
    plan = g.where_nodes(lambda n: F.array_contains(n.neighbor_ids, "p1"))._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if re.search(r"collect_set|Exchange hashpartitioning\(id", x)]
    at = next(i for i, x in enumerate(lines) if "partial_collect_set" in x)
    assert "collect_set" in lines[at - 1] and "Exchange" in lines[at + 1]


def test_saved_tables_are_packed_well(spark, tmp_path):
    """F11."""
    g = star_schema.commerce(spark, DATA)
    columnar.save_parquet(g, str(tmp_path / "g"), validate=False)
    files = [f.name for part in ("nodes", "edges") for f in (tmp_path / "g" / part).glob("*.parquet")]
    assert files and all(".zstd." in f for f in files)
