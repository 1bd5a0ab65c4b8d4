"""Text, JSON and Parquet, and changes over streams."""

import json

import pytest
from filigree import PropertyGraph, parse_lgf, parse_lgf_file
from filigree.sources import columnar, export, json_graph, lgf
from filigree.sources.lgf import LgfError, parse, scalar


def attrs(graph):
    return export.to_dict(graph)


def links(graph):
    return [(r.src, r.dst, {k: (v.s or v.i) for k, v in r.attr.items()}) for r in graph.edges.orderBy("seq").collect()]


def test_scalars():
    assert [scalar(x) for x in ("3", "-3", "2.5", "1e3", '"a b"', "'c'", "TRUE", "false", "x y", "")] == [3, -3.0, 2.5, 1000.0, "a b", "c", True, False, "x y", ""]
    assert lgf.items('1, 2.5, "a, b", true, x') == [1, 2.5, "a, b", True, "x"]


def test_nodes_edges_attributes():
    r = parse('# note\nalice person admin\n  age = 31\n  tags = [a, b]\n  many = [\n    "x",\n    2,\n  ]\n  -knows-> bob\n    since = 2020\n  city = "Bonn"\n  <-likes- zoë\nalice person vip\n')
    assert r.nodes["alice"] == {"labels": ["person", "admin", "vip"], "age": 31, "tags": ["a", "b"], "many": ["x", 2], "city": "Bonn"}
    assert r.edges == [("alice", "bob", {"type": "knows", "since": 2020}), ("zoë", "alice", {"type": "likes"})]
    assert r.nodes["bob"] == {} and "labels" not in r.nodes["zoë"]


def test_old_arrow_is_an_attribute_and_hyphens_work():
    r = parse("a x\n  -> b knows\n  <-made-by- c-d\n  -is_a-> e\n  flag\n")
    assert r.nodes["a"]["-> b knows"] == "" and r.nodes["a"]["flag"] == ""
    assert r.edges == [("c-d", "a", {"type": "made-by"}), ("a", "e", {"type": "is_a"})]


def test_list_on_an_edge():
    r = parse("a\n  -r-> b\n    l = [\n      1\n      2\n    ]\n    k = v\n  z = 1\n")
    assert r.edges[0][2] == {"type": "r", "l": [1, 2], "k": "v"} and r.nodes["a"]["z"] == 1


def test_imports_and_errors(spark, tmp_path):
    (tmp_path / "one.lgf").write_text('a person\nimport("two.lgf")\nc person\n  -r-> b\n', encoding="utf-8")
    (tmp_path / "two.lgf").write_text("b person\n  x = 1\n", encoding="utf-8")
    g = parse_lgf_file(spark, str(tmp_path / "one.lgf"))
    assert attrs(g) == {"a": {"labels": ["person"]}, "b": {"labels": ["person"], "x": 1}, "c": {"labels": ["person"]}} and len(links(g)) == 1
    (tmp_path / "two.lgf").write_text("import(one.lgf)\n", encoding="utf-8")
    with pytest.raises(LgfError):
        parse_lgf_file(spark, str(tmp_path / "one.lgf"))
    with pytest.raises(LgfError):
        parse("  x = 1\n")
    with pytest.raises(OSError):
        parse_lgf_file(spark, str(tmp_path / "none.lgf"))


def test_appending_and_many_files(spark, tmp_path):
    first = parse_lgf(spark, "a person\n  -r-> b\n")
    g = parse_lgf(spark, "a vip\n  x = 1\n  -s-> c\n", first)
    assert attrs(g)["a"] == {"labels": ["person", "vip"], "x": 1} and [x[:2] for x in links(g)] == [("a", "b"), ("a", "c")]
    (tmp_path / "1.lgf").write_text("a person\n  -r-> b\n")
    (tmp_path / "2.lgf").write_text("b thing\n  y = 2\n  -s-> a\na extra\n")
    g = lgf.read_lgf(spark, str(tmp_path))
    assert attrs(g) == {"a": {"labels": ["person", "extra"]}, "b": {"labels": ["thing"], "y": 2}} and [x[:2] for x in links(g)] == [("a", "b"), ("b", "a")]


VALUES = {"i": 2, "f": 2.5, "b": True, "n": None, "s": "x", "l": [1, "a", [2.5]], "d": {"k": 1}, "inf": float("inf")}


def test_json_round_trip(spark, tmp_path):
    g = PropertyGraph.from_records(spark, [("a", VALUES), ("b", {})], [("a", "b", {"w": 1}), ("a", "b", {"w": 2})], {"m": 1})
    path = str(tmp_path / "g.json")
    json_graph.save_json(g, path)
    for source in (path, json_graph.to_json(g), json.loads(json_graph.to_json(g))):
        back = json_graph.load_json(spark, source)
        assert attrs(back) == {"a": VALUES, "b": {}} and back.edge_count() == 2 and back.meta == {"m": 1}
        assert {r.id for r in back.edges.collect()} == {"edge_0_a_to_b", "edge_1_a_to_b"}
    doc = json.loads(json_graph.to_json(g))
    assert doc["nodes"]["a"]["attr"]["i"] == {"Int": 2} and doc["nodes"]["a"]["attr"]["n"] == "None" and doc["metadata"]["edge_count"] == 2
    assert doc["nodes"]["b"]["inverse_edge_ids"] == ["edge_0_a_to_b", "edge_1_a_to_b"]


def test_json_leniency_and_errors(spark, tmp_path):
    plain = json_graph.load_json(spark, {"nodes": {"a": {"id": "a", "attr": {"x": 1}}}, "edges": {}})
    assert attrs(plain) == {"a": {"x": 1}}
    with pytest.raises(TypeError):
        json_graph.load_json(spark, 5)
    with pytest.raises(RuntimeError):
        json_graph.load_json(spark, str(tmp_path / "none.json"))
    with pytest.raises(RuntimeError):
        json_graph.load_json(spark, "{broken")
    with pytest.raises(ValueError):
        json_graph.load_json(spark, {"nodes": {"a": {"id": "a"}}, "edges": {"e": {"id": "e", "from_id": "a", "to_id": "zz"}}})
    with pytest.raises(RuntimeError):
        json_graph.save_json(plain, str(tmp_path / "no" / "way.json"))


def test_parquet_and_half_precision(spark, tmp_path):
    g = PropertyGraph.from_records(spark, [("a", {"f": 0.1, "i": 3, "l": [0.1, 1, "x"], "n": None}), ("b", {})], [("a", "b", {"w": 0.2})], {"m": [1]})
    columnar.save_parquet(g, str(tmp_path / "p"))
    back = columnar.load_parquet(spark, str(tmp_path / "p"))
    assert attrs(back) == attrs(g) and back.meta == {"m": [1]} and back.edge_count() == 1
    columnar.save_parquet_f16(g, str(tmp_path / "h"))
    half = columnar.load_parquet(spark, str(tmp_path / "h"))
    assert attrs(half) == {"a": {"f": 0.0999755859375, "i": 3, "l": [0.0999755859375, 1, "x"], "n": None}, "b": {}}
    assert half.edges.first().attr["w"]["d"] == pytest.approx(0.2, rel=1e-3) and half.edges.first().attr["w"]["d"] != 0.2
    with pytest.raises(RuntimeError):
        columnar.load_parquet(spark, str(tmp_path / "none"))


def test_networkx_is_optional(spark):
    g = PropertyGraph.from_records(spark, [("a", {}), ("b", {})], [("a", "b", {"w": 1, "k": 1}), ("a", "b", {"w": 2})])
    try:
        import networkx  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            export.to_networkx(g)
    else:
        assert export.to_networkx(g)["a"]["b"] == {"w": 2, "k": 1}


def test_streams(spark, tmp_path):
    from filigree.streaming import changes

    schema = "owner string, key string, value string, at long"
    for k, rows in enumerate(([("o", "foo", "1", 0), ("o", "foo", "1", 1)], [("o", "foo", "2", 2), ("p", "foo", "1", 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, never = [], []
    query = changes.watch(changes.observed_stream(stream), [lambda g, d: seen.extend(tuple(r) for r in d.collect()) or None, lambda g, d: False, lambda g, d: never.append(1)], checkpoint=str(tmp_path / "c"))
    query.awaitTermination(90)
    assert sorted(seen, key=repr) == sorted([("o", "foo", "1", None, 0), ("o", "foo", "2", "1", 2), ("p", "foo", "1", None, 3)], key=repr) and not never


def test_merged_nodes_keep_kinds(spark):
    """Whole numbers stay whole, beyond 2**53 too, where a node is given twice."""
    first = lgf.parse_lgf(spark, f"x p\n    n = {2**60 + 1}\n    f = 2.5\n    b = true\n    l = [1, 2]\n")
    attr = lgf.parse_lgf(spark, "x q\n    m = 4\n", first).nodes.first().attr
    assert {k: v.t for k, v in attr.items()} == {"n": "Int", "f": "Float", "b": "Bool", "l": "List", "m": "Int", "labels": "List"}
    assert (attr["n"].i, attr["m"].i, attr["f"].d, attr["b"].b, attr["l"].j, attr["labels"].j) == (2**60 + 1, 4, 2.5, True, "[1, 2]", '["p", "q"]')
