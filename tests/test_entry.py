"""The driver's contract, and the catalogue against its SQL on the smallest tables."""

import importlib
import os
import sys

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = "graph_metadata has_node degrees filter_attr_eq filter_lambda filter_not_missing has_edge induced_subgraph_edges prune_count edge_lambda_filter bfs_filtered bfs_ordered bfs_reach_cyclic shortest_path_chain expand_2hop dfs_depth_limited random_walks_uniform attr_update_changes list_append observed_changes collapse_parallel_edges".split()

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: "" if x is None or x != x else (f"{float(x):.6f}" if not isinstance(x, (str, bool)) else str(x))
    return sorted(tuple(plain(x) for x in r) for r in frame.itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", CHEAP)
def test_catalogue_against_sql(spark, name):
    from filigree.plans import catalogue

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@needs_data
def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_text_operators(monkeypatch):
    import __spark_entry__
    from filigree.plans import catalogue

    for name in list(sys.modules):
        if name.startswith(("filigree.llm", "corpus_pipeline")):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "filigree.llm", None)
    again = importlib.reload(__spark_entry__)
    assert set(again.queries()) == set(catalogue.QUERIES)
