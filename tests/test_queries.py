"""A few queries against their SQL on the smallest tables; that the entry module holds together."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() >= 10


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_views_of_the_session_stay(spark):
    spark.range(3).createOrReplaceTempView("lineitem")
    entry.queries()["clean_arcs"](spark, SF).count()
    assert spark.table("lineitem").count() == 3
    spark.catalog.dropTempView("lineitem")


def test_a_missing_text_library_leaves_the_graph_queries(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "wayfare.llm.queries", None)
    monkeypatch.delattr(sys.modules.get("wayfare.llm") or sys, "queries", raising=False)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "farness" in entry.queries() and not any(n.startswith("op1") for n in entry.queries()) and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", ["bfs_accounting", "topk_sweep", "merged_array", "cleaned_text", "isolated_text_nodes", "snapshot_roundtrip", "sortedness_check", "clean_arcs", "dense_ids", "component_count", "all_measures", "measures_directed", "ht_farness", "progressive_batch1"])
def test_query_equals_sql(spark, name):
    got, want = entry.queries()[name](spark, SF), tables().sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", ["level_histogram_distributed", "farness", "threshold_topk", "ground_truth_array_roundtrip", "estimate_error", "precision_at_k", "bfs_accounting", "bfs_frontier"])
def test_query_beyond_the_broadcast_needs_no_sweeps(spark, monkeypatch, name):
    """As on graphs that are too large for a broadcast: no sweep of a few sources after the other, with a join for each of its levels."""
    from wayfare.operators import traversal

    monkeypatch.setattr(traversal.Graph, "arrays", lambda self: None)
    monkeypatch.setattr(traversal, "swept", None)
    test_query_equals_sql(spark, name)


@pytest.mark.parametrize("name", ["bfs_accounting", "estimate_error", "threshold_topk", "precision_at_k"])
def test_query_beyond_a_task_needs_no_sweeps(spark, monkeypatch, name):
    """As on graphs that no task can hold: searches go by parts of whole components."""
    from wayfare.operators import structure, traversal

    monkeypatch.setattr(traversal.Graph, "reader", lambda self: None)
    monkeypatch.setattr(traversal.Graph, "files", lambda self: None)
    monkeypatch.setattr(traversal, "swept", None)
    monkeypatch.setattr(structure, "spanned", None)
    test_query_equals_sql(spark, name)
