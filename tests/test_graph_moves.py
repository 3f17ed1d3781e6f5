"""What the graph queries move, and that their steps give what the plain ones gave."""

import re

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import graph as G
from strandgraph.plans import graph_queries as Q


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves(plan):
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)]


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that a query stores on its way."""
    found, write, by = [], G.materialize, Q.materialize_by if hasattr(Q, "materialize_by") else None
    seen = lambda f: lambda df, *a, **b: (found.append(text(df)), f(df, *a, **b))[1]
    for module in (G, Q):
        monkeypatch.setattr(module, "materialize", seen(write))
    if by:
        monkeypatch.setattr(Q, "materialize_by", seen(by))
    return found


def test_edges_of_a_subgraph_move_once_to_each_end(spark, folder, plans):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")  # less than the nodes, more than the unknown ends
    try:
        last = text(Q.kg_subgraph_three(spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [k for p in [*plans, last] for k in moves(p) if k.startswith(("edge_id", "src, dst"))]
    assert sum(k.startswith(("start_id", "end_id")) for k in moves(last)) == 2


def test_order_lines_of_the_chains_are_read_once(spark, folder, plans):
    last = text(Q.kg_chains(spark, folder))
    scans = sum(len(re.findall(r"FileScan parquet.*lineitem\.parquet", p)) for p in [*plans, last])
    assert scans == 3  # two kinds of edges, and the rows, which the vocabulary is taken from


def test_rows_of_an_order_stay_together_for_their_coverage(spark, folder, plans):
    last = text(Q.chain_coverage(spark, folder))
    assert not [k for k in moves(last) if "img_id" in k or "study_id" in k]
    assert sum(len(re.findall(r"FileScan parquet.*lineitem\.parquet", p)) for p in [*plans, last]) == 3


def test_subgraph_of_repeated_nodes_edges_and_loops(spark):
    nodes = spark.createDataFrame([("1", "disease", "a"), ("2", "x", "b"), ("2", "x", "b2"), ("3", "x", "c"), ("4", "x", "d"), ("5", "x", "e")], "node_index string, label string, node_name string")
    rows = [(10, "1", "2"), (11, "2", "1"), (11, "2", "1"), (12, "2", "3"), (13, "3", "4"), (14, "4", "5"), (15, "1", "1"), (None, "1", "2"), (16, "9", "1"), (17, "5", "5")]
    edges = spark.createDataFrame([(i, a, b, "t") for i, a, b in rows], "edge_id long, start_id string, end_id string, rel_type string")
    seeds = spark.createDataFrame([("1",), ("1",), ("3",)], "node_index string")
    found = lambda hops: sorted((r["edge_id"], r["src_name"], r["dst_name"]) for r in G.subgraph_within(nodes, edges, seeds, hops).collect())
    one = [(10, "a", "b"), (10, "a", "b2"), *[(11, b, "a") for b in ("b", "b", "b2", "b2")], (15, "a", "a")]
    two = [(12, "b", "c"), (12, "b2", "c")]
    assert found(1) == sorted(one) and found(2) == sorted(one + two) and found(3) == sorted([*one, *two, (13, "c", "d")])


def test_neighbors_of_names_are_those_of_all(spark):
    nodes = spark.createDataFrame([(str(i), f"n{i % 7}") for i in range(20)], "node_index string, node_name string")
    kinds = ["disease_disease", "phenotype_phenotype", "other"]
    edges = spark.createDataFrame([(i, str(i * i % 20), str(i * 7 % 20), kinds[i % 3]) for i in range(80)], "edge_id long, start_id string, end_id string, rel_type string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    every = G.neighbors(nodes, edges, max_degree=15, k=4)
    some = G.neighbors(nodes, edges, spark.createDataFrame([("n1",), ("n1",), ("n5",), (None,)], "node_name string"), max_degree=15, k=4)
    assert rows(some) == rows(every.where(F.col("node_name").isin("n1", "n5"))) and some.count()
    name = {str(i): f"n{i % 7}" for i in range(20)}
    ways = [(a, b, e["rel_type"]) for e in edges.collect() for a, b in {(e["start_id"], e["end_id"]), (e["end_id"], e["start_id"])}]
    degree = {x: sum(a == x for a, _, _ in ways) for x in name}
    plain = []
    for n in set(name.values()):
        near = sorted((kind, name[b]) for a, b, kind in ways if name[a] == n and kind != "other" and degree[b] < 15)
        plain += [(n, kind, b, i + 1) for i, (kind, b) in enumerate(near[:4])]
    assert rows(every) == sorted(plain)
