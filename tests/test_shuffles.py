"""What moves between machines, and that results don't depend on it."""

import re

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import graph as G
from strandgraph.plans import graph_queries as Q2
from strandgraph.plans import record_queries as Q


def moved(df):
    """The keys of every hash exchange of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)]


@pytest.mark.parametrize("name", ["conversation_build", "chat_messages", "extract_question", "conversation_plain", "triplet_source_stats", "attach_first_k"])
def test_records_are_moved_by_study_only(spark, folder, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [k for k in moved(Q.QUERIES[name](spark, folder)) if not k.startswith("branch")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found and all(k.startswith("subject_id, study_id, ") and "img_id" not in k and "sentence_id" not in k for k in found)


def test_edges_are_combined_without_sorting_and_stay_where_they_are(spark, folder):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    edges = Q2.fx.kg_edges(spark, folder)
    text = G.dedupe_edges(edges)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "HashAggregate" in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")  # less than the nodes, more than the unknown ends
    try:
        nodes = G.clean_nodes(Q2.fx.kg_nodes(spark, folder))
        known = G.drop_dangling(G.dedupe_edges(edges), nodes)
        assert not [k for k in moved(known) if "start_id" in k or "end_id" in k]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges_with_nulls_equal_values_and_more_columns(spark):
    rows = [("t", "d", "1", "2", 3, 0.5), ("d", "t", "2", "1", 2, None), ("t", None, "1", "1", 4, 1.5), (None, "t", "1", "1", 5, 2.5), ("x", "x", "x", "x", 6, 3.5), ("t", "d", None, "2", 7, 4.5)]
    edges = spark.createDataFrame(rows, "rel_type string, display_relation string, start_id string, end_id string, ord long, weight double")
    kept = {tuple(rows[i]) for i in (1, 2, 4, 5)}
    assert {tuple(r) for r in G.dedupe_edges(edges).collect()} == kept
    assert {tuple(r) for r in G.dedupe_edges(edges.drop("weight")).collect()} == {r[:5] for r in kept}
    nodes = spark.createDataFrame([("1",), ("2",), (None,)], "node_index string")
    assert {r["ord"] for r in G.drop_dangling(G.dedupe_edges(edges), nodes).collect()} == {2, 4}
    assert G.drop_dangling(edges.limit(0), nodes).count() == 0 and G.drop_dangling(edges, nodes.limit(0)).count() == 0


def test_the_ontology_is_not_made_again_for_every_use(spark, folder, monkeypatch):
    plans, write = [], G.materialize

    def seen(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(G, "materialize", seen)
    monkeypatch.setattr(Q2, "materialize", seen, raising=False)
    last = Q2.onto_chains(spark, folder)._jdf.queryExecution().executedPlan().toString()
    scans = sum(len(re.findall(r"FileScan parquet.*lineitem\.parquet", p)) for p in [*plans, last])
    assert 1 <= scans <= 3  # the index, the rows, the relations of the classes that occur
    assert "lineitem" not in last and last.count("Exchange hashpartitioning") == 1  # rows are moved once, to their digest


def test_chains_with_names_that_meet_repeated_neighbours_and_nulls(spark):
    rows = [
        ("i", ["b suggestive of A", None, "a suggestive of c", "plain"]), ("i", ["b suggestive of A", None, "a suggestive of c", "plain"]),
        (None, ["x suggestive of c"]), (None, None), ("k", [None]), ("", []),
    ]
    rows = spark.createDataFrame(rows, "img_id string, triplets array<string>")
    links = spark.createDataFrame([("a", "Node"), ("b", "node"), ("c", "Node"), ("x", "")], "entity string, canonical string")
    near = [("node", "May_Cause", "n1", 1), ("node", "May_Cause", "n1", 2), ("node", None, "n2", 3)]
    near = spark.createDataFrame(near, "node_name string, edge string, neighbor string, rank int")
    for table in (near, lambda names: near.join(names, "node_name", "left_semi")):
        found = G.chains(rows, links, table, use_subject=True, sentence=lambda s, r, o, e, n: F.concat_ws(":", s, o, e, n), fold_node_case=True)
        got = sorted(((r["img_id"], r["triplets"], r["chains"]) for r in found.collect()), key=str)
        full = ("i", ["b suggestive of A", "a suggestive of c", "plain"], ["b:A:May_Cause:n1", "b:A:n2", "b:A:May_Cause:n1", "b:A:n2"])
        assert got == sorted([full, full, (None, ["x suggestive of c"], ["x:c:May_Cause:n1", "x:c:n2"]), (None, [], []), ("k", [], []), ("", [], [])], key=str)


def test_index_of_repeated_triples_and_several_labels(spark):
    triples = [("B_1", "label", "Two", "en", 5), ("B_1", "label", "One", None, 4), ("A_1", "label", "one", "en", 6), ("A_1", "is_a", "x", None, 1), ("C_1", "label", "un", "fr", 3)]
    triples = spark.createDataFrame(triples, "subject string, predicate string, object string, lang string, ord long")
    for t in (triples, triples.unionAll(triples)):
        got = {tuple(r) for r in G.label_index(t).collect()}
        assert got == {("one", "A_1", "one"), ("two", "B_1", "One"), ("c 1", "C_1", "C 1")}
        assert {tuple(r) for r in G.label_index(t, always_local=True).collect()} == got | {("a 1", "A_1", "one"), ("b 1", "B_1", "One")}
