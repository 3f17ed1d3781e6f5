"""Registered queries: the property graph, chains and the ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.functions import text as t
from strandgraph.operators import graph as G
from strandgraph.operators import linking as L
from strandgraph.operators import triplets as T
from strandgraph.plans import fixtures as fx
from strandgraph.plans.fixtures import add_view, with_views
from strandgraph.session import materialize, materialize_by

_EDGE_COLUMNS = ["rel_type", "display_relation", "start_id", "end_id", "edge_id"]


def graph(spark, d):
    nodes, edges = G.prepare(fx.kg_nodes(spark, d), fx.kg_edges(spark, d))
    return nodes, edges.withColumnRenamed("ord", "edge_id").select(*_EDGE_COLUMNS)


def stored_graph(spark, d):
    """The cleaned graph, for queries that use its edges several times; ``prepare`` has stored them."""
    return graph(spark, d)


def kg_clean_nodes(spark, d):
    return G.clean_nodes(fx.kg_nodes(spark, d))


def kg_dedupe_edges(spark, d):
    return graph(spark, d)[1]


def kg_counts(spark, d):
    return G.kg_counts(*graph(spark, d))


def kg_counts_both_ways(spark, d):
    return G.kg_counts(*graph(spark, d), both_ways=True)


def kg_verify(spark, d):
    """The cleaned graph against a second count of what it was made from."""
    nodes, raw = fx.kg_nodes(spark, d), fx.kg_edges(spark, d)
    known = G.drop_dangling(raw, nodes.select("node_index"))
    values = F.array_sort(F.array_distinct(F.array("start_id", "end_id", "rel_type", "display_relation")))
    return G.verify_counts(*graph(spark, d), expected_nodes=nodes.count(), expected_edges=known.select(values).distinct().count())


def kg_degree(spark, d):
    return G.degree(graph(spark, d)[1])


def _matches(spark, d, per_term=20):
    return G.find_nodes(G.clean_nodes(fx.kg_nodes(spark, d)), fx.TERMS, per_term)


def kg_find_nodes(spark, d):
    return _matches(spark, d).select("diagnosis", "node_index", "node_name", "matched_term", F.col("rank").cast("long").alias("rank"))


def kg_node_mapping(spark, d):
    out = G.node_mapping(_matches(spark, d), fx.TERMS)
    flat = F.transform("matches", lambda m: F.concat_ws("/", m["node_index"], m["node_name"], m["matched_term"]))
    return out.select("diagnosis", F.array_join(flat, "|").alias("matches"))


def kg_best_seed(spark, d):
    return G.best_seed(_matches(spark, d, 5))


def _seeds(spark, d):
    """Every supplier and nation of the graph."""
    return G.clean_nodes(fx.kg_nodes(spark, d)).where(F.col("label") == "disease")


def kg_one_hop(spark, d):
    nodes, edges = graph(spark, d)
    return G.hop(nodes, edges, _seeds(spark, d), [("disease_phenotype_positive", "effect__phenotype")])


def kg_one_hop_disease(spark, d):
    nodes, edges = graph(spark, d)
    return G.hop(nodes, edges, _seeds(spark, d), [("disease_disease", "disease")])


def kg_two_hop(spark, d):
    nodes, edges = stored_graph(spark, d)
    path = [("disease_phenotype_positive", "effect__phenotype"), ("phenotype_phenotype", "effect__phenotype")]
    return G.hop(nodes, edges, G.best_seed(_matches(spark, d, 5)), path)


def kg_reachable(spark, d):
    nodes, edges = stored_graph(spark, d)
    seeds = G.best_seed(_matches(spark, d, 5))
    return G.reachable(edges, seeds)


def kg_within_hops(spark, d):
    nodes, edges = stored_graph(spark, d)
    return G.within_hops(edges, G.best_seed(_matches(spark, d, 5)), 3)  # hubs two steps away from every seed


def kg_subgraph_three(spark, d):
    nodes, edges = stored_graph(spark, d)
    return G.subgraph_within(nodes, edges, G.best_seed(_matches(spark, d, 5)), 3)


def kg_exposure(spark, d):
    nodes, edges = graph(spark, d)
    return G.pairs(nodes, edges, "exposure_disease", "exposure", "disease", "ATION_1")


def _subgraph(spark, d):
    nodes, edges = stored_graph(spark, d)
    return G.subgraph(nodes, edges, G.find_nodes(nodes, fx.TERMS))  # nations, the hubs, among the seeds


def kg_subgraph(spark, d):
    return _subgraph(spark, d)


def kg_subgraph_nodes(spark, d):
    return G.subgraph_nodes(_subgraph(spark, d))


def kg_neighbors(spark, d):
    out = G.neighbors(*stored_graph(spark, d))
    return out.select("node_name", "edge", "neighbor", F.col("rank").cast("long").alias("rank"))


def _chain_rows(spark, d):
    """One row per order: its triplets in line order."""
    rows = fx.rows_by_order(spark, d, "triplet", "ord")
    merged = T.merge_in_order(rows, ["l_orderkey"], "triplet", "ord", "triplets", single=True)
    return merged.select(t.concat("s", F.col("l_orderkey").cast("string")).alias("img_id"), "triplets")


def entity_links(spark, d, rows=None):
    """The vocabulary (of ``rows``, which have all triplets) linked to node names: a few manual entries, then exact names."""
    rows = fx.rows_nle(spark, d).select(F.array("triplet").alias("triplets")) if rows is None else rows
    manual = L.manual_stage(spark, fx.MANUAL)
    return L.link(T.vocabulary(rows), [("manual", manual), ("exact", L.exact_stage(G.clean_nodes(fx.kg_nodes(spark, d))))])


def _chain_table(spark, d):
    nodes, edges = stored_graph(spark, d)
    rows = materialize(_chain_rows(spark, d), "orders")
    links = materialize(entity_links(spark, d, rows), "links")
    names = links.where(F.col("canonical").isNotNull()).select(F.col("canonical").alias("node_name"))
    return G.chains(rows, links, G.neighbors(nodes, edges, names))


def kg_chains(spark, d):
    return _chain_table(spark, d).select(
        "img_id", F.array_join("triplets", "|").alias("triplets"), F.array_join("chains", "|").alias("chains")
    )


def chain_stats(spark, d):
    return G.chain_stats(_chain_table(spark, d))


# --- ontology: parts as classes ----------------------------------------------


def ontology(spark, d, repeats=False):
    """Part and supplier classes with labels in two languages and cause relations between them.

    With ``repeats`` a relation comes once per order line, for uses to which repeated triples are nothing new.
    """
    part = fx.table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    line = fx.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    line = line if repeats else line.distinct()
    key = F.col("p_partkey")
    cls = t.concat("Part_", key.cast("string"))
    none = F.lit(None).cast("string")
    labels = part.where(F.col("p_size") > 10).select(
        cls.alias("subject"), F.lit("label").alias("predicate"), F.initcap("p_name").alias("object"),
        F.when(F.col("p_size") > 25, "en").alias("lang"), (key * 10).alias("ord"),
    )
    french = part.select(
        cls.alias("subject"), F.lit("label").alias("predicate"), t.concat("le ", F.col("p_name")).alias("object"), F.lit("fr").alias("lang"),
        (key * 10 + 1).alias("ord"),
    )
    isa = part.select(cls.alias("subject"), F.lit("is_a").alias("predicate"), F.initcap("p_type").alias("object"), none.alias("lang"), (key * 10 + 2).alias("ord"))
    brand = part.select(cls.alias("subject"), F.lit("is_a").alias("predicate"), t.concat("Size_", F.col("p_size").cast("string")).alias("object"), none.alias("lang"), (key * 10 + 3).alias("ord"))
    supplier = t.concat("Supplier_", F.col("l_suppkey").cast("string"))
    lpart = t.concat("Part_", F.col("l_partkey").cast("string"))
    place = F.lit(10**12) + F.col("l_suppkey") * F.lit(10**8) + F.col("l_partkey")
    # A: the part may cause the supplier; N: the supplier may be caused by the part; R: the other way round.
    caused = F.col("l_returnflag") == "N"
    shift = F.when(caused, F.lit(10**13)).when(F.col("l_returnflag") == "R", F.lit(2 * 10**13)).otherwise(F.lit(0))
    relations = line.where(F.col("l_returnflag").isin("A", "N", "R")).select(
        F.when(caused, supplier).otherwise(lpart).alias("subject"),
        F.when(F.col("l_returnflag") == "A", "May_Cause").otherwise("May_Be_Caused_By").alias("predicate"),
        F.when(caused, lpart).otherwise(supplier).alias("object"),
        none.alias("lang"),
        (place + shift).alias("ord"),
    )
    out = labels
    for more in (french, isa, brand, relations):
        out = out.unionByName(more)
    return out


def _index(spark, d, always_local=False):
    """An index needs the first position of every class, which repeated triples don't change."""
    return G.label_index(ontology(spark, d, repeats=True), always_local=always_local)


def _stored_index(spark, d):
    """The index with every local name, written once, for queries that use it several times."""
    return materialize(_index(spark, d, always_local=True), "index")


def label_index(spark, d):
    return _index(spark, d)


def label_index_local(spark, d):
    return _index(spark, d, always_local=True)


def onto_neighbors(spark, d):
    out = G.ontology_neighbors(ontology(spark, d), _stored_index(spark, d))
    return out.select("node_name", "edge", "neighbor", F.col("rank").cast("long").alias("rank"))


def class_neighbors(spark, d):
    return G.class_neighbors(ontology(spark, d), G.CAUSE + G.CAUSED_BY)


def is_a_parents(spark, d):
    return G.parents(ontology(spark, d)).select("cls", "parent", F.col("rank").cast("long").alias("rank"))


def relation_counts(spark, d):
    out = G.relation_counts(ontology(spark, d), G.CAUSE + G.CAUSED_BY)
    return out.select("predicate", "n", F.array_join("examples", "|").alias("examples"))


def coverage(spark, d):
    part = fx.table(spark, d, "part")
    seeds = part.select(F.col("p_brand").alias("grp"), F.col("p_name").alias("name"))
    return G.coverage(seeds, _index(spark, d))


def onto_chains(spark, d):
    """Both ends of a triplet are looked up; names are ontology labels."""
    index = _stored_index(spark, d)
    links = index.select(F.col("key").alias("entity"), "canonical")

    def near(names):
        keys = materialize(index.join(names, index.key == names.node_name, "left_semi"), "keys")
        wanted = keys.select(F.col("cls").alias("subject")).distinct()
        triples = ontology(spark, d, repeats=True).join(wanted, "subject", "left_semi").distinct()
        return G.ontology_neighbors(triples, index, keys=keys)

    out = G.chains(_chain_rows(spark, d), links, near, use_subject=True, sentence=G.ontology_sentence, fold_node_case=True)
    return out.select("img_id", F.array_join("chains", "|").alias("chains"), F.size("chains").cast("long").alias("n"))


def chain_coverage(spark, d):
    """Coverage of node names of the chains in the order's explanation text."""
    # A study is an order; its rows are stored together and stay there.
    rows = materialize_by(fx.rows_by_order(spark, d, "nle", "triplet", "ord"), {"img_id": F.col("l_orderkey")}, "rows")
    texts = rows.groupBy("img_id").agg(F.max_by("nle", "ord").alias("text"))
    nodes, edges = stored_graph(spark, d)
    # Chains as entity lists of two and three: the neighbours of the order's triplet objects.
    ends = rows.select("img_id", t.parse_triplet("triplet")["obj"].alias("obj")).where("obj IS NOT NULL").distinct()
    # Stored, so that its size is known before the ends would move to meet it.
    near = materialize(G.neighbors(nodes, edges, ends.select(F.col("obj").alias("node_name")), k=10), "near")
    hits = ends.join(near, ends.obj == near.node_name).select("img_id", F.when(F.col("rank") % 2 == 0, F.array("node_name", "neighbor", "edge")).otherwise(F.array("node_name", "neighbor")).alias("entities"))
    made = hits.groupBy("img_id").agg(F.collect_list(F.struct("entities")).alias("chains"))
    return G.chain_coverage(texts, made)


QUERIES = {
    f.__name__: f
    for f in (
        kg_clean_nodes, kg_dedupe_edges, kg_counts, kg_counts_both_ways, kg_verify, kg_degree, kg_find_nodes,
        kg_node_mapping, kg_best_seed, kg_one_hop, kg_one_hop_disease, kg_two_hop, kg_reachable, kg_within_hops, kg_subgraph_three, kg_exposure,
        kg_subgraph, kg_subgraph_nodes, kg_neighbors, kg_chains, chain_stats, label_index, label_index_local,
        onto_neighbors, class_neighbors, is_a_parents, relation_counts, coverage, onto_chains, chain_coverage,
    )
}

# --- oracles -----------------------------------------------------------------

_TERM_ROWS = ", ".join(
    f"('{dx}', {i}, {j}, '{term}')" for i, (dx, words) in enumerate(fx.TERMS.items()) for j, term in enumerate(words)
)


def _match_view(per_term: int) -> str:
    return f"""
    SELECT diagnosis, dpos, node_index, node_name, term AS matched_term, tpos * {per_term} + rn AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY dpos, node_index ORDER BY tpos, rn) AS keep FROM (
            SELECT t.*, node_index, node_name, row_number() OVER (PARTITION BY dpos, tpos ORDER BY node_name, node_index) AS rn
            FROM nodes JOIN (VALUES {_TERM_ROWS}) t(diagnosis, dpos, tpos, term) ON contains(lower(node_name), term))
        WHERE rn <= {per_term})
    WHERE keep = 1"""


add_view("matches20", _match_view(20), ["nodes"])
add_view("matches5", _match_view(5), ["nodes"])
add_view(
    "best3",
    """
    SELECT diagnosis, node_index, node_name FROM (
        SELECT *, row_number() OVER (PARTITION BY dpos ORDER BY length(node_name), rank) AS rn FROM matches5)
    WHERE rn = 1 ORDER BY dpos LIMIT 3""",
    ["matches5"],
)
add_view("deg", "SELECT src AS node_index, count(*) AS degree FROM undirected GROUP BY 1", ["undirected"])
add_view(
    "near",
    """
    SELECT * FROM (
        SELECT a.node_name, rel_type AS edge, b.node_name AS neighbor,
               row_number() OVER (PARTITION BY a.node_name ORDER BY rel_type, b.node_name, u.dst, edge_id) AS rank
        FROM undirected u JOIN nodes a ON a.node_index = u.src JOIN nodes b ON b.node_index = u.dst
             JOIN deg ON deg.node_index = u.dst AND degree < 200
        WHERE rel_type IN ('disease_disease', 'phenotype_phenotype'))
    WHERE rank <= 10""",
    ["undirected", "nodes", "deg"],
)
add_view(
    "sub",
    """
    SELECT DISTINCT e.edge_id, e.start_id AS src_index, a.node_name AS src_name, a.label AS src_label, e.rel_type,
           e.end_id AS dst_index, b.node_name AS dst_name, b.label AS dst_label
    FROM edges e JOIN nodes a ON a.node_index = e.start_id JOIN nodes b ON b.node_index = e.end_id
    WHERE e.start_id IN (SELECT node_index FROM ball) OR e.end_id IN (SELECT node_index FROM ball)""",
    ["edges", "nodes", "ball"],
)
add_view(
    "ball",
    """
    SELECT node_index FROM seed_nodes UNION SELECT dst FROM undirected WHERE src IN (SELECT node_index FROM seed_nodes)""",
    ["seed_nodes", "undirected"],
)
add_view(
    "seed_nodes",
    """
    SELECT DISTINCT m.node_index FROM matches20 m JOIN nodes n ON n.node_index = m.node_index
    WHERE label = 'disease'""",
    ["matches20", "nodes"],
)
_MANUAL = ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in fx.MANUAL.items())
add_view(
    "vocab",
    """SELECT DISTINCT unnest(string_split(lower(triplet), ' suggestive of ')) AS entity
       FROM fx_nle WHERE contains(triplet, ' suggestive of ')""",
    ["fx_nle"],
)
add_view(
    "links",
    f"""
    SELECT entity, CASE WHEN m.k IS NOT NULL THEN m.v ELSE x.name END AS canonical,
           CASE WHEN m.k IS NOT NULL THEN 'manual' WHEN x.low IS NOT NULL THEN 'exact' END AS stage
    FROM vocab LEFT JOIN (VALUES {_MANUAL}) m(k, v) ON m.k = entity
         LEFT JOIN (SELECT lower(node_name) AS low, arg_min(node_name, node_index) AS name FROM nodes GROUP BY 1) x ON x.low = entity""",
    ["vocab", "nodes"],
)
add_view(
    "chain_trip",
    """
    SELECT img_id, triplet, min(ord) AS ord, instr(triplet, ' suggestive of ') AS pl
    FROM (SELECT study_id AS img_id, triplet, ord FROM fx_nle) GROUP BY 1, 2""",
    ["fx_nle"],
)
add_view(
    "chain_hits",
    """
    WITH p AS (SELECT img_id, ord, substr(triplet, 1, pl - 1) AS subj, substr(triplet, pl + 15) AS obj FROM chain_trip WHERE pl > 0),
    n AS (SELECT p.*, coalesce(a.canonical, b.canonical) AS name FROM p LEFT JOIN links a ON a.entity = obj LEFT JOIN links b ON b.entity = lower(obj)),
    c AS (SELECT img_id, ord, rank, subj || ' suggests ' || obj || ', which ' ||
                 CASE edge WHEN 'disease_disease' THEN 'is related to' ELSE 'is associated with' END || ' ' || neighbor AS chain,
                 row_number() OVER (PARTITION BY img_id, name, edge, neighbor ORDER BY ord, rank) AS rn
          FROM n JOIN near ON near.node_name = n.name)
    SELECT * FROM c WHERE rn = 1""",
    ["chain_trip", "links", "near"],
)
add_view(
    "chain_rows",
    """
    SELECT t.img_id, t.triplets, coalesce(c.chains, '') AS chains, coalesce(c.n, 0) AS n
    FROM (SELECT img_id, string_agg(triplet, '|' ORDER BY ord) AS triplets FROM chain_trip GROUP BY 1) t
         LEFT JOIN (SELECT img_id, string_agg(chain, '|' ORDER BY ord, rank) AS chains, count(*) AS n FROM chain_hits GROUP BY 1) c
         ON c.img_id = t.img_id""",
    ["chain_trip", "chain_hits"],
)

add_view(
    "triples",
    """
    SELECT 'Part_' || p_partkey AS subject, 'label' AS predicate,
           upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS object,
           CASE WHEN p_size > 25 THEN 'en' END AS lang, p_partkey * 10 AS ord FROM part WHERE p_size > 10
    UNION ALL SELECT 'Part_' || p_partkey, 'label', 'le ' || p_name, 'fr', p_partkey * 10 + 1 FROM part
    UNION ALL SELECT 'Part_' || p_partkey, 'is_a', p_type[1] || lower(substr(p_type, 2)), NULL, p_partkey * 10 + 2 FROM part
    UNION ALL SELECT 'Part_' || p_partkey, 'is_a', 'Size_' || p_size, NULL, p_partkey * 10 + 3 FROM part
    UNION ALL SELECT 'Part_' || l_partkey, 'May_Cause', 'Supplier_' || l_suppkey, NULL, place FROM ol WHERE l_returnflag = 'A'
    UNION ALL SELECT 'Supplier_' || l_suppkey, 'May_Be_Caused_By', 'Part_' || l_partkey, NULL, place + 10000000000000 FROM ol WHERE l_returnflag = 'N'
    UNION ALL SELECT 'Part_' || l_partkey, 'May_Be_Caused_By', 'Supplier_' || l_suppkey, NULL, place + 20000000000000 FROM ol WHERE l_returnflag = 'R'""",
    ["ol"],
)
add_view("ol", "SELECT DISTINCT l_suppkey, l_partkey, l_returnflag, 1000000000000 + l_suppkey * 100000000 + l_partkey AS place FROM lineitem")


def _index_view(always: bool) -> str:
    only = "" if always else "WHERE subject NOT IN (SELECT subject FROM triples WHERE predicate = 'label' AND (lang IS NULL OR lang = 'en'))"
    return f"""
    SELECT key, cls, canonical FROM (
        SELECT *, first_value(label) OVER (PARTITION BY cls ORDER BY tier, ord) AS canonical,
               row_number() OVER (PARTITION BY key ORDER BY place, cls) AS rn
        FROM (SELECT subject AS cls, label, lower(trim(label)) AS key, tier, l.ord, place FROM (
                  SELECT subject, object AS label, 0 AS tier, ord FROM triples WHERE predicate = 'label' AND (lang IS NULL OR lang = 'en')
                  UNION ALL SELECT subject, replace(subject, '_', ' '), 1, min(ord) FROM triples {only} GROUP BY subject) l
              JOIN (SELECT subject, min(ord) AS place FROM triples GROUP BY 1) USING (subject)))
    WHERE rn = 1"""


add_view("idx", _index_view(False), ["triples"])
add_view("idx_local", _index_view(True), ["triples"])
add_view(
    "onear",
    """
    SELECT key AS node_name, edge, coalesce(n.canonical, replace(other, '_', ' ')) AS neighbor, rank FROM (
        SELECT subject AS cls, predicate AS edge, object AS other,
               row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN predicate = 'May_Cause' THEN 0 ELSE 1 END, ord, object) AS rank
        FROM triples WHERE predicate LIKE 'May_%') r
    JOIN idx_local i ON i.cls = r.cls LEFT JOIN (SELECT DISTINCT cls, canonical FROM idx_local) n ON n.cls = other
    WHERE rank <= 10""",
    ["triples", "idx_local"],
)
_REL = "predicate IN ('May_Cause', 'may_cause', 'May_Be_Caused_By', 'may_be_caused_by')"


def _hop_sql(rel: str, label: str) -> str:
    return f"""
        SELECT seed, start, hop1 FROM (
            SELECT a.node_index AS seed, a.node_name AS start, b.node_name AS hop1,
                   row_number() OVER (PARTITION BY a.node_index ORDER BY b.node_name, b.node_index, edge_id) AS rn
            FROM nodes a JOIN undirected u ON u.src = a.node_index AND rel_type = '{rel}' JOIN nodes b ON b.node_index = u.dst AND b.label = '{label}'
            WHERE a.label = 'disease')
        WHERE rn <= 10"""


_TOTALS = """
        SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY ALL
        UNION ALL SELECT 'rel_type', rel_type, count(*) FROM {e} GROUP BY ALL
        UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM {e}"""

def _recursive(query: str, *names: str) -> str:
    return with_views(query, *names).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE = {
    "kg_clean_nodes": with_views("SELECT * FROM nodes", "nodes"),
    "kg_dedupe_edges": with_views("SELECT * FROM edges", "edges"),
    "kg_counts": with_views(_TOTALS.format(e="edges"), "edges", "nodes"),
    "kg_counts_both_ways": with_views(_TOTALS.format(e="undirected"), "undirected", "nodes"),
    "kg_verify": with_views(
        """
        SELECT 'nodes' AS name, count(*) AS n, count(*) AS expected, true AS ok FROM nodes
        UNION ALL SELECT 'edges', count(*), count(*), true FROM edges""",
        "edges",
        "nodes",
    ),
    "kg_degree": with_views("SELECT node_index, degree FROM deg", "deg"),
    "kg_find_nodes": with_views("SELECT diagnosis, node_index, node_name, matched_term, CAST(rank AS BIGINT) AS rank FROM matches20", "matches20"),
    "kg_node_mapping": with_views(
        f"""
        SELECT d.diagnosis, coalesce(string_agg(node_index || '/' || node_name || '/' || matched_term, '|' ORDER BY rank), '') AS matches
        FROM (SELECT DISTINCT diagnosis FROM (VALUES {_TERM_ROWS}) t(diagnosis, dpos, tpos, term)) d
             LEFT JOIN matches20 m ON m.diagnosis = d.diagnosis GROUP BY 1""",
        "matches20",
    ),
    "kg_best_seed": with_views("SELECT * FROM best3", "best3"),
    "kg_one_hop": with_views(_hop_sql("disease_phenotype_positive", "effect__phenotype"), "nodes", "undirected"),
    "kg_one_hop_disease": with_views(_hop_sql("disease_disease", "disease"), "nodes", "undirected"),
    "kg_two_hop": with_views(
        """
        SELECT seed, start, hop1, hop2 FROM (
            SELECT a.node_index AS seed, a.node_name AS start, b.node_name AS hop1, c.node_name AS hop2,
                   row_number() OVER (PARTITION BY a.node_index ORDER BY b.node_name, c.node_name, b.node_index, c.node_index, u.edge_id, v.edge_id) AS rn
            FROM best3 s JOIN nodes a ON a.node_index = s.node_index AND a.label = 'disease'
                 JOIN undirected u ON u.src = a.node_index AND u.rel_type = 'disease_phenotype_positive'
                 JOIN nodes b ON b.node_index = u.dst AND b.label = 'effect__phenotype'
                 JOIN undirected v ON v.src = b.node_index AND v.rel_type = 'phenotype_phenotype' AND v.edge_id <> u.edge_id
                 JOIN nodes c ON c.node_index = v.dst AND c.label = 'effect__phenotype')
        WHERE rn <= 10""",
        "best3",
        "undirected",
        "nodes",
    ),
    "kg_reachable": with_views(
        """
        WITH one AS (SELECT s.node_index AS seed, u.dst AS node, u.edge_id FROM best3 s JOIN undirected u ON u.src = s.node_index),
        two AS (SELECT seed, u.dst AS node FROM one JOIN undirected u ON u.src = one.node AND u.edge_id <> one.edge_id),
        every AS (SELECT seed, node FROM one UNION SELECT seed, node FROM two)
        SELECT s.node_index AS seed, count(node) AS n FROM best3 s LEFT JOIN every ON seed = s.node_index GROUP BY 1""",
        "best3",
        "undirected",
    ),
    "kg_within_hops": _recursive(
        """
        WITH walk AS (
            SELECT DISTINCT node_index AS seed, node_index AS node, 0 AS hop FROM best3
            UNION SELECT seed, u.dst, hop + 1 FROM walk JOIN undirected u ON u.src = node WHERE hop < 3)
        SELECT seed, node, min(hop) AS hop FROM walk GROUP BY ALL""",
        "best3",
        "undirected",
    ),
    "kg_subgraph_three": _recursive(
        """
        WITH walk AS (
            SELECT DISTINCT b.node_index AS node, 0 AS hop FROM best3 b JOIN nodes n ON n.node_index = b.node_index AND n.label = 'disease'
            UNION SELECT u.dst, hop + 1 FROM walk JOIN undirected u ON u.src = node WHERE hop < 2)
        SELECT DISTINCT e.edge_id, e.start_id AS src_index, a.node_name AS src_name, a.label AS src_label, e.rel_type,
               e.end_id AS dst_index, b.node_name AS dst_name, b.label AS dst_label
        FROM edges e JOIN nodes a ON a.node_index = e.start_id JOIN nodes b ON b.node_index = e.end_id
        WHERE e.start_id IN (SELECT node FROM walk) OR e.end_id IN (SELECT node FROM walk)""",
        "best3",
        "undirected",
        "nodes",
        "edges",
    ),
    "kg_exposure": with_views(
        """
        SELECT b.node_name AS name_b, a.node_name AS name_a
        FROM undirected u JOIN nodes a ON a.node_index = u.src AND a.label = 'exposure' JOIN nodes b ON b.node_index = u.dst AND b.label = 'disease'
        WHERE rel_type = 'exposure_disease' AND contains(b.node_name, 'ATION_1') ORDER BY 1, 2 LIMIT 20""",
        "undirected",
        "nodes",
    ),
    "kg_subgraph": with_views("SELECT * FROM sub", "sub"),
    "kg_subgraph_nodes": with_views(
        """
        SELECT src_index AS node_index, src_name AS node_name, src_label AS label FROM sub
        UNION SELECT dst_index, dst_name, dst_label FROM sub""",
        "sub",
    ),
    "kg_neighbors": with_views("SELECT node_name, edge, neighbor, rank FROM near", "near"),
    "kg_chains": with_views("SELECT img_id, triplets, chains FROM chain_rows", "chain_rows"),
    "chain_stats": with_views(
        """
        SELECT count(*) AS rows, count(*) FILTER (WHERE n > 0) AS rows_with_chains,
               round(100.0 * count(*) FILTER (WHERE n > 0) / greatest(count(*), 1), 1) AS pct_with_chains,
               CAST(coalesce(sum(n), 0) AS BIGINT) AS total_chains FROM chain_rows""",
        "chain_rows",
    ),
    "label_index": with_views("SELECT key, cls, canonical FROM idx", "idx"),
    "label_index_local": with_views("SELECT key, cls, canonical FROM idx_local", "idx_local"),
    "onto_neighbors": with_views("SELECT * FROM onear", "onear"),
    "class_neighbors": with_views(
        f"""
        SELECT subject AS cls, 'outgoing' AS direction, predicate AS edge, object AS other FROM triples WHERE {_REL}
        UNION ALL SELECT object, 'incoming', predicate, subject FROM triples WHERE {_REL} AND subject <> object""",
        "triples",
    ),
    "is_a_parents": with_views(
        """
        SELECT cls, parent, rank FROM (SELECT subject AS cls, object AS parent, row_number() OVER (PARTITION BY subject ORDER BY ord, object) AS rank
                                       FROM triples WHERE predicate = 'is_a') WHERE rank <= 3""",
        "triples",
    ),
    "relation_counts": with_views(
        f"""
        SELECT predicate, count(*) AS n, string_agg(subject || ' -> ' || object, '|' ORDER BY rn) FILTER (WHERE rn <= 3) AS examples
        FROM (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY ord, subject, object) AS rn FROM triples WHERE {_REL}) GROUP BY 1""",
        "triples",
    ),
    "coverage": with_views(
        """
        SELECT p_brand AS grp, count(*) AS total, count(key) AS found FROM part LEFT JOIN idx ON key = lower(p_name) GROUP BY 1""",
        "idx",
    ),
    "onto_chains": with_views(
        """
        WITH p AS (SELECT img_id, ord, substr(triplet, 1, pl - 1) AS subj, substr(triplet, pl + 15) AS obj FROM chain_trip WHERE pl > 0),
        e AS (SELECT img_id, ord, 0 AS j, obj, obj AS word FROM p UNION ALL SELECT img_id, ord, 1, obj, subj FROM p),
        n AS (SELECT e.*, coalesce(a.canonical, b.canonical) AS name FROM e LEFT JOIN idx_local a ON a.key = word LEFT JOIN idx_local b ON b.key = lower(word)),
        c AS (SELECT img_id, ord, j, rank, obj || CASE edge WHEN 'May_Cause' THEN ' may present with ' ELSE ' may be indicated by ' END || neighbor AS chain,
                     row_number() OVER (PARTITION BY img_id, name, edge, neighbor ORDER BY ord, j, rank) AS rn
              FROM n JOIN onear ON onear.node_name = lower(n.name))
        SELECT t.img_id, coalesce(string_agg(chain, '|' ORDER BY ord, j, rank), '') AS chains, count(chain) AS n
        FROM (SELECT DISTINCT img_id FROM chain_trip) t LEFT JOIN c ON c.img_id = t.img_id AND rn = 1 GROUP BY 1""",
        "chain_trip",
        "idx_local",
        "onear",
    ),
    "chain_coverage": with_views(
        """
        WITH n AS (SELECT node_name, neighbor, CASE WHEN rank % 2 = 0 THEN edge END AS edge FROM near WHERE rank <= 10),
        e AS (SELECT DISTINCT study_id AS img_id, substr(triplet, instr(triplet, ' suggestive of ') + 15) AS obj FROM fx_nle WHERE contains(triplet, ' suggestive of ')),
        x AS (SELECT study_id AS img_id, arg_max(nle, ord) AS text FROM fx_nle GROUP BY 1),
        h AS (SELECT e.img_id, sum(CASE WHEN edge IS NULL THEN 1 ELSE 2 END) AS depth, count(*) AS chains,
                     max(CASE WHEN contains(lower(text), lower(node_name)) OR contains(lower(text), lower(neighbor)) OR contains(lower(text), lower(coalesce(edge, node_name))) THEN 1 ELSE 0 END) AS hit
              FROM e JOIN n ON n.node_name = e.obj JOIN x ON x.img_id = e.img_id GROUP BY 1)
        SELECT round(100 * avg(hit), 2) AS coverage_pct, round(CAST(sum(depth) AS DOUBLE) / sum(chains), 4) AS avg_hop_depth FROM h""",
        "near",
        "fx_nle",
    ),
}
