"""Registered queries: entity linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.functions import text as t
from strandgraph.operators import fuzzy as Z
from strandgraph.operators import graph as G
from strandgraph.operators import linking as L
from strandgraph.plans import fixtures as fx
from strandgraph.plans import graph_queries as gq
from strandgraph.plans.fixtures import add_view, with_views


def _word_table(spark, d, name):
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    return fx.table(spark, d, name).select(F.explode(words).alias("entity")).where("entity <> ''").distinct()


def entities(spark, d):
    """Every distinct word of the documents is a mention."""
    return _word_table(spark, d, "documents")


def vocabulary_nodes(spark, d):
    """Every distinct word of the benchmark texts names a node; vowels are capitals."""
    return _word_table(spark, d, "benchmark").select(F.col("entity").alias("node_index"), F.translate("entity", "aeiou", "AEIOU").alias("node_name"))


def _keys(spark, d):
    return L.exact_stage(vocabulary_nodes(spark, d)).select(F.col("entity").alias("key"), "canonical")


def link_exact(spark, d):
    return L.exact_stage(G.clean_nodes(fx.kg_nodes(spark, d)))


def similar_pairs(spark, d):
    return L.similar_pairs(entities(spark, d), _keys(spark, d), 80.0).select("entity", "key", F.round("score", 4).alias("score"))


def link_fuzzy(spark, d):
    return L.fuzzy_stage(entities(spark, d), _keys(spark, d))


def weighted_pairs(spark, d):
    """Mentions and names that a weighted score of 88 links."""
    return Z.weighted_pairs(entities(spark, d), _keys(spark, d))


def link_weighted(spark, d):
    """As link_fuzzy, by the weighted score."""
    return Z.weighted_stage(entities(spark, d), _keys(spark, d))


def near_nodes(spark, d):
    """Nodes within two hops of words in "tion", where words that follow each other in a benchmark text are joined."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    follow = F.arrays_zip(F.slice(words, 1, F.size(words) - 1).alias("start_id"), F.slice(words, 2, F.size(words)).alias("end_id"))
    edges = fx.table(spark, d, "benchmark").where(F.size(words) > 1).select(F.explode(follow).alias("e")).select("e.*").distinct()
    edges = edges.select(F.concat_ws(" ", "start_id", "end_id").alias("edge_id"), "start_id", "end_id", F.lit("before").alias("rel_type"))
    nodes = vocabulary_nodes(spark, d).withColumn("label", F.lit("disease"))
    seeds = nodes.where(F.col("node_index").endswith("tion")).select("node_index")
    return G.subgraph_nodes(G.subgraph_within(nodes, edges, seeds, 2)).select("node_name").distinct()


def link_graph(spark, d):
    """Mentions to the nodes near the seeds by a weighted score of 85, whatever the length of the name."""
    keys = near_nodes(spark, d).select(F.lower("node_name").alias("key"), F.col("node_name").alias("canonical"))
    return Z.weighted_stage(entities(spark, d), keys, 85.0, min_ratio=0.0)


def link_cascade(spark, d):
    """Manual, exact, concept candidates and fuzzy in this order over all mentions."""
    nodes = vocabulary_nodes(spark, d)
    mentions = entities(spark, d)
    manual = L.manual_stage(spark, {"and": None, "the": "A", "with": "WITHOUT"})
    named = F.col("entity").contains("tion")
    concepts = mentions.where(named).select("entity", F.posexplode(F.array(F.lit("no node"), F.lit("There"), F.lit("for"))).alias("rank", "name"))
    return L.link(
        mentions,
        [
            ("manual", manual),
            ("exact", L.exact_stage(nodes)),
            ("concept", L.concept_stage(concepts, nodes)),
            ("fuzzy", L.fuzzy_stage(mentions, _keys(spark, d))),
        ],
    )


def link_stats(spark, d):
    return L.link_stats(gq.entity_links(spark, d))


def diagnosis_map(spark, d):
    nodes = G.clean_nodes(fx.kg_nodes(spark, d))
    return L.diagnosis_stage(G.node_mapping(G.find_nodes(nodes, fx.TERMS), fx.TERMS))


QUERIES = {f.__name__: f for f in (link_exact, similar_pairs, link_fuzzy, weighted_pairs, link_weighted, link_graph, link_cascade, link_stats, diagnosis_map)}

add_view("names", "SELECT DISTINCT w AS key, translate(w, 'aeiou', 'AEIOU') AS canonical FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM benchmark) WHERE w <> ''")
add_view("mentions", "SELECT DISTINCT w AS entity FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM documents) WHERE w <> ''")


def _one_byte(c: str) -> str:
    return f"translate({c}, 'äöüßàâçèéêëîïôùûœáíñóú', 'ABCDEFGHIJKLMNOPQRSTUV')"


def _sim_view(cutoff: int) -> str:
    """Brute force over all pairs of admissible length.

    The SQL function counts bytes, so every accented letter is first exchanged for one capital, which no lowered word has.
    """
    return f"""
    SELECT entity, key, 100 * (1 - edits / greatest(length(entity), length(key))) AS score
    FROM (SELECT entity, key, levenshtein({_one_byte("entity")}, {_one_byte("key")}) AS edits
          FROM mentions JOIN names ON length(key) * 100 >= length(entity) * {cutoff} AND length(entity) * 100 >= length(key) * {cutoff})
    WHERE edits <= {(100 - cutoff) / 100} * greatest(length(entity), length(key)) + 1e-9"""


add_view("sim80", _sim_view(80), ["mentions", "names"])
add_view("sim", _sim_view(88), ["mentions", "names"])
add_view(
    "fuzz",
    """
    SELECT entity, canonical FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, key) AS rn FROM sim WHERE length(entity) >= 4)
    JOIN names USING (key) WHERE rn = 1 AND length(key) >= 0.7 * length(entity)""",
    ["sim", "names"],
)
# The first concept candidate that is a node; both may be missing from a small vocabulary.
add_view("concept", "SELECT arg_min(canonical, CASE key WHEN 'there' THEN 1 ELSE 2 END) AS name, count(*) AS n FROM names WHERE key IN ('there', 'for')", ["names"])

ORACLE = {
    "link_exact": with_views("SELECT lower(node_name) AS entity, arg_min(node_name, node_index) AS canonical FROM nodes GROUP BY 1", "nodes"),
    "similar_pairs": with_views("SELECT entity, key, round(score, 4) AS score FROM sim80", "sim80"),
    "link_fuzzy": with_views("SELECT entity, canonical FROM fuzz", "fuzz"),
    "link_cascade": with_views(
        """
        WITH f AS MATERIALIZED (SELECT entity, canonical FROM fuzz),
        c AS MATERIALIZED (SELECT name, n FROM concept),
        m AS (SELECT entity, CASE WHEN contains(entity, 'tion') THEN (SELECT n FROM c) ELSE 0 END AS found FROM mentions)
        SELECT m.entity, CASE WHEN k.k IS NOT NULL THEN k.v WHEN n.key IS NOT NULL THEN n.canonical WHEN found > 0 THEN (SELECT name FROM c) ELSE f.canonical END AS canonical,
               CASE WHEN k.k IS NOT NULL THEN 'manual' WHEN n.key IS NOT NULL THEN 'exact' WHEN found > 0 THEN 'concept' WHEN f.entity IS NOT NULL THEN 'fuzzy' END AS stage
        FROM m LEFT JOIN (VALUES ('and', NULL), ('the', 'A'), ('with', 'WITHOUT')) k(k, v) ON k.k = m.entity
             LEFT JOIN names n ON n.key = m.entity LEFT JOIN f ON f.entity = m.entity""",
        "mentions",
        "fuzz",
        "concept",
    ),
    "link_stats": with_views("SELECT coalesce(stage, 'none') AS stage, count(*) AS entities, count(canonical) AS named FROM links GROUP BY 1", "links"),
    "diagnosis_map": with_views(
        f"""
        SELECT lower(d.diagnosis) AS entity, arg_min(node_name, rank) AS canonical
        FROM (SELECT DISTINCT diagnosis FROM (VALUES {gq._TERM_ROWS}) t(diagnosis, dpos, tpos, term)) d LEFT JOIN matches20 m ON m.diagnosis = d.diagnosis GROUP BY 1""",
        "matches20",
    ),
}
