"""Property graph: cleaning, lookup, hops, subgraph export and reasoning chains.

Nodes: node_index, node_id, label, node_name, node_source (all text).
Edges: rel_type, display_relation, start_id, end_id (all text), stored directed
and read in both directions. Operators that must tell parallel edges apart need
an ``edge_id`` column (``dedupe_edges`` keeps the ordinal, which serves as one).

Hub nodes: counts are pre-aggregated on the map side, top-k lists are cut per
input partition before the shuffle, frontiers are reduced to distinct nodes
before the next hop, and the degree cut comes before any expansion. The plain
equi-joins on a node id are left to adaptive skew splitting.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import text as t
from strandgraph.session import materialize
from strandgraph.operators.ordinal import top_per_group

NODE_COLUMNS = ["node_index", "node_id", "label", "node_name", "node_source"]

# --- fixed values ------------------------------------------------------------

RELATION_PHRASES = {
    "suggestive_of": "suggests",
    "disease_phenotype_positive": "may present with",
    "disease_phenotype_negative": "is not associated with",
    "disease_disease": "is related to",
    "phenotype_phenotype": "is associated with",
    "disease_protein": "involves",
}
CHAIN_EDGES = ["disease_disease", "phenotype_phenotype"]
MAX_NEIGHBOR_DEGREE = 200
MAX_NEIGHBORS = 10
CAUSE = ["May_Cause", "may_cause"]
CAUSED_BY = ["May_Be_Caused_By", "may_be_caused_by"]

# --- cleaning ----------------------------------------------------------------


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Positional rename; ``/`` in labels becomes ``__``; quotes are removed everywhere."""
    renamed = nodes.toDF(*NODE_COLUMNS)
    cleaned = renamed.withColumn("label", F.replace("label", F.lit("/"), F.lit("__")))
    return cleaned.select(*[F.replace(c, F.lit('"'), F.lit("")).alias(c) for c in NODE_COLUMNS])


def dedupe_edges(edges: DataFrame, ord: str = "ord") -> DataFrame:
    """Keep the first edge for every *set* of the values {start, end, type, display}."""
    columns = ["start_id", "end_id", "rel_type", "display_relation"]
    key = F.array_sort(F.array_distinct(F.array(*columns)))
    rest = [c for c in edges.columns if c not in (*columns, ord)]
    # The four values are in the key, so a number says where (a null is the last); numbers are combined without sorting.
    keyed = edges.select(key.alias("_key"), F.col(ord).alias("_ord"), *columns, *rest)
    at = F.lit(0)
    for c in columns:
        at = at * 8 + F.coalesce(F.array_position("_key", F.col(c)), F.size("_key")).cast("int")
    first = keyed.select("_key", "_ord", at.alias("_at"), *rest).groupBy("_key").agg(
        F.min("_ord").alias(ord), F.min_by(F.struct("_at", *rest) if rest else F.col("_at"), "_ord").alias("_first")
    )
    place = F.col("_first._at") if rest else F.col("_first")
    value = {c: F.element_at("_key", F.pmod(F.shiftright(place, 9 - 3 * i), F.lit(8))) for i, c in enumerate(columns)}
    return first.select(*[value[c].alias(c) if c in value else F.col(c if c == ord else f"_first.{c}").alias(c) for c in edges.columns])


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends both exist.

    The edges are stored once and stay where they are: only their distinct ends move, to find
    those that no node has. Few such ends are broadcast; adaptive execution decides.
    """
    stored = materialize(edges.where("start_id IS NOT NULL AND end_id IS NOT NULL"), "edges", "zstd")
    ends = stored.select(F.explode(F.array("start_id", "end_id")).alias("_end")).distinct()
    known = nodes.select(F.col("node_index").alias("_end"))
    unknown = materialize(ends.join(known, "_end", "left_anti"), "unknown")
    return stored.join(unknown, stored.start_id == unknown._end, "left_anti").join(unknown, stored.end_id == unknown._end, "left_anti")


def prepare(nodes: DataFrame, edges: DataFrame, ord: str = "ord") -> tuple[DataFrame, DataFrame]:
    cleaned = clean_nodes(nodes)
    return cleaned, drop_dangling(dedupe_edges(edges, ord), cleaned)


def undirected(edges: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """src, dst, rel_type (+extra) in both directions; a self loop appears once."""
    there = F.struct(F.col("start_id").alias("src"), F.col("end_id").alias("dst"))
    back = F.struct(F.col("end_id").alias("src"), F.col("start_id").alias("dst"))
    # One pass over the edges; a union would compute them twice.
    ways = F.when(F.col("start_id") == F.col("end_id"), F.array(there)).otherwise(F.array(there, back))
    return edges.select(F.explode(ways).alias("_w"), "rel_type", *extra).select("_w.src", "_w.dst", "rel_type", *extra)


# --- counts ------------------------------------------------------------------


def kg_counts(nodes: DataFrame, edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """kind, name, n: node labels, relationship types and totals.

    ``both_ways`` counts the undirected pattern, where a non-loop edge is seen twice.
    """
    seen = undirected(edges) if both_ways else edges
    labels = nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    types = seen.groupBy(F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    parts = [
        labels.select(F.lit("label").alias("kind"), "name", "n"),
        types.select(F.lit("rel_type").alias("kind"), "name", "n"),
        labels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), F.lit("nodes").alias("name"), "n"),
        types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), F.lit("edges").alias("name"), "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verify_counts(nodes: DataFrame, edges: DataFrame, expected_nodes: int, expected_edges: int) -> DataFrame:
    """name, n, expected, ok for the node and edge totals."""
    totals = kg_counts(nodes, edges).where(F.col("kind") == "total")
    expected = F.when(F.col("name") == "nodes", expected_nodes).otherwise(expected_edges).cast("long")
    return totals.select("name", "n", expected.alias("expected"), (F.col("n") == expected).alias("ok"))


def degree(edges: DataFrame) -> DataFrame:
    """node_index, degree: number of incident relationships of any type."""
    return undirected(edges).groupBy(F.col("src").alias("node_index")).agg(F.count(F.lit(1)).alias("degree"))


# --- lookup ------------------------------------------------------------------


def find_nodes(nodes: DataFrame, terms: Mapping[str, Sequence[str]], per_term: int = 20) -> DataFrame:
    """diagnosis, diagnosis_pos, node_index, node_name, matched_term, rank.

    A node matches a term contained in its lowered name. Per term the first
    ``per_term`` names are kept; a node found by several terms of a diagnosis
    belongs to the first one. ``rank`` is the order of the matches.
    """
    table = [
        F.struct(
            F.lit(d).alias("diagnosis"), F.lit(i).alias("dpos"), F.lit(j).alias("tpos"), F.lit(term).alias("matched_term")
        )
        for i, (d, words) in enumerate(terms.items())
        for j, term in enumerate(words)
    ]
    lowered = nodes.select("node_index", "node_name", F.lower("node_name").alias("_lower"))
    hits = lowered.select(
        "node_index",
        "node_name",
        F.explode(F.filter(F.array(*table), lambda e: F.col("_lower").contains(e["matched_term"]))).alias("_t"),
    ).select("node_index", "node_name", "_t.*")
    per = top_per_group(hits, ["dpos", "tpos"], ["node_name", "node_index"], per_term, rank="_r")
    # From here on at most (number of terms) x per_term rows are left.
    first = per.groupBy("diagnosis", "dpos", "node_index").agg(
        F.min_by(F.struct("node_name", "matched_term", "tpos", "_r"), F.struct("tpos", "_r")).alias("_f")
    )
    return first.select(
        "diagnosis",
        F.col("dpos").alias("diagnosis_pos"),
        "node_index",
        F.col("_f.node_name").alias("node_name"),
        F.col("_f.matched_term").alias("matched_term"),
        (F.col("_f.tpos") * per_term + F.col("_f._r")).alias("rank"),
    )


def node_mapping(matches: DataFrame, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """diagnosis, matches ARRAY<STRUCT<node_index, node_name, matched_term>>, empty ones included."""
    spark = matches.sparkSession
    names = spark.createDataFrame([(d, i) for i, d in enumerate(terms)], "diagnosis string, _pos int")
    entry = F.struct("rank", "node_index", "node_name", "matched_term")
    # find_nodes bounds a diagnosis to (its terms) x per_term rows.
    found = matches.groupBy("diagnosis").agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    plain = F.transform("_m", lambda m: F.struct(m["node_index"], m["node_name"], m["matched_term"]))
    kind = "array<struct<node_index:string,node_name:string,matched_term:string>>"
    return names.join(found, "diagnosis", "left").select(
        "diagnosis", F.coalesce(plain.cast(kind), F.array().cast(kind)).alias("matches")
    )


def best_seed(matches: DataFrame, first: int = 3) -> DataFrame:
    """Shortest-named match per diagnosis (ties: the earliest), for the first diagnoses with any."""
    chosen = matches.groupBy("diagnosis", "diagnosis_pos").agg(
        F.min_by(F.struct("node_index", "node_name"), F.struct(F.length("node_name"), F.col("rank"))).alias("_n")
    )
    return (
        chosen.orderBy("diagnosis_pos")
        .limit(first)
        .select("diagnosis", F.col("_n.node_index").alias("node_index"), F.col("_n.node_name").alias("node_name"))
    )


# --- hops --------------------------------------------------------------------


def hop(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    path: Sequence[tuple[str, str]],
    start_label: str = "disease",
    limit: int | None = 10,
) -> DataFrame:
    """Follow ``path`` [(rel_type, label), ...] from seeds(node_index), in both directions.

    -> seed, start, hop1, hop2, ...; at most ``limit`` rows per seed in name order.
    An edge is used only once on a path.
    """
    named = nodes.select("node_index", "node_name", "label")
    start = named.where(F.col("label") == start_label).join(seeds.select("node_index").distinct(), "node_index", "left_semi")
    walk = start.select(F.col("node_index").alias("seed"), F.col("node_name").alias("start"), F.col("node_index").alias("_at"))
    both = undirected(edges, ["edge_id"])
    shown, used = ["seed", "start"], []
    for i, (rel, label) in enumerate(path, 1):
        step = both.where(F.col("rel_type") == rel).select(
            F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("edge_id").alias(f"_e{i}")
        )
        ends = named.where(F.col("label") == label).select(
            F.col("node_index").alias("_to"), F.col("node_name").alias(f"hop{i}")
        )
        walk = walk.join(step, "_at").drop("_at").join(ends, "_to").withColumnRenamed("_to", "_at")
        for other in used:
            walk = walk.where(F.col(f"_e{i}") != F.col(other))
        walk = walk.withColumn(f"_n{i}", F.col("_at"))
        used.append(f"_e{i}")
        shown.append(f"hop{i}")
    if limit is not None:
        order = shown[2:] + [f"_n{i}" for i in range(1, len(path) + 1)] + used
        walk = top_per_group(walk, ["seed"], order, limit)
    return walk.select(*shown)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds(node_index) -> seed, n: distinct nodes one or two relationships away (0 if isolated).

    A path may not use a relationship twice but may come back over a parallel one.
    The frontier keeps, per (seed, node), only the smallest and largest edge id that
    reached it: a second edge is new unless it is the only one that did.
    """
    wanted = seeds.select(F.col("node_index").alias("seed")).distinct()
    both = undirected(edges, ["edge_id"])
    one = both.join(wanted, both.src == wanted.seed).select("seed", F.col("dst").alias("node"), "edge_id")
    frontier = one.groupBy("seed", "node").agg(F.min("edge_id").alias("_lo"), F.max("edge_id").alias("_hi"))
    again = (F.col("edge_id") != F.col("_lo")) | (F.col("edge_id") != F.col("_hi"))
    two = frontier.join(both, frontier.node == both.src).where(again).select("seed", F.col("dst").alias("node"))
    reached = frontier.select("seed", "node").unionByName(two).distinct()
    counts = reached.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias("n"))


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seeds(node_index) -> seed, node, hop: every node up to ``hops`` relationships away, with the smallest number of them.

    The seed itself is there with hop 0, whether it has edges or not. A round joins only the
    nodes that the last one found with the edges, drops those seen before, and is stored; it
    ends early once nothing new is found. Hubs cost one row per seed and new neighbour.
    """
    both = undirected(edges).select("src", "dst").where("src <> dst").distinct()
    both = materialize(both, "ways") if hops > 1 else both
    frontier = seeds.select(F.col("node_index").alias("seed")).where("seed IS NOT NULL").distinct().select("seed", F.col("seed").alias("node"))
    found = frontier.withColumn("hop", F.lit(0))
    for number in range(1, hops + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(found.select("seed", "node"), ["seed", "node"], "left_anti"), "frontier")
        if not frontier.limit(1).count():
            break
        found = found.union(frontier.withColumn("hop", F.lit(number)))
    return found


def subgraph_within(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int, seed_label: str = "disease") -> DataFrame:
    """Stored edges on any path of at most ``hops`` relationships from the seeds of one label, as ``subgraph`` has them for two.

    An edge is on such a path if one of its ends is at most ``hops`` - 1 away from some seed,
    so one visited set of all seeds together is enough.
    """
    start = nodes.where(F.col("label") == seed_label).join(seeds.select("node_index").distinct(), "node_index", "left_semi").select("node_index")
    both = undirected(edges).select("src", "dst").where("src <> dst")  # a repeated pair is dropped with the nodes that it finds
    seen = frontier = materialize(start.distinct(), "seeds")
    for _ in range(hops - 1):
        step = frontier.join(both, F.col("node_index") == F.col("src")).select(F.col("dst").alias("node_index")).distinct()
        frontier = materialize(step.join(seen, "node_index", "left_anti"), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    near = materialize(seen, "near").withColumn("_near", F.lit(True))
    told = nodes.select("node_index", "node_name", "label").join(near, "node_index", "left")
    # The nodes bring whether they are near along with their names, so an edge moves once to each of its ends.
    named = lambda side: told.select(*[F.col(c).alias(f"{side}_{short}") for c, short in (("node_index", "index"), ("node_name", "name"), ("label", "label"), ("_near", "near"))])
    kept = edges.where(F.col("edge_id").isNotNull()).select("edge_id", "rel_type", "start_id", "end_id")
    out = kept.join(named("src"), F.col("start_id") == F.col("src_index")).join(named("dst"), F.col("end_id") == F.col("dst_index"))
    touched = out.where(F.coalesce("src_near", "dst_near"))
    return touched.select("edge_id", "src_index", "src_name", "src_label", "rel_type", "dst_index", "dst_name", "dst_label")


def pairs(nodes: DataFrame, edges: DataFrame, rel_type: str, label_a: str, label_b: str, contains: str, n: int = 20) -> DataFrame:
    """First ``n`` (name_b, name_a) over one relation where name_b contains a case-sensitive text."""
    a = nodes.where(F.col("label") == label_a).select(F.col("node_index").alias("src"), F.col("node_name").alias("name_a"))
    b = nodes.where((F.col("label") == label_b) & F.col("node_name").contains(contains)).select(
        F.col("node_index").alias("dst"), F.col("node_name").alias("name_b")
    )
    step = undirected(edges).where(F.col("rel_type") == rel_type).select("src", "dst")
    return step.join(b, "dst").join(a, "src").select("name_b", "name_a").orderBy("name_b", "name_a").limit(n)


# --- subgraph ----------------------------------------------------------------


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, seed_label: str = "disease") -> DataFrame:
    """Distinct stored edges on any path of at most two relationships from the seeds.

    These are the edges that touch a seed or a neighbour of a seed, found by set
    membership without listing paths. Seeds with another label are ignored.
    -> edge_id, src_index, src_name, src_label, rel_type, dst_index, dst_name, dst_label
    """
    start = (
        nodes.where(F.col("label") == seed_label)
        .join(seeds.select("node_index").distinct(), "node_index", "left_semi")
        .select("node_index")
    )
    both = undirected(edges)
    around = both.join(start, both.src == start.node_index, "left_semi").select(F.col("dst").alias("node_index"))
    inner = start.unionByName(around).distinct()
    by_start = edges.join(inner, edges.start_id == inner.node_index, "left_semi")
    by_end = edges.join(inner, edges.start_id == inner.node_index, "left_anti").join(
        inner, edges.end_id == inner.node_index, "left_semi"
    )
    touched = by_start.unionByName(by_end)
    src = nodes.select(
        F.col("node_index").alias("start_id"), F.col("node_name").alias("src_name"), F.col("label").alias("src_label")
    )
    dst = nodes.select(
        F.col("node_index").alias("end_id"), F.col("node_name").alias("dst_name"), F.col("label").alias("dst_label")
    )
    return touched.join(src, "start_id").join(dst, "end_id").select(
        "edge_id",
        F.col("start_id").alias("src_index"),
        "src_name",
        "src_label",
        "rel_type",
        F.col("end_id").alias("dst_index"),
        "dst_name",
        "dst_label",
    )


def subgraph_nodes(sub: DataFrame) -> DataFrame:
    """node_index, node_name, label of the unique ends of a subgraph."""
    ends = [
        sub.select(
            F.col(f"{side}_index").alias("node_index"),
            F.col(f"{side}_name").alias("node_name"),
            F.col(f"{side}_label").alias("label"),
        )
        for side in ("src", "dst")
    ]
    return ends[0].unionByName(ends[1]).distinct()


# --- neighbours and chains ---------------------------------------------------


def neighbors(
    nodes: DataFrame,
    edges: DataFrame,
    names: DataFrame | None = None,
    allowed: Sequence[str] = tuple(CHAIN_EDGES),
    max_degree: int = MAX_NEIGHBOR_DEGREE,
    k: int = MAX_NEIGHBORS,
) -> DataFrame:
    """node_name, edge, neighbor, rank: up to ``k`` neighbours of every node name.

    One hop over the allowed types, without neighbours of ``max_degree`` or more
    relationships, ordered by (edge, neighbour name); neighbours of one name give equal rows.
    ``names`` (node_name) restricts the start nodes.
    """
    start = nodes.select(F.col("node_index").alias("src"), "node_name")
    if names is not None:
        start = start.join(names.select("node_name").distinct(), "node_name", "left_semi")
    low = degree(edges).where(F.col("degree") < max_degree).select(F.col("node_index").alias("dst"))
    ends = nodes.select(F.col("node_index").alias("dst"), F.col("node_name").alias("neighbor")).join(low, "dst", "left_semi")
    types = F.array(*[F.lit(x) for x in sorted(set(allowed))])
    # A type moves as its number.
    step = undirected(edges.where(F.col("rel_type").isin(list(allowed)))).select("src", "dst", F.array_position(types, F.col("rel_type")).cast("int").alias("_type"))
    # Hubs are cut from the far side before the near side is joined, unless the near side is cut itself.
    joined = step.join(ends, "dst").join(start, "src") if names is None else step.join(start, "src").drop("src").join(ends, "dst")
    found = joined.select("node_name", F.element_at(types, F.col("_type")).alias("edge"), "neighbor")
    return top_per_group(found, ["node_name"], ["edge", "neighbor"], k, rank="rank").select("node_name", "edge", "neighbor", "rank")


def phrase(edge: Column) -> Column:
    """The wording of a relation; unknown ones lose their underscores."""
    known = F.create_map(*[F.lit(x) for pair in RELATION_PHRASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, edge), F.replace(edge, F.lit("_"), F.lit(" ")))


def graph_sentence(subj: Column, rel: Column, obj: Column, edge: Column, neighbor: Column) -> Column:
    return t.concat(subj, " ", phrase(rel), " ", obj, ", which ", phrase(edge), " ", neighbor)


def ontology_sentence(subj: Column, rel: Column, obj: Column, edge: Column, neighbor: Column) -> Column:
    """Always names the triplet's object, even when its subject had the neighbour."""
    return (
        F.when(edge.isin(CAUSE), t.concat(obj, " may present with ", neighbor))
        .when(edge.isin(CAUSED_BY), t.concat(obj, " may be indicated by ", neighbor))
        .otherwise(t.concat(subj, " --", rel, "--> ", obj, " --", edge, "--> ", neighbor))
    )


def chains(
    rows: DataFrame,
    entity_map: DataFrame,
    neighbor_table: DataFrame | Callable[[DataFrame], DataFrame],
    use_subject: bool = False,
    sentence=graph_sentence,
    fold_node_case: bool = False,
) -> DataFrame:
    """rows(img_id, triplets) -> img_id, triplets, chains.

    A triplet's object (then its subject, with ``use_subject``) is looked up in
    entity_map(entity, canonical) as written, then lowered; an empty or null name
    is no match. Every (node, edge, neighbour) is used once per row, in
    first-seen order. Every row gives one row, also one without chains or with an
    image id that repeats; rows of equal image and triplets are worked out once.

    Every distinct triplet is looked up and worded once: a bounded array of texts per
    name, which the rows then take by their triplets. The rows are stored once and
    moved once; a row stays in the partition of its digest while it is put together.
    ``neighbor_table`` may be a function that makes it for the wanted names (node_name).
    """
    stored = materialize(rows.select("img_id", "triplets"), "rows")
    each = stored.select(F.explode("triplets").alias("_t")).where(F.col("_t").isNotNull()).distinct().withColumn("_p", t.parse_triplet("_t"))
    ends = F.array("_p.obj", "_p.subj") if use_subject else F.array("_p.obj")
    asked = each.where(F.col("_p.rel").isNotNull()).select("_t", "_p", F.posexplode(ends).alias("_j", "_text"))
    lookup = _lookup(asked.select("_text").distinct(), entity_map, neighbor_table, fold_node_case)
    texts = F.transform("_near", lambda n: sentence(F.col("_p.subj"), F.col("_p.rel"), F.col("_p.obj"), n["edge"], n["neighbor"]))
    worded = materialize(
        asked.join(lookup, "_text").groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("_j", F.col("_name").alias("name"), texts.alias("texts")))).alias("_told")),
        "worded",
    )

    digest = F.unhex(F.md5(F.to_json(F.struct("img_id", "triplets"))))
    alike = stored.withColumn("_row", digest).repartition("_row").groupBy("_row", "img_id", "triplets").agg(F.count(F.lit(1)).alias("_times"))
    # The first item of a row carries its triplets and stays also without a text; it has a key of its own then that matches nothing.
    items = alike.select("img_id", "_row", "_times", "triplets", F.posexplode_outer("triplets").alias("_i", "_t")).withColumn("_first", F.coalesce("_i", F.lit(0)) == 0)
    spread = items.where(F.col("_first") | F.col("_t").isNotNull()).select(
        "img_id", "_row", "_times", "_i", "_first", F.when(F.col("_first"), F.col("triplets")).alias("triplets"),
        F.coalesce("_t", F.concat(F.lit("\u0000"), F.hex("_row"))).alias("_t"),
    )
    joined = spread.join(worded, "_t", "left").where(F.col("_first") | F.col("_told").isNotNull()).groupBy("_row", "img_id").agg(
        F.max("_times").alias("_times"),
        F.first("triplets", ignorenulls=True).alias("triplets"),
        F.array_sort(F.collect_list(F.when(F.col("_told").isNotNull(), F.struct("_i", "_told")))).alias("_all"),
    )
    # A name has the same neighbours wherever it occurs, so only its first place in the row counts.
    told = t.dedupe_by(F.flatten(F.col("_all._told")), lambda a: a["name"])
    kept = F.coalesce(F.filter("triplets", lambda x: x.isNotNull()), F.array().cast("array<string>"))
    once = joined.select("img_id", kept.alias("triplets"), F.flatten(F.transform(told, lambda a: a["texts"])).alias("chains"), "_times")
    return once.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_times")


def _lookup(texts: DataFrame, entity_map: DataFrame, neighbor_table: DataFrame | Callable[[DataFrame], DataFrame], fold_node_case: bool) -> DataFrame:
    """Distinct texts(_text) -> _text, _name, _near: the canonical name and its neighbours (edge, neighbor) in order."""
    known = entity_map.where(~t.is_blank("canonical")).select("entity", "canonical")
    exact = known.select(F.col("entity").alias("_text"), F.col("canonical").alias("_exact"))
    lowered = known.select(F.col("entity").alias("_low"), F.col("canonical").alias("_lowered"))
    names = (
        texts.join(exact, "_text", "left")
        .withColumn("_low", F.lower("_text"))
        .join(lowered, "_low", "left")
        .select("_text", F.coalesce("_exact", "_lowered").alias("_name"))
        .where(F.col("_name").isNotNull())
    )
    key = F.lower("_name") if fold_node_case else F.col("_name")
    names = materialize(names.withColumn("_node", key), "names")
    wanted = names.select(F.col("_node").alias("node_name")).distinct()
    table = neighbor_table(wanted) if callable(neighbor_table) else neighbor_table.join(wanted, "node_name", "left_semi")
    # At most k neighbours per node: the table is already cut.
    lists = table.groupBy(F.col("node_name").alias("_node")).agg(F.array_sort(F.collect_list(F.struct("rank", "edge", "neighbor"))).alias("_near"))
    near = t.dedupe_by(F.col("_near"), lambda n: F.struct(n["edge"], n["neighbor"]))
    return names.join(lists, "_node").select("_text", "_name", near.alias("_near"))


def chain_stats(chain_rows: DataFrame) -> DataFrame:
    """One row: rows, rows_with_chains, pct_with_chains, total_chains."""
    total, having = F.count(F.lit(1)), F.count_if(F.size("chains") > 0)
    return chain_rows.agg(
        total.alias("rows"),
        having.alias("rows_with_chains"),
        F.round(100 * having / F.greatest(total, F.lit(1)), 1).alias("pct_with_chains"),
        F.coalesce(F.sum(F.size("chains")), F.lit(0)).alias("total_chains"),
    )


def chain_coverage(answers: DataFrame, chain_rows: DataFrame, separators: Sequence[str] = (" --> ",)) -> DataFrame:
    """answers(img_id, text) and chains(img_id, chains ARRAY<STRUCT<entities, text>>) -> coverage_pct, avg_hop_depth.

    Coverage: share of answers with chains that name at least one entity of them
    (case ignored). Depth: mean number of entities after the first per chain.
    """
    joined = answers.join(chain_rows, "img_id")
    low = F.lower("text")
    named = F.exists("chains", lambda c: F.exists(c["entities"], lambda e: low.contains(F.lower(e))))
    depth = F.aggregate("chains", F.lit(0), lambda a, c: a + F.size(c["entities"]) - 1)
    count = F.size("chains")
    return joined.where(count > 0).agg(
        F.round(100 * F.avg(named.cast("double")), 2).alias("coverage_pct"),
        F.round(F.try_divide(F.sum(depth), F.sum(count)), 4).alias("avg_hop_depth"),
    )


# --- ontology triples(subject, predicate, object, lang) -----------------------


def label_index(triples: DataFrame, ord: str = "ord", always_local: bool = False) -> DataFrame:
    """key, cls, canonical: lowered English labels (no language or ``en``) of every class.

    The first class wins a key. A class without an English label falls back to its
    own name with ``_`` as spaces; ``always_local`` adds that name for every class.
    """
    english = (F.col("predicate") == "label") & (F.col("lang").isNull() | (F.col("lang") == "en"))
    cls, place = F.col("subject").alias("cls"), F.col(ord).alias("ord")
    classes = triples.where(F.col("subject").isNotNull()).groupBy(cls).agg(F.min(ord).alias("_place"))
    named = triples.where(english & F.col("subject").isNotNull()).groupBy(cls).agg(
        F.array_sort(F.collect_list(F.struct(place, F.col("object").alias("label")))).alias("_labels")
    )
    # The labels go to the one row of their class; making the classes reads all triples.
    labels = F.coalesce(F.transform("_labels", lambda e: e["label"]), F.array().cast("array<string>"))
    local = F.replace("cls", F.lit("_"), F.lit(" "))
    whole = classes.join(named, "cls", "left").select("cls", "_place", labels.alias("_labels"), local.alias("_local"))
    has = F.size("_labels") > 0
    every = F.concat("_labels", F.array("_local")) if always_local else F.when(has, F.col("_labels")).otherwise(F.array("_local"))
    canonical = F.when(has, F.try_element_at("_labels", F.lit(1))).otherwise(F.col("_local"))
    keyed = whole.select("cls", "_place", canonical.alias("canonical"), F.explode(every).alias("label")).select(
        t.strip(F.lower("label")).alias("key"), "cls", "_place", "canonical"
    )
    first = keyed.where(F.col("key") != "").groupBy("key").agg(
        F.min_by(F.struct("cls", "canonical"), F.struct("_place", "cls")).alias("_first")
    )
    return first.select("key", F.col("_first.cls").alias("cls"), F.col("_first.canonical").alias("canonical"))


def ontology_neighbors(triples: DataFrame, index: DataFrame, ord: str = "ord", k: int = MAX_NEIGHBORS, keys: DataFrame | None = None) -> DataFrame:
    """node_name (a label key), edge, neighbor, rank: cause relations first, then caused-by; outgoing only.

    ``keys``, some rows of the index, restricts the start nodes; ``triples`` then needs no other subjects.
    """
    cause = F.col("predicate").isin(CAUSE)
    out = triples.where(F.col("predicate").isin(CAUSE + CAUSED_BY)).select(
        F.col("subject").alias("cls"),
        F.when(cause, CAUSE[0]).otherwise(CAUSED_BY[0]).alias("edge"),
        F.col("object").alias("_to"),
        F.when(cause, 0).otherwise(1).alias("_group"),
        F.col(ord).alias("_ord"),
    )
    start = (index if keys is None else keys).select("cls", F.col("key").alias("node_name"))
    cut = top_per_group(out, ["cls"], ["_group", "_ord", "_to"], k, rank="rank").join(start, "cls")
    labels = index.groupBy(F.col("cls").alias("_to")).agg(F.first("canonical").alias("_label"))
    shown = F.coalesce("_label", F.replace("_to", F.lit("_"), F.lit(" ")))
    return cut.join(labels, "_to", "left").select("node_name", "edge", shown.alias("neighbor"), "rank")


def class_neighbors(triples: DataFrame, relations: Sequence[str]) -> DataFrame:
    """cls, direction, edge, other; a relation of a class to itself counts as outgoing only."""
    rel = triples.where(F.col("predicate").isin(list(relations)))
    out = rel.select(
        F.col("subject").alias("cls"), F.lit("outgoing").alias("direction"), F.col("predicate").alias("edge"), F.col("object").alias("other")
    )
    back = rel.where(F.col("subject") != F.col("object")).select(
        F.col("object").alias("cls"), F.lit("incoming").alias("direction"), F.col("predicate").alias("edge"), F.col("subject").alias("other")
    )
    return out.unionByName(back)


def parents(triples: DataFrame, ord: str = "ord", n: int = 3) -> DataFrame:
    """cls, parent, rank: the first ``n`` is-a parents of every class."""
    isa = triples.where(F.col("predicate") == "is_a").select(F.col("subject").alias("cls"), F.col("object").alias("parent"), ord)
    return top_per_group(isa, ["cls"], [ord, "parent"], n, rank="rank").select("cls", "parent", "rank")


def relation_counts(triples: DataFrame, relations: Sequence[str] | None = None, ord: str = "ord", examples: int = 3) -> DataFrame:
    """predicate, n, examples: relations per property with the first few as text."""
    rel = triples if relations is None else triples.where(F.col("predicate").isin(list(relations)))
    counts = rel.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    top = top_per_group(rel, ["predicate"], [ord, "subject", "object"], examples, rank="_r")
    shown = top.groupBy("predicate").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_r", t.concat(F.col("subject"), " -> ", F.col("object")).alias("s")))),
            lambda e: e["s"],
        ).alias("examples")
    )
    return counts.join(shown, "predicate").select("predicate", "n", "examples")


def coverage(seeds: DataFrame, index: DataFrame) -> DataFrame:
    """seeds(grp, name) against index(key): grp, total, found."""
    keys = index.select(F.col("key").alias("_key")).distinct()
    asked = seeds.withColumn("_key", t.strip(F.lower("name")))
    hit = keys.withColumn("_hit", F.lit(1))
    return (
        asked.join(hit, "_key", "left")
        .groupBy("grp")
        .agg(F.count(F.lit(1)).alias("total"), F.count("_hit").alias("found"))
    )
