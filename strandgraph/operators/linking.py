"""Entity linking: a cascade of stages, each a table entity -> canonical name.

A stage that has the key decides, even with a null name; later stages are then
not asked. The stages: manual pairs, exact names, concept candidates, fuzzy names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def manual_stage(spark: SparkSession, pairs: Mapping[str, str | None]) -> DataFrame:
    """entity, canonical from a small literal map; a null name blocks later stages."""
    return spark.createDataFrame(list(pairs.items()), "entity string, canonical string")


def diagnosis_stage(mapping: DataFrame) -> DataFrame:
    """The first listed node of every diagnosis, or null when it has none.

    mapping(diagnosis, matches) as node_mapping gives it.
    """
    return mapping.select(
        F.lower("diagnosis").alias("entity"), F.try_element_at("matches", F.lit(1))["node_name"].alias("canonical")
    )


def exact_stage(nodes: DataFrame) -> DataFrame:
    """Lowered node names; of several nodes the smallest index names the entity."""
    return nodes.groupBy(F.lower("node_name").alias("entity")).agg(F.min_by("node_name", "node_index").alias("canonical"))


def concept_stage(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """candidates(entity, rank, name) from an outside linker: the first whose name is a node."""
    names = exact_stage(nodes).select(F.col("entity").alias("_key"), F.col("canonical").alias("_node"))
    hits = candidates.join(names, F.lower(candidates.name) == names["_key"])
    return hits.groupBy("entity").agg(F.min_by("_node", "rank").alias("canonical"))


def link(entities: DataFrame, stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """entity, canonical, stage: the first stage that has the entity, null-named ones included."""
    out = entities.select("entity")
    name = stage = F.lit(None).cast("string")
    for i, (label, table) in enumerate(stages):
        hit = table.select(
            F.col("entity").alias("_key"), F.col("canonical").alias(f"_name{i}"), F.lit(True).alias(f"_hit{i}")
        )
        out = out.join(hit, out.entity == hit["_key"], "left").drop("_key")
    for i, (label, _) in reversed(list(enumerate(stages))):
        hit = F.coalesce(f"_hit{i}", F.lit(False))
        name = F.when(hit, F.col(f"_name{i}")).otherwise(name)
        stage = F.when(hit, F.lit(label)).otherwise(stage)
    return out.select("entity", name.alias("canonical"), stage.alias("stage"))


def link_stats(links: DataFrame) -> DataFrame:
    """stage ('none' for unmatched) -> entities, named."""
    return links.groupBy(F.coalesce("stage", F.lit("none")).alias("stage")).agg(
        F.count(F.lit(1)).alias("entities"), F.count("canonical").alias("named")
    )


# --- fuzzy names ---------------------------------------------------------------


def similar_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """left(entity), right(key) -> entity, key, score: all pairs with 100 * (1 - edits / longest) >= cutoff.

    A partition-based similarity join, which loses no pair: with at most d edits
    allowed, one of d + 1 pieces of the entity stays whole in the key, near its place.
    Entities are indexed by (length, d, piece number, piece text); a key asks for the
    few substrings that can meet each piece. Only such candidates are compared, so
    nothing is crossed, and a piece with its number and lengths is a fine-grained key.
    """
    share = (100.0 - cutoff) / 100.0
    entities = left.select("entity", F.length("entity").alias("_l")).where(F.col("_l") > 0).distinct()
    keys = right.select("key", F.length("key").alias("_k")).where(F.col("_k") > 0).distinct()

    # Lengths that can meet: the shorter is at least cutoff percent of the longer.
    low = F.greatest(F.lit(1), F.ceil(F.col("_k") * (1 - share) - 1e-9).cast("int"))
    high = F.floor(F.col("_k") / (1 - share) + 1e-9).cast("int")
    lengths = entities.select("_l").distinct()
    spread = F.floor(F.greatest("_l", "_k") * share + 1e-9).cast("int")
    asked = (
        keys.withColumn("_l", F.explode(F.sequence(low, high)))
        .join(lengths, "_l", "left_semi")
        .withColumn("_d", spread)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_d"))))
    )
    allowed = asked.select("_l", "_d").distinct()
    pieces = entities.join(allowed, "_l").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_d"))))

    def start(i: Column) -> Column:
        # Pieces split the text evenly; the last ones take the remainder.
        count = F.col("_d") + 1
        short = F.floor(F.col("_l") / count)
        return i * short + F.greatest(F.lit(0), i - (count - F.pmod(F.col("_l"), count)))

    begin, size = start(F.col("_i")), start(F.col("_i") + 1) - start(F.col("_i"))
    index = pieces.select(
        "entity", "_l", "_d", "_i", F.substring("entity", (begin + 1).cast("int"), size.cast("int")).alias("_piece")
    )
    shift = F.col("_k") - F.col("_l")
    first = F.greatest(-F.col("_i"), shift - (F.col("_d") - F.col("_i")))
    last = F.least(F.col("_i"), shift + (F.col("_d") - F.col("_i")))
    moved = asked.withColumn("_b", begin).withColumn("_s", size).withColumn("_f", first).withColumn("_t", last)
    moves = F.explode(F.when(F.col("_f") <= F.col("_t"), F.sequence(F.col("_f"), F.col("_t"))))
    probe = (
        moved.withColumn("_m", moves)
        .where((F.col("_b") + F.col("_m") >= 0) & (F.col("_b") + F.col("_m") + F.col("_s") <= F.col("_k")))
        .select(
            "key", "_l", "_d", "_i",
            F.substring("key", (F.col("_b") + F.col("_m") + 1).cast("int"), F.col("_s").cast("int")).alias("_piece"),
        )
        .distinct()
    )
    met = index.join(probe, ["_l", "_d", "_i", "_piece"]).select("entity", "key").distinct()
    longest = F.greatest(F.length("entity"), F.length("key"))
    score = 100 * (1 - F.levenshtein("entity", "key") / longest)
    return met.select("entity", "key", score.alias("score")).where(F.col("score") >= cutoff - 1e-9)


def fuzzy_stage(
    entities: DataFrame, keys: DataFrame, cutoff: float = 88.0, min_len: int = 4, min_ratio: float = 0.7
) -> DataFrame:
    """entities(entity), keys(key, canonical) -> entity, canonical: the best-scored key, ties to the first key.

    Shorter entities than ``min_len`` are skipped; an entity whose best key is shorter
    than ``min_ratio`` of it gets none. The score is the edit ratio.
    """
    scored = similar_pairs(entities.where(F.length("entity") >= min_len), keys, cutoff)
    best = scored.groupBy("entity").agg(F.min_by("key", F.struct(-F.col("score"), F.col("key"))).alias("key"))
    kept = best.where(F.length("key") >= min_ratio * F.length("entity"))
    names = keys.groupBy("key").agg(F.min("canonical").alias("canonical"))
    return kept.join(names, "key").select("entity", "canonical")
