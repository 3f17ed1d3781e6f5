"""Connected components of large link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.session import materialize

#: Rounds beyond which something is wrong: the method needs about log(longest chain) of them.
ROUNDS = 64


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``: the smallest node reachable.

    Alternating stars: every node points its larger neighbours at its smallest
    neighbour, then its smaller neighbours (and itself) at the smallest of them,
    until only stars are left. The smallest neighbour is found by an aggregation
    that combines before the shuffle, so the many links of a hub are never gathered;
    the join that hands it out is split by adaptive execution. Every round is
    written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "links")
    before = None
    for _ in range(ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "stars")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return roots.select("node", F.col("node").alias("component")).union(edges.select("u", "v"))
