"""Approximate nearest neighbours along several shifted Hilbert curves.

Vectors are projected to a few dimensions, shifted and put in the order of a
Hilbert curve; every curve has a projection and a shift of its own. Near vectors
lie near each other on at least one curve more often than not. In each order a
query is compared with the rows of the blocks around its place, and the best of
all curves are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandgraph.llm.sharding import place
from strandgraph.session import materialize

#: Curves, projected dimensions and bits of each.
CURVES, DIMENSIONS, BITS = 8, 3, 16
#: Share of all rows that a query looks at on either side of its place on a curve, at least.
WINDOW = 0.1
#: Rows of a block, and queries that are compared with a block in one task at most.
BLOCK = 2_048
#: Rows that the scale of the projections is taken from, on average.
FIT_ROWS = 10_000
SEED = 3


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (one row each, every coordinate below 2 ** bits) on the Hilbert curve.

    The curve visits the 2 ** d parts of a cube one after the other, each by a
    smaller curve that is turned and mirrored to fit its neighbours; undoing these
    turns from the coarsest bit to the finest leaves coordinates whose bits, taken
    across, are the Gray code of the place (Skilling 2004).
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            upper = x[i] & bit != 0
            swapped = np.where(upper, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(upper, below, swapped)
            if i:
                x[i] ^= swapped
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> level & 1
    return key


@dataclass
class Curves:
    """Projection, offset and scale of every curve."""

    bases: list[np.ndarray]
    means: list[np.ndarray]
    widths: list[np.ndarray]
    shifts: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, size: int, curves: int, dims: int) -> Curves:
        """Random orthonormal projections, scaled by the sample so that six deviations fill half of the cube; shifts fill the rest."""
        bases, means, widths, shifts = [], [], [], []
        for curve in range(curves):
            draw = np.random.default_rng([SEED, curve])
            basis = np.linalg.qr(draw.normal(size=(size, size)))[0][:, : min(dims, size)]
            seen = sample @ basis if len(sample) else np.zeros((1, basis.shape[1]))
            bases.append(basis)
            means.append(seen.mean(axis=0))
            widths.append(np.maximum(seen.std(axis=0), 1e-300) * 12)
            shifts.append(draw.uniform(0.25, 0.75, basis.shape[1]))
        return cls(bases, means, widths, shifts)

    def keys(self, vectors: np.ndarray, curve: int, bits: int) -> np.ndarray:
        spot = (vectors @ self.bases[curve] - self.means[curve]) / self.widths[curve] + self.shifts[curve]
        top = (1 << bits) - 1
        return hilbert_keys(np.clip(spot * (top + 1), 0, top).astype(np.int64), bits)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of the rows that take part: not null, no null or non-finite component, not all zero, of the most frequent length.

    Equal counts of lengths favour the shorter. Of rows that repeat a key the one with the smallest vector takes part.
    """
    v = F.col(vector)
    fine = v.isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(fine & F.exists(v, lambda x: x != 0)).select(key, vector)
    sizes = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size(vector) == (sizes["size"] if sizes else 0))
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        rows = rows.groupBy(key).agg(F.min(vector).alias(vector))
    return rows


def nearest(
    vectors: DataFrame, key: str, vector: str, is_query: Column, k: int = 10, curves: int = CURVES, window: float = WINDOW, dims: int = DIMENSIONS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row where ``is_query``, by Euclidean distance, ties to smaller keys.

    Equal vectors are one point, under the smallest of its keys and with its k + 1
    smallest ones, so that a vector of many rows takes one place on a curve; windows
    count points, and the points found are turned into their rows before ranking.
    Positions along each curve are prefix sums over range partitions. Points are
    grouped into blocks of ``BLOCK`` positions and a query is sent to the blocks of
    its window; where a block gets many queries they are dealt to several tasks.
    Every task returns at most ``k`` points per query. A query's own row is no
    candidate; fewer candidates than ``k`` give fewer rows; no usable row gives none.
    """
    every = materialize(usable(vectors, key, vector).select(F.col(key).alias("vec_id"), F.col(vector).alias("vector")), "vectors")
    schema = "query_id long, vec_id long, score double"
    if every.limit(2).count() < 2:
        empty = every.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    nth = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    few = every.withColumn("nth", nth).where(F.col("nth") <= k + 1)  # cut per input partition before the shuffle
    points = materialize(few.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    rows = points.select("vec_id", "vector")
    total = rows.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    sample = _matrix(rows.where(draw < FIT_ROWS / total).select("vector").toArrow().column("vector"))
    size = len(rows.select("vector").first()["vector"])
    model = Curves.fit(sample.reshape(-1, size), size, curves, dims)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("vector"))
            for curve in range(curves):
                number = pa.array(np.full(len(points), curve, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), number, pa.array(model.keys(points, curve, BITS))], names=["vec_id", "curve", "key"])

    keys = materialize(rows.mapInArrow(keyed, "vec_id long, curve int, key long").withColumn("one", F.lit(1).cast("long")), "keys")
    placed = place(keys, ["curve", "key", "vec_id"], "one").withColumn("at", F.col("position") - F.col("curve") * F.lit(total))
    placed = materialize(placed.select("vec_id", "curve", "at"), "placed")
    owners = every.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").join(rows, "vector").select("query_id", F.col("vec_id").alias("point"))
    owners = materialize(owners, "owners")
    asked = owners.select(F.col("point").alias("vec_id")).distinct()
    reach = int(np.ceil(window * total))
    last = (total - 1) // BLOCK
    block = lambda at: (at / F.lit(BLOCK)).cast("long")
    around = F.sequence(block(F.greatest(F.lit(0), F.col("at") - reach)), F.least(F.lit(last), block(F.col("at") + reach)))
    queries = materialize(placed.join(asked, "vec_id").select("vec_id", "curve", F.explode(around).alias("block")), "queries")
    chunks = max(1, -(-queries.count() // (curves * (last + 1) * BLOCK)))
    groups = ["curve", "block", "chunk"]
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    blocks = placed.select("vec_id", "curve", block(F.col("at")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>")).alias("chunk"))
    blocks = blocks.join(rows, "vec_id").select(*groups, "vec_id", "vector")
    queries = queries.join(rows, "vec_id").select(*[F.col(g).alias(f"q_{g}") for g in groups], F.col("vec_id").alias("query_id"), F.col("vector").alias("point"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids, points = right.column("vec_id").to_numpy(), _matrix(right.column("vector"))
            for query, point in zip(left.column("query_id").to_numpy(), _matrix(left.column("point"))):
                away = np.sqrt(np.square(points - point).sum(axis=1))
                away[ids == query] = np.inf
                limit = np.partition(away, k - 1)[k - 1] if k < len(away) else np.inf
                near = np.flatnonzero((away <= limit) & (away < np.inf))
                near = near[np.lexsort((ids[near], away[near]))][:k]
                out["query_id"] += [int(query)] * len(near)
                out["vec_id"] += ids[near].tolist()
                out["score"] += away[near].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = queries.groupBy(*[f"q_{g}" for g in groups]).cogroup(blocks.groupBy(*groups)).applyInArrow(best, schema)
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = lambda df, by: df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("score", "vec_id")))
    own = asked.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"))
    near = ranked(merged, "query_id").where(F.col("rank") <= k).select("query_id", "vec_id", "score").union(own)
    ids = points.select("vec_id", "ids")
    near = near.join(ids, "vec_id").select(F.col("query_id").alias("point"), F.explode("ids").alias("vec_id"), "score")
    near = ranked(near, "point").where(F.col("rank") <= k + 1).drop("rank")  # one may be the query itself
    pairs = owners.join(near, "point").where("vec_id <> query_id")
    return ranked(pairs, "query_id").where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
