"""Positions, latest/first rows per key, top rows per group, chunks and samples.

A position over a whole table is never computed with an unpartitioned window,
which would move the table into one task. Rows are range-partitioned by the order
key instead, numbered inside their partition and shifted by the partition's
offset; only the per-partition counts (one row per partition) are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandgraph.session import column, materialize

_LOCAL_BITS = 33  # monotonically_increasing_id: partition in the high bits, row below


def with_ordinal(df: DataFrame, order: Sequence[Column | str], name: str = "ord", start: int = 0) -> DataFrame:
    """Add the dense position of every row under ``order`` (which should be unique).

    Materialises the sorted rows once, so the counts and the rows they number are
    taken from the same partitions even when an executor is lost.
    """
    keys = [column(c) for c in order]
    numbered = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    )
    split = numbered.withColumn("_part", F.shiftright("_mid", _LOCAL_BITS)).withColumn(
        "_local", F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        split.groupBy("_part")
        .agg((F.max("_local") + 1).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        split.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_offset") + F.col("_local") + F.lit(start))
        .drop("_mid", "_part", "_local", "_offset")
    )


def with_group_ordinal(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str = "ord", start: int = 0
) -> DataFrame:
    """Position inside a group, without bringing a (possibly huge) group into one task."""
    placed = with_ordinal(df, [*groups, *order], name="_pos")
    first = placed.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(F.min("_pos").alias("_first"))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    return placed.join(first, same).select(*df.columns, (F.col("_pos") - F.col("_first") + start).alias(name))


def latest_by(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """Last row per key (last write wins); partially aggregated before the shuffle."""
    return _pick(df, keys, order, F.max_by)


def first_by(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """First row per key (first write wins); partially aggregated before the shuffle."""
    return _pick(df, keys, order, F.min_by)


def one_per_key(side: DataFrame, keys: Sequence[str], order: Column | str | None = None) -> DataFrame:
    """The lookup side of a join with one row per key, so that the join cannot multiply rows.

    With ``order`` the last row of a key counts, as a later line of an answer file
    replaces an earlier one. Without it a key that repeats is an error, because
    nothing says which of its rows is meant.
    """
    if order is not None:
        return latest_by(side, keys, order)
    rest = [c for c in side.columns if c not in keys]
    grouped = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    twice = F.raise_error(F.concat(F.lit("repeated key without an order: "), F.to_json(F.struct(*keys))))
    checked = grouped.withColumn("_row", F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.when(twice.isNull(), F.col("_row"))))
    return checked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in side.columns])


def _pick(df: DataFrame, keys: Sequence[str], order: Column | str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), column(order)).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group under ``order``.

    The bound on row_number lets Spark cut every group to ``n`` rows per input
    partition before the shuffle, so a hot group never reaches one task whole.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def chunks(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """Contiguous chunks of ceil(rows / n) rows; may give fewer than ``n`` chunks."""
    placed = with_ordinal(df, order, name="_pos")
    size = placed.agg(F.ceil(F.count(F.lit(1)) / F.lit(n)).alias("_size"))
    return (
        placed.crossJoin(F.broadcast(size))  # one row
        .withColumn("chunk", F.floor(F.col("_pos") / F.col("_size")))
        .drop("_pos", "_size")
    )


def seeded_draw(key: Column | str, seed: int) -> Column:
    """A repeatable pseudo-random sort key: the digest of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), column(key).cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A repeatable sample of ``n`` rows without replacement, sorted by ``key``."""
    return df.orderBy(seeded_draw(key, seed), key).limit(n).orderBy(key)


def length_groups(df: DataFrame, length: str, key: str, batch: int, world: int, seed: int) -> DataFrame:
    """Batches of similar length for ``world`` workers of ``batch`` rows each.

    Rows are put in a repeatable random order, cut into blocks of world x batch,
    sorted by length inside a block and dealt to the workers in serpentine order, so
    the workers' totals stay close. A positive length marks one modality and a
    negative one the other; they never share a block. The two last, incomplete
    blocks come at the end. Adds ``batch_id`` and ``slot``.
    """
    size = batch * world
    rows = df.withColumn("_modality", F.signum(length).cast("int")).withColumn("_draw", seeded_draw(key, seed))
    placed = with_group_ordinal(rows, ["_modality"], ["_draw", key], name="_pos")
    block = F.floor(F.col("_pos") / F.lit(size))
    # A block has at most world x batch rows, so this window is bounded.
    inside = W.partitionBy("_modality", "_block").orderBy(F.abs(F.col(length)).desc(), F.col("_pos"))
    ranked = placed.withColumn("_block", block).withColumn("_rank", F.row_number().over(inside) - 1)
    row, place = F.floor(F.col("_rank") / F.lit(world)), F.pmod(F.col("_rank"), F.lit(world))
    worker = F.when(F.pmod(row, F.lit(2)) == 0, place).otherwise(F.lit(world - 1) - place)
    totals = placed.groupBy("_modality").agg(F.count(F.lit(1)).alias("_total"))  # one row per modality
    full = (F.col("_block") + 1) * size <= F.col("_total")
    return (
        ranked.withColumn("_worker", worker)
        .join(F.broadcast(totals), "_modality")
        .withColumn("is_leftover", ~full)
        .withColumn("batch_id", concat_id(F.col("_modality"), F.col("_block"), F.col("_worker")))
        .withColumn("slot", row)
        .drop("_modality", "_draw", "_pos", "_block", "_rank", "_worker", "_total")
    )


def concat_id(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])
