"""Contiguous shards of near equal bytes, from global prefix sums.

Rows are range-partitioned by (group digest, id) and summed inside their
partition; one total per partition, added up, turns local into global prefix
sums. The line of all bytes is cut at equal targets. No step sees a whole group
or the whole table in one task: a group that holds a third of all rows spreads
over as many range partitions as its bytes need, because the id is part of the
range key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandgraph.session import materialize


def place(df: DataFrame, order: list[str], size: str, partitions: int | None = None) -> DataFrame:
    """Add ``before`` (bytes of all earlier rows under ``order``) and ``position`` (their number).

    ``df`` should be narrow and stored: it is read twice, once to sample the
    ranges. The sorted rows are stored with their partition number, so a task that
    is run again cannot renumber them. Offsets are one row per range partition.
    Rows that tie in all of ``order`` are interchangeable.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("_part").orderBy(*order, size).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.withColumn("_bytes", F.sum(size).over(inside) - F.col(size)).withColumn("_rows", F.count(F.lit(1)).over(inside) - 1)
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = (
        ranged.groupBy("_part")
        .agg(F.sum(size).alias("_total"), F.count(F.lit(1)).alias("_count"))
        .select(
            "_part",
            F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_rows_before"),
        )
    )
    return local.join(F.broadcast(offsets), "_part").select(
        *df.columns,
        (F.col("_bytes") + F.col("_bytes_before")).alias("before"),
        (F.col("_rows") + F.col("_rows_before")).alias("position"),
    )


def cuts(placed: DataFrame, size: str, group: str, shards: int) -> list[int]:
    """The bytes in front of each shard but the first, ascending: ``shards - 1`` numbers.

    Target k is total * k / shards. The row that covers it goes to the side that
    holds its middle. If the row's whole group (equal texts) is no larger than the
    largest single row, the whole group goes to one side instead; larger groups are
    split. So every cut is within one largest row of its target either way.
    """
    total, largest = placed.agg(F.sum(size), F.max(size)).first()
    if total is None:
        return [0] * (shards - 1)
    end = F.col("before") + F.col(size)
    target_from = lambda byte: F.expr(f"({byte} * {shards} + {total - 1}) div {total}")  # noqa: E731  first target at or after it
    reached = placed.select(group, "before", end.alias("stop")).withColumn("low", F.greatest(F.lit(1), target_from("before")))
    reached = reached.withColumn("high", F.least(F.lit(shards), target_from("stop")) - 1).where("low <= high")
    rows = reached.select("*", F.explode(F.sequence("low", "high")).alias("k")).collect()  # one row per target
    names = [F.lit(v) for v in sorted({_plain(row[group]) for row in rows})]
    spans = {
        _plain(row[group]): (row["start"], row["stop"])
        for row in placed.where(F.col(group).isin(names)).groupBy(group).agg(F.min("before").alias("start"), F.max(end).alias("stop")).collect()
    }
    out = []
    for row in sorted(rows, key=lambda r: r["k"]):
        target = total * row["k"] // shards
        start, stop = spans[_plain(row[group])]
        if stop - start > largest:
            start, stop = row["before"], row["stop"]
        out.append(start if 2 * target < start + stop else stop)
    return out


def _plain(value):
    return bytes(value) if isinstance(value, bytearray) else value


def shard_by_bytes(rows: DataFrame, key: str, size: str, group: str, shards: int, partitions: int | None = None) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (position in the shard, gapless from 0).

    ``rows`` is narrow (no texts) and stored; ``size`` is a positive long, ``group``
    a digest that equal texts share. Shards are contiguous under (group, key).
    Fewer rows than shards leave some shards empty; an empty table gives no rows;
    null keys come first; repeated rows are placed one by one.
    """
    placed = materialize(place(rows, [group, key], size, partitions), "placed")
    marks = cuts(placed, size, group, shards)
    shard: Column = F.lit(0)
    for mark in marks:
        shard = shard + (F.col("before") >= F.lit(mark)).cast("int")
    named = placed.withColumn("shard", shard.cast("int"))
    firsts = named.groupBy("shard").agg(F.min("position").alias("_first"))  # one row per shard
    return named.join(F.broadcast(firsts), "shard").select(*rows.columns, "shard", (F.col("position") - F.col("_first")).alias("slot"))


def text_sizes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Narrow rows of documents: key, size (UTF-8 bytes of the text plus 1), text_crc32 and the digest of the text.

    Null counts as the empty text. Every row has a positive size.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return documents.select(
        F.col(key),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
    )
