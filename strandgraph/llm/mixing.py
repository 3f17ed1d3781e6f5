"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r, the number of times the mix takes it on average.
Among all rates from 0 to ``cap`` that give each source its target of words, the
chosen ones are nearest to 1 in relative entropy. By duality they are
exponentially tilted, r = min(cap, exp(lambda * size)), with one multiplier per
source: the convex dual is separable, so its Hessian is diagonal and every
source takes its own safeguarded Newton step, all of them in one aggregation.
The rates are then rounded into whole copies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandgraph.llm.common import BROADCAST_ROWS, counted_join, fresh
from strandgraph.llm.sharding import place
from strandgraph.operators.ordinal import with_ordinal
from strandgraph.session import materialize

#: Steps beyond which Newton's iterations stop; each also halves its bracket at worst.
STEPS = 60
#: A source is done when its words are within this share of its target.
CLOSE = 1e-6
#: Documents per source and size class that close what is left of a gap, all less than one document.
SPARE = 8


def source_sizes(rows: DataFrame) -> DataFrame:
    """Words per source of ``rows`` (source, size): named, source_size. Pre-aggregated before the shuffle."""
    return rows.groupBy("named", "source").agg(F.sum("size").alias("source_size"))


def capped_targets(sources: DataFrame, weights: list[int], cap: int) -> DataFrame:
    """Add ``target``: the total shared by weight, no source above ``cap`` times its size.

    Weights go to the sources by code point, null last, repeating. The excess of
    capped sources is shared again by weight among the others until none is above:
    the others then get the same multiple of their weight, which is what the loop
    looks for. It ends after at most as many rounds as there are distinct caps hit;
    each round is one aggregation to a single row.
    """
    order = [(~F.col("named")).cast("int"), F.col("source")]
    ranked = materialize(
        with_ordinal(sources, order, name="_rank").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))),
        "sources",
    )
    total = ranked.agg(F.sum("source_size")).first()[0]
    limit = F.col("source_size") * cap
    fixed, multiple = -1, 0.0
    if total:
        multiple = total / ranked.agg(F.sum("weight")).first()[0]
        while True:
            above = limit <= F.lit(multiple) * F.col("weight")
            row = ranked.agg(F.count_if(above), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
            if row[0] == fixed or not row[2]:
                break
            fixed, multiple = row[0], (total - (row[1] or 0)) / row[2]
    return ranked.withColumn("target", F.least(limit.cast("double"), F.lit(multiple) * F.col("weight"))).drop("_rank", "weight")


def tilts(rows: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """Add ``tilt`` (lambda) to ``sources``: null means that every rate is ``cap`` (the target is all the cap allows).

    The rows are first counted by (source, size), all that a rate depends on; each
    Newton step is one join and one aggregation of those counts. A step that
    leaves the bracket known to hold the root is replaced by the bracket's middle.
    Sums are exact decimals, so reruns agree whatever the order of addition.
    """
    counts = materialize(rows.where("size > 0").groupBy("named", "source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    state = sources.withColumn("full", F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).select(
        "named", "source", "source_size", "target", "full",
        F.lit(0.0).alias("tilt"),
        # sizes are at least 1, so these two multipliers give too few and too many words
        F.when(F.col("target") > 0, F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")))).otherwise(-60.0).alias("low"),
        F.lit(math.log(cap)).alias("high"),
        (F.col("full") | (F.col("source_size") == 0) | (F.col("target") == F.col("source_size"))).alias("done"),
    )
    state = materialize(state, "tilts")
    for _ in range(STEPS):
        if not state.where("not done").limit(1).count():
            break
        open_ = counted_join(counts, state.where("not done"), ["named", "source"])
        rate = F.exp(F.col("tilt") * F.col("size"))
        exact = lambda value: F.sum(value.cast("decimal(28,8)"))
        sums = open_.groupBy("named", "source").agg(
            exact(F.least(F.lit(float(cap)), rate) * F.col("size") * F.col("n")).cast("double").alias("words"),
            exact(F.when(rate < cap, rate * F.col("size") * F.col("size") * F.col("n")).otherwise(0.0)).cast("double").alias("slope"),
        )
        stepped = state.join(sums, ["named", "source"], "left").withColumn("gap", F.col("words") - F.col("target"))
        stepped = stepped.withColumn("low", F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low")))
        stepped = stepped.withColumn("high", F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - F.col("gap") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        close = F.col("done") | (F.abs(F.col("gap")) <= F.lit(CLOSE) * F.col("target"))
        stepped = stepped.withColumn("next", F.when(close, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
        stepped = stepped.withColumn("done", close)
        state = materialize(
            stepped.select("named", "source", "source_size", "target", "full", F.col("next").alias("tilt"), "low", "high", "done"), "tilts"
        )
    return materialize(state.select("named", "source", "source_size", "target", F.when(~F.col("full"), F.col("tilt")).alias("tilt")), "tilts")


def draw(key: Column, seed: int) -> Column:
    """A repeatable number from 0 up to 1 for a key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def balance(rows: DataFrame, weights: list[int], cap: int = 3, seed: int = 7) -> DataFrame:
    """Copies of every document so that each source takes its target of words.

    ``rows`` is a stored table of (row, key, source, size): ``row`` a unique id, ``key``
    what reruns have in common, ``size`` words. Returns (row, key, size, source_size,
    target, taken) with taken = copies * size, at most ``cap`` times the size.

    Null sources form one source; sizes of 0 take 0 words; null keys are keys like any
    other; an empty table gives no rows; repeated rows are documents of their own.
    """
    made = plan(rows, weights, cap, seed)
    final = with_copies(rows, made, "row", "key", "source", F.col("size"), "copies")
    told = made.sources.select(F.struct("named", "source").alias("of_source"), "source_size", "target")
    own = F.struct(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"))
    final = final.join(_small(told), own == F.col("of_source"))
    return final.select("row", "key", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@dataclass(frozen=True)
class Plan:
    """What decides on copies: the tilt of each source, and single copies (row, more) that mend the rounding."""

    sources: DataFrame
    mended: DataFrame
    cap: int
    seed: int


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def with_copies(documents: DataFrame, made: Plan, row: str, key: str, source: str, size: Column, name: str) -> DataFrame:
    """Add the number of copies of each document where it stands: only the plan moves, while it is small.

    Rows beside ``documents`` are one per source and one per mended document.
    """
    its, tilt, at, more, words = (fresh(documents, c) for c in ("of_source", "tilt", "at_row", "more", "words"))
    named = lambda is_named, name: F.struct(is_named.alias("named"), name.alias("source"))
    sides = _small(made.sources.select(named(F.col("named"), F.col("source")).alias(its), F.col("tilt").alias(tilt)))
    mended = _small(made.mended.select(F.col("row").alias(at), F.col("more").alias(more)))
    own = named(F.col(source).isNotNull(), F.coalesce(F.col(source), F.lit("")))
    joined = documents.withColumn(words, size).join(sides, own == F.col(its)).join(mended, F.col(row) == F.col(at), "left")
    copies = _rounded(F.col(words), F.col(tilt), F.col(key), made.cap, made.seed) + F.coalesce(F.col(more), F.lit(0))
    return joined.select(*documents.columns, copies.alias(name))


def _rounded(size: Column, tilt: Column, key: Column, cap: int, seed: int) -> Column:
    """floor(rate + draw) copies, the draw being a digest of the key."""
    rate = F.coalesce(F.least(F.lit(float(cap)), F.exp(tilt * size)), F.lit(float(cap)))
    return F.when(size == 0, 0).otherwise(F.least(F.lit(cap), F.floor(rate + draw(key, seed)))).cast("long")


def plan(rows: DataFrame, weights: list[int], cap: int = 3, seed: int = 7) -> Plan:
    """The tilts of all sources and the documents whose single copies mend the rounding.

    Of the documents that can still move in the direction of a source's gap, as many
    get or lose a copy, in an order drawn by digest, as their sizes fit into the gap: a
    prefix sum over all of them, however large the source. What is left is less than
    the next document, and is closed by a few of each size class (a power of two),
    largest first, so a source ends within about its smallest documents of the target.
    """
    keyed = rows.select("row", "key", F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"), "size")
    sources = capped_targets(source_sizes(keyed), weights, cap)
    tilted = tilts(keyed, sources, cap)
    copies = _rounded(F.col("size"), F.col("tilt"), F.col("key"), cap, seed)
    first = materialize(counted_join(keyed, tilted, ["named", "source"]).withColumn("copies", copies).drop("tilt"), "copies")

    taken = F.sum(F.col("copies") * F.col("size"))
    gaps = first.groupBy("named", "source").agg((F.round(F.first("target")) - taken).cast("long").alias("gap")).where("gap <> 0")
    can = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.col("size") < 2 * F.abs("gap"))
    movable = counted_join(first.where("size > 0"), materialize(gaps, "gaps"), ["named", "source"]).where(can)
    movable = movable.select("named", "source", "gap", draw(F.col("key"), seed + 1).alias("draw"), "key", "row", "size")
    placed = materialize(place(materialize(movable, "movable"), ["named", "source", "draw", "key", "row"], "size"), "placed")
    starts = materialize(placed.groupBy("named", "source").agg(F.min("before").alias("start")), "starts")
    fits = F.col("before") - F.col("start") + F.col("size") <= F.abs("gap")
    placed = materialize(counted_join(placed, starts, ["named", "source"]).withColumn("bulk", fits), "placed")
    sign = F.signum("gap").cast("long")
    bulk = placed.where("bulk").select("row", sign.alias("more"))

    left = placed.groupBy("named", "source").agg((F.first("gap") - F.first(sign) * F.coalesce(F.sum(F.when(F.col("bulk"), F.col("size"))), F.lit(0))).alias("left"))
    rest = counted_join(placed.where("NOT bulk"), materialize(left.where("left <> 0"), "left"), ["named", "source"]).where(F.col("size") < 2 * F.abs("left"))
    by_class = W.partitionBy("named", "source", "class").orderBy("draw", "key", "row")
    rest = rest.withColumn("class", F.floor(F.log2("size"))).withColumn("_n", F.row_number().over(by_class)).where(F.col("_n") <= SPARE)
    listed = rest.groupBy("named", "source", "left").agg(
        F.sort_array(F.collect_list(F.struct("size", "draw", "row")), asc=False).alias("spare")  # at most SPARE per class
    )
    start = F.struct(F.col("left").alias("left"), F.expr("cast(array() as array<struct<row: bigint, more: bigint>>)").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        way = F.signum(F.col("left")).cast("long")  # the way of the first gap: each document moves once
        after = acc["left"] - way * x["size"]
        more = F.struct(x["row"].alias("row"), way.alias("more"))
        return F.when(F.abs(after) < F.abs(acc["left"]), F.struct(after.alias("left"), F.concat(acc["rows"], F.array(more)).alias("rows"))).otherwise(acc)

    chosen = F.aggregate("spare", start, step, lambda acc: acc["rows"])
    return Plan(tilted, materialize(bulk.union(listed.select(F.inline(chosen))), "mended"), cap, seed)
