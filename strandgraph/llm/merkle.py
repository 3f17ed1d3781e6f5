"""Merkle manifest of a table: ternary hash trees kept as append logs in postorder.

Every group of rows (a source) is a tree over its leaves, and the roots of the
groups are the leaves of one tree on top. Trees are built by builders that are
aligned to blocks of ``FAN ** STRIDE`` nodes: a builder reads the nodes of its block
in order and appends each node to its log once all below it is complete, so the
log is in postorder and the builder holds no more than one unfinished run per level.
The roots of the blocks are the entries of the next stride, until each tree has one
node left. In a postorder log the position of any node follows from the sizes of the
subtrees in front of it, so a proof addresses the siblings on a path by arithmetic,
without an index. Steps above a block are the same for all its leaves and are handed
down once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.llm.common import BROADCAST_ROWS, bounded_batches, counted_join
from strandgraph.operators.ordinal import with_group_ordinal, with_ordinal
from strandgraph.session import materialize

#: Nodes of a run, which together become the node above.
FAN = 3
#: Levels that one builder completes: it reads 243 nodes at most and writes 364.
STRIDE = 5

_STEPS = "array<struct<before:string,after:string>>"


def digest_of(parts: Iterable[str]) -> str:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    text = [field.cast("string") for field in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


# --- one log -----------------------------------------------------------------


def height(count: int) -> int:
    """Levels above ``count`` leaves until one node is left."""
    level, reach = 0, 1
    while reach < count:
        level, reach = level + 1, reach * FAN
    return level


def position(level: int, index: int, count: int) -> int:
    """Place in the log of node ``index`` of a level, in a tree of ``count`` leaves.

    In front of a node stand all nodes that were complete when its first leaf came,
    and the rest of its own subtree, which it ends.
    """
    first = index * FAN**level
    covered = min(FAN**level, count - first)
    before, size = 0, first
    while size:
        before += size
        size //= FAN
    own = sum(-(-covered // FAN**below) for below in range(level + 1))
    return before + own - 1


def append_log(entries: Iterable[str], levels: int) -> list[str]:
    """The nodes over ``entries`` in the order in which they are complete; the last one is the root."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def put(level: int, node: str) -> None:
        log.append(node)
        open_[level].append(node)

    for entry in entries:
        put(0, entry)
        level = 0
        while level < levels and len(open_[level]) == FAN:
            node = digest_of(open_[level])
            open_[level].clear()
            level += 1
            put(level, node)
    for level in range(levels):  # the last run of each level may be short
        if open_[level]:
            node = digest_of(open_[level])
            open_[level].clear()
            put(level + 1, node)
    return log


def _step(log: Sequence[str], level: int, node: int, count: int) -> tuple[str, str]:
    first = node - node % FAN
    behind = min(first + FAN, -(-count // FAN**level))
    at = lambda k: log[position(level, k, count)]
    return "".join(map(at, range(first, node))), "".join(map(at, range(node + 1, behind)))


def block_steps(log: Sequence[str], index: int, count: int, levels: int) -> list[tuple[str, str]]:
    """The siblings in front of and behind the path of an entry, level by level; a short block goes up as many levels as the others."""
    return [_step(log, level, index // FAN**level, count) for level in range(levels)]


def fold(leaf: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its path give."""
    for before, after in path:
        leaf = digest_of((before, leaf, after))
    return leaf


# --- many logs ---------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """The blocks of each stride (tree, block, total, count, levels, log) from the leaves up, and the root of every tree (tree, root)."""

    strides: list[DataFrame]
    roots: DataFrame


def _build(entries: DataFrame) -> DataFrame:
    """(tree, block, total, count, levels, log) from entries (tree, index, total, digest); total is the entries of the tree, count those of the block."""
    schema = "tree long, block long, total long, count int, levels int, log array<string>"
    whole = [("tree", pa.int64()), ("block", pa.int64()), ("total", pa.int64())]
    arrow = pa.schema([*whole, ("count", pa.int32()), ("levels", pa.int32()), ("log", pa.list_(pa.string()))])

    def row(tree: int, block: int, total: int, nodes: list[str]) -> pa.RecordBatch:
        levels = min(STRIDE, height(total))
        made = {"tree": tree, "block": block, "total": total, "count": len(nodes), "levels": levels, "log": append_log(nodes, levels)}
        return pa.RecordBatch.from_pylist([made], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes = None, []
        for batch in batches:
            for tree, block, total, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "total", "digest"))):
                if at != (tree, block, total):
                    if nodes:
                        yield row(*at, nodes)
                    at, nodes = (tree, block, total), []
                nodes.append(digest)
        if nodes:
            yield row(*at, nodes)

    block = F.expr(f"index div {FAN**STRIDE}").alias("block")
    dealt = entries.select("tree", block, "index", "total", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    return bounded_batches(dealt).mapInArrow(run, schema)


def grow(entries: DataFrame) -> Forest:
    """All trees over entries (tree long, index long dense from 0, total long, digest string), a stride at a time.

    A stride cuts the nodes by 243, so a trillion leaves take six.
    """
    strides: list[DataFrame] = []
    roots: DataFrame | None = None
    while True:
        blocks = materialize(_build(entries), "log")
        strides.append(blocks)
        ends = F.col("total") <= FAN**STRIDE
        done = blocks.where(ends).select("tree", F.element_at("log", -1).alias("root"))
        roots = done if roots is None else roots.union(done)
        total = F.expr(f"(total + {FAN**STRIDE - 1}) div {FAN**STRIDE}").alias("total")
        entries = blocks.where(~ends).select("tree", F.col("block").alias("index"), total, F.element_at("log", -1).alias("digest"))
        if not entries.limit(1).count():
            return Forest(strides, materialize(roots, "roots"))


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, block, path): the steps of every entry of a stride up to the top, ``above`` holding those of its blocks."""
    schema = f"tree long, block long, path {_STEPS}"
    arrow = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, count, levels, log, path in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "count", "levels", "log", "path"))):
                out = []
                for index in range(count):
                    own = [{"before": b, "after": a} for b, a in block_steps(log, index, count, levels)]
                    out.append({"tree": tree, "block": block * FAN**STRIDE + index, "path": own + path})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    joined = blocks.join(above, ["tree", "block"])
    return bounded_batches(joined).mapInArrow(run, schema)


def paths_to_blocks(forest: Forest, above: DataFrame) -> DataFrame:
    """(tree, block, path) of the blocks of the lowest stride; ``above`` (tree, path) holds the steps above each tree's root.

    In the stride where a tree ends it has one block, whose steps are those above the tree.
    """
    below: DataFrame | None = None
    for k in reversed(range(len(forest.strides))):
        ended = forest.strides[k].where(F.col("total") <= FAN**STRIDE).select("tree", "block")
        known = ended.join(above, "tree").select("tree", "block", "path")
        known = known if below is None else known.union(below)
        below = materialize(_descend(forest.strides[k], known) if k else known, "paths")
    return below


@dataclass(frozen=True)
class Manifest:
    """Numbered leaves with the caller's columns, the trees of the groups, and the tree on top of them."""

    leaves: DataFrame
    forest: Forest
    top: Forest


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str) -> Manifest:
    """Trees over ``rows``, whose column ``leaf`` holds their digests.

    Groups are ordered by their UTF-8 bytes, null first; leaves ascend by ``order``
    inside their group, nulls first, and rows that tie there by their digest. All rows
    are leaves, repeated ones too. No rows give no tree.
    """
    taken = [c for c in rows.columns if c not in (group, leaf)]
    plain = rows.select(F.col(group).alias("_group"), F.col(leaf).alias("digest"), F.struct(*[F.col(c) for c in taken]).alias("_row"), *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(order)])
    orders = [f"_by_{i}" for i in range(len(order))]
    placed = with_group_ordinal(plain, ["_group"], [*orders, "digest"], "index").drop(*orders)
    totals = rows.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("total"))
    # A number in place of the name makes null a tree like any other.
    names = with_ordinal(totals, ["_group"], "tree").select(F.col("_group").alias("_name"), F.col("tree").cast("long").alias("tree"), "total")
    names = materialize(names, "groups")
    count = names.count()
    small = F.broadcast(names) if count <= BROADCAST_ROWS else names
    leaves = placed.join(small, placed["_group"].eqNullSafe(small["_name"])).select("tree", "index", "total", "digest", "_row")
    leaves = materialize(leaves, "leaves")
    forest = grow(leaves.select("tree", "index", "total", "digest"))
    entries = forest.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(count).cast("long").alias("total"), F.col("root").alias("digest"))
    return Manifest(leaves, forest, grow(entries))


def prove(made: Manifest, claimed: str) -> DataFrame:
    """Per leaf: the caller's columns, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``claimed`` names the caller's column with the digest that someone holds for the
    row; it is folded with the siblings of the true leaf. ``proof_sha256`` is the
    digest of those siblings, from the leaf up, left to right.
    """
    top_paths = paths_to_blocks(made.top, _no_path(made.top))
    over_trees = _descend(made.top.strides[0], top_paths).select(F.col("block").alias("tree"), "path")
    heads = paths_to_blocks(made.forest, materialize(over_trees, "paths"))
    root = made.top.roots.select(F.col("root").alias("_root"))
    heads = counted_join(heads, made.forest.roots.withColumnRenamed("root", "subroot"), ["tree"]).join(made.forest.strides[0].drop("total"), ["tree", "block"])
    heads = heads.crossJoin(F.broadcast(root))  # one row
    block = F.expr(f"index div {FAN**STRIDE}")
    claims = made.leaves.select("tree", block.alias("block"), "index", F.col("digest").alias("leaf"), F.col(f"_row.{claimed}").alias("claimed"), "_row")
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    row_type = made.leaves.schema["_row"].dataType
    told = heads.select(
        "tree", "block", nothing("index", "long"), nothing("leaf", "string"), nothing("claimed", "string"), F.lit(None).cast(row_type).alias("_row"),
        "count", "levels", "log", "path", "subroot", F.col("_root").alias("root"),
    )
    asked = claims.select(
        "tree", "block", "index", "leaf", "claimed", "_row",
        nothing("count", "int"), nothing("levels", "int"), nothing("log", "array<string>"), nothing("path", _STEPS), nothing("subroot", "string"), nothing("root", "string"),
    )
    found = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([T.StructField("_row", row_type), *(T.StructField(c, T.StringType()) for c in found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict = {}
        for batch in batches:
            heads_here = {i: None for i, index in enumerate(batch.column("index").to_pylist()) if index is None}
            kept, out = [], {c: [] for c in found}
            columns = [batch.column(c).to_pylist() for c in ("index", "leaf", "claimed")]
            for i, (index, leaf, claim) in enumerate(zip(*columns)):
                if i in heads_here:
                    head = {c: batch.column(c)[i].as_py() for c in ("count", "levels", "log", "path", "subroot", "root")}
                    head["above"] = [(p["before"], p["after"]) for p in head["path"]]
                    continue
                path = block_steps(head["log"], index % FAN**STRIDE, head["count"], head["levels"]) + head["above"]
                kept.append(i)
                out["leaf"].append(leaf)
                out["subroot"].append(head["subroot"])
                out["root"].append(head["root"])
                out["proof_sha256"].append(digest_of(part for step in path for part in step))
                out["folded_root"].append(fold(claim, path))
            rows = batch.column("_row").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(out[c], pa.string()) for c in found)], names=["_row", *found])

    dealt = told.union(asked).repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("index").asc_nulls_first())
    proved = bounded_batches(dealt).mapInArrow(run, schema)
    return proved.select("_row.*", *found, (F.col("folded_root") == F.col("root")).alias("verified"))


def _no_path(forest: Forest) -> DataFrame:
    return forest.roots.select("tree", F.array().cast(_STEPS).alias("path"))
