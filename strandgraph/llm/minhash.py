"""Near copies by fast similarity sketching, banding and exact verification.

A sketch has one coordinate per bin. In each round every shingle is hashed into a
bin, and a bin that no earlier round has filled takes the smallest value that falls
into it; after as many rounds as there are bins, further rounds send all shingles to
one bin each. So every coordinate is filled after at most twice as many rounds as
bins, large sets are done after one, and the share of equal coordinates of two sets
is concentrated about their Jaccard similarity. Coordinates are cut to a byte; eight
bytes are a band, and sets that share a band are candidates.

Candidates are decided by their full sets, without making a row per pair. First each
member of a band meets the band's first member, and what is linked is joined. Where a
band still holds several components its members are dealt to bounded units, which
compare inside the task and pass on links only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.llm.common import BROADCAST_ROWS, bounded_batches, give_back
from strandgraph.llm.components import components
from strandgraph.session import materialize

SEED = 42
#: Bands, and coordinates in each: a pair of similarity s shares no band with a chance of about (1 - s ** 8) ** 40, 3e-6 at 0.85.
BANDS, ROWS = 40, 8
#: Coordinates of a sketch.
BINS = BANDS * ROWS
#: Sets that are sketched together, and their shingles.
BLOCK, BLOCK_SHINGLES = 256, 1 << 17
#: Members of a band, and shingles of them, after which a unit of comparison is split.
UNIT, UNIT_SHINGLES = 512, 1 << 20
#: A pair below the wanted similarity by more than this, by its sketches, isn't compared by its sets: 4.5 deviations at 0.85.
MARGIN = 0.09

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    ASCII letters are lowered, words are runs of anything but ASCII white space;
    fewer words make one shingle of them all, none make none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED + 1)], dtype=np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in found), dtype=np.uint64, count=len(found))
    n = len(found) - words + 1
    whole = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        whole = whole * _STEP + each[k : k + n]
    return np.unique(mixed(whole))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` signed numbers per set, eight coordinates of a byte in each. Empty sets have no sketch and get zeros."""
    out = np.zeros((len(sets), BANDS), dtype=np.int64)
    rows: list[int] = []
    size = 0
    for i, one in enumerate(sets):
        if len(one):
            rows.append(i)
            size += len(one)
        if rows and (len(rows) == BLOCK or size >= BLOCK_SHINGLES or i == len(sets) - 1):
            filled = _fill([sets[row] for row in rows])
            out[rows] = (filled & np.uint64(255)).astype(np.uint8).view("<i8")
            rows, size = [], 0
    return out


def _fill(sets: list[np.ndarray]) -> np.ndarray:
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    empty = np.iinfo(np.uint64).max
    bins = np.full(len(sets) * BINS, empty, dtype=np.uint64)
    for number in range(2 * BINS):
        hashed = mixed(values + np.uint64((number + 1) * int(_STEP) % (1 << 64)))
        if number < BINS:
            place = ((hashed >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        else:
            place = number - BINS
        slot = owner * BINS + place
        if number:  # earlier rounds take precedence
            open_ = bins[slot] == empty
            slot, hashed = slot[open_], hashed[open_]
        np.minimum.at(bins, slot, hashed)
        left = (bins.reshape(-1, BINS) == empty).any(axis=1)
        if not left.any():
            break
        keep = left[owner]
        values, owner = values[keep], owner[keep]
    return bins.reshape(-1, BINS)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def with_sketch(documents: DataFrame, text: str, words: int) -> DataFrame:
    """Replace the text column by ``n`` (the size of its set of shingles), ``digest`` (of that set) and ``sketch``."""
    kept = [c for c in documents.columns if c != text]
    added = [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))]
    schema = T.StructType([documents.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(value.as_py(), words) for value in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *set_columns(sets)], names=schema.names)
        give_back()

    return bounded_batches(documents).select(*kept, text).mapInArrow(run, schema)


def set_columns(sets: list[np.ndarray]) -> list[pa.Array]:
    """The sizes, digests and sketches of sets."""
    return [pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(set_digest, sets)), pa.binary()), _lists(sketches(sets))]


def _lists(table: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * BANDS), pa.array(table.reshape(-1)))


def with_sets(rows: DataFrame, text: str, words: int) -> DataFrame:
    """Rows (node, digest, text) to (node, n, sketch, shingles), where the set of the text has the digest."""
    schema = "node long, n long, sketch array<long>, shingles array<long>"
    names = ["node", "n", "sketch", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(value.as_py(), words) for value in batch.column(text)]
            right = [i for i, digest in enumerate(batch.column("digest").to_pylist()) if set_digest(sets[i]) == digest]
            sets = [sets[i] for i in right]
            shingles = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            columns = [batch.column("node").take(pa.array(right, pa.int64())), pa.array(list(map(len, sets)), pa.int64()), _lists(sketches(sets)), shingles]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return bounded_batches(rows).select("node", "digest", text).mapInArrow(run, schema)


def alike(x: Column, y: Column, percent: int) -> Column:
    """Whether two arrays of distinct values share at least ``percent`` of their union."""
    shared = F.size(F.array_intersect(x, y))
    return F.lit(100) * shared >= F.lit(percent) * (F.size(x) + F.size(y) - shared)


def unit_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (left, right) among the members of each unit, decided by their sets.

    ``members`` holds unit (a struct), side (0 or 1: sides are compared with each
    other; a unit with one side is compared with itself), band, node, n, component,
    sketch and shingles. A pair is looked at in the first band that it shares, and not
    at all if one component holds both, before or by links found here.
    """
    least = int((percent / 100 - MARGIN) * BINS)

    def decided(rows: dict[str, list]) -> pa.RecordBatch:
        sketch = np.array(rows["sketch"], dtype=np.int64).reshape(-1, BANDS)
        byte = sketch.view(np.uint8)
        side, n, group = np.array(rows["side"]), np.array(rows["n"]), np.array(rows["component"])
        band, left, right = rows["band"][0], [], []
        several = len(set(rows["side"])) > 1
        for i in range(len(side)):
            later = np.arange(i + 1, len(side))
            near = (group[later] != group[i]) & (100 * np.minimum(n[later], n[i]) >= percent * np.maximum(n[later], n[i]))
            if several:
                near &= side[later] != side[i]
            later = later[near]
            later = later[(sketch[later, :band] != sketch[i, :band]).all(axis=1)]
            later = later[(byte[later] == byte[i]).sum(axis=1) >= least]
            for j in later.tolist():
                if group[i] == group[j]:
                    continue
                shared = len(np.intersect1d(rows["shingles"][i], rows["shingles"][j], assume_unique=True))
                if 100 * shared >= percent * (n[i] + n[j] - shared):
                    left.append(rows["node"][i])
                    right.append(rows["node"][j])
                    group[group == group[j]] = group[i]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["left", "right"])

    plain = ["side", "band", "node", "n", "component", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, {c: [] for c in (*plain, "shingles")}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in plain}
            for i, unit in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "high")))):
                if unit != at:
                    if at is not None:
                        yield decided(rows)
                    at, rows = unit, {c: [] for c in (*plain, "shingles")}
                for c in plain:
                    rows[c].append(columns[c][i])
                rows["shingles"].append(batch.column("shingles")[i].values.to_numpy(zero_copy_only=False).copy())
        if at is not None:
            yield decided(rows)
        rows.clear()
        give_back()

    dealt = members.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "side", "node")
    return bounded_batches(dealt).mapInArrow(run, "left long, right long")


def near_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """Per document: key, n_shingles, component_id (the smallest key reachable over links, itself included), kept.

    Documents are linked if their sets of shingles share at least ``percent`` of their
    union. Equal sets are one node. Empty sets (null and wordless texts) are linked
    with nothing, not even with each other. A null key is passed over in the choice of
    the smallest, and a document without one is kept only if its component has none;
    repeated rows each get their row; no documents give no rows.
    """
    prints = materialize(with_sketch(documents.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", words), "prints")
    nodes = prints.where("n > 0").groupBy("digest").agg(F.min("key").alias("smallest"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    linked = links(documents, key, text, nodes, words, percent)
    grouped = nodes.join(linked, "node", "left").select("digest", "smallest", F.coalesce("component", "node").alias("component"))
    grouped = materialize(grouped, "groups")
    least = grouped.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = materialize(grouped.join(least, "component").select("digest", "component_id"), "named")
    full = prints.where("n > 0").select("key", "n", "digest").join(named, "digest").select("key", "n", "component_id")
    empty = prints.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return full.union(empty).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )


def links(documents: DataFrame, key: str, text: str, nodes: DataFrame, words: int, percent: int, groups: DataFrame | None = None) -> DataFrame:
    """(node, component) of all nodes (node, digest, smallest, n, sketch) that are linked with another one.

    Candidates share a band of their sketches, or one of the ``groups`` (node, bucket)
    that something else has put them in.
    """
    each = nodes.select("node", "n", F.posexplode("sketch").alias("band", "value"))
    each = each.select("node", "n", "band", F.xxhash64("band", "value").alias("bucket"))
    if groups is not None:  # behind all bands: pairs that share none
        each = each.union(nodes.join(groups, "node").select("node", "n", F.lit(BANDS).alias("band"), F.xxhash64(F.lit(BANDS), "bucket").alias("bucket")))
    several = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("lead")).where("size > 1")
    members = materialize(each.join(several.select("bucket", "lead"), "bucket"), "members")

    wanted = materialize(members.select("node").distinct().join(nodes.select("node", "digest", "smallest"), "node"), "wanted")
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(small, F.col("key").eqNullSafe(F.col("smallest")))
    sets = with_sets(texts, "text", words)
    if documents.groupBy(key).count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["node"])
    sets = materialize(sets, "sets")

    close = F.lit(100) * F.least("n", "lead.n") >= F.lit(percent) * F.greatest("n", "lead.n")
    stars = members.where((F.col("node") != F.col("lead.node")) & close).select(F.col("lead.node").alias("left"), F.col("node").alias("right")).distinct()
    side = lambda name, column: sets.select(F.col("node").alias(name), F.col("shingles").alias(column))
    first = stars.join(side("left", "x"), "left").join(side("right", "y"), "right").where(alike(F.col("x"), F.col("y"), percent))
    first = materialize(first.select("left", "right"), "links")

    linked = materialize(components(first, "left", "right"), "components")
    placed = members.join(linked, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component"), "n")
    mixed_ = placed.groupBy("bucket").agg(
        F.min("component").alias("one"), F.max("component").alias("other"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")
    )
    parts = F.greatest(F.ceil(F.col("size") / UNIT), F.ceil(F.col("total") / UNIT_SHINGLES)).cast("int").alias("parts")
    open_ = materialize(placed.join(mixed_.where("one < other").select("bucket", parts), "bucket"), "open")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = open_.withColumn("own", own).withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = dealt.select(
        "bucket", F.least("own", "peer").alias("low"), F.greatest("own", "peer").alias("high"), (F.col("own") > F.col("peer")).cast("int").alias("side"), "band", "node", "component"
    )
    more = materialize(unit_links(units.join(sets, "node"), percent), "links")
    if not more.limit(1).count():
        return linked
    return materialize(components(first.union(more), "left", "right"), "components")
