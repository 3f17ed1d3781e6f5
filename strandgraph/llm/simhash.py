"""SimHash fingerprints and their near neighbours by multi-index hashing.

A 64-bit fingerprint is cut into segments. Fingerprints that differ in few bits
differ in fewer bits still in some segment, so each looks up, segment by segment,
the values of a small Hamming ball in the table of that segment, and the whole
distance decides. Radii of 0 and 1 are dealt to the segments so that no pair
within the total radius is missed: the sum of (radius + 1) exceeds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.llm import minhash
from strandgraph.llm.common import BROADCAST_ROWS, bounded_batches, give_back
from strandgraph.llm.components import components
from strandgraph.session import materialize

BITS = 64
SEED = 42
#: Entries of one table bucket beyond which its members are linked by masks instead of pair by pair.
#: A mask costs each member 2,016 rows whatever the size of the bucket, so this is where pairs cost more.
CROWD = 2_000
#: Hashes unpacked to bits at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """Bits set in over half of the hashes of all word shingles of a text, as an unsigned number.

    ASCII letters are lowered, words are runs of anything but ASCII white space;
    fewer words make one shingle of them all, none make 0.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    n = max(1, len(found) - words + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, BLOCK):
        rows = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str, words: int, name: str = "print") -> DataFrame:
    """Replace the text column by its fingerprint as a signed long. Null texts are empty texts."""
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = (fingerprint(value.as_py(), words) for value in batch.column(text))
            signed = np.fromiter(prints, dtype=np.uint64, count=batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(signed)], names=[*kept, name])

    return bounded_batches(df).select(*kept, text).mapInArrow(run, schema)


def segments(radius: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius in the segment) of each segment for a total radius."""
    count = max(2, -(-(radius + 1) // 2))
    ones = radius + 1 - count  # so many segments need radius 1 for the sum of (radius + 1) to exceed the total
    edges = [BITS * k // count for k in range(count + 1)]
    return [(lo, hi - lo, int(k < ones)) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]


def _adder(tag):
    return lambda x: tag + x


def links(prints: DataFrame, radius: int, crowd: int = CROWD, whole: bool = False) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most ``radius`` bits apart; ``prints`` holds each once, as column ``print``.

    Of the two sides of a pair that differ in one bit of a segment, only the side
    with the 0 looks the other up, and a pair found in several segments counts in
    the first, so each pair comes once. Members of a bucket with over ``crowd``
    entries are linked by masks: two fingerprints are within the radius if they
    agree outside of some ``radius`` bits, so those that agree outside the same bits
    are linked to the smallest of them. That keeps every component and makes a
    number of rows in proportion to the members. With ``whole`` all pairs inside such
    a group are listed (it has at most 2 ** radius members), so that every pair comes
    whatever the size of the buckets. It is built for radius 2 and 3.
    """
    parts = segments(radius)
    value = lambda c, lo, width: F.shiftrightunsigned(c, lo).bitwiseAND((1 << width) - 1)
    fp = F.col("print")
    entries, probes = [], []
    for k, (lo, width, ball) in enumerate(parts):
        key = value(fp, lo, width)
        tag = F.lit(k).cast("long") * (1 << 40)
        entries.append(F.struct((tag + key).alias("key"), F.lit(k).alias("part")))
        around = F.array(key)
        if ball:
            flips = F.array(*[key.bitwiseOR(F.lit(1 << i).cast("long")) for i in range(width)])
            around = F.array_union(around, flips)
        probes.append(F.transform(around, _adder(tag)))
    table = prints.select("print", F.explode(F.array(*entries)).alias("e")).select("print", "e.key", "e.part")
    asked = prints.select("print", F.explode(F.concat(*probes)).alias("key"))

    crowded = materialize(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key"), "crowded")
    if crowded.limit(1).count():
        inside = table.join(crowded, "key").select("print").union(asked.join(crowded, "key").select("print")).distinct()
        masked = _by_masks(materialize(inside, "crowd"), radius, whole)
        table, asked = table.join(crowded, "key", "left_anti"), asked.join(crowded, "key", "left_anti")
    else:
        masked = None

    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = lambda k: F.bit_count(value(differ, parts[k][0], parts[k][1])) <= parts[k][2]
    first = F.lit(True)
    for k in range(1, len(parts)):
        for earlier in range(k):
            first = first & ~((F.col("part") == k) & within(earlier))
    own = F.lit(False)
    for k, (lo, width, _) in enumerate(parts):
        same = value(differ, lo, width) == 0
        own = own | ((F.col("part") == k) & (~same | (F.col("a") < F.col("b"))))
    pairs = asked.withColumnRenamed("print", "a").join(table.withColumnRenamed("print", "b"), "key")
    pairs = pairs.where(own & first & (F.bit_count(differ) <= radius)).select("a", "b")
    return pairs.union(masked).distinct() if masked is not None else pairs


def _by_masks(prints: DataFrame, radius: int, whole: bool = False) -> DataFrame:
    """Links that keep the components of all pairs within ``radius``, or with ``whole`` all these pairs; groups hold at most 2 ** radius fingerprints."""
    bits = [1 << i for i in range(BITS)]
    signed = [F.lit(b if b < 1 << 63 else b - (1 << 64)).cast("long") for b in bits]
    rows = prints.select("print", F.lit(0).cast("long").alias("mask"), F.lit(-1).alias("at"))
    for _ in range(radius):  # every set of radius bits, in ascending order
        step = rows.select("print", "mask", "at", F.posexplode(F.array(*signed)).alias("i", "bit")).where("i > at")
        rows = step.select("print", F.col("mask").bitwiseOR(F.col("bit")).alias("mask"), F.col("i").alias("at"))
    cleared = rows.select("print", "mask", F.col("print").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
    groups = cleared.groupBy("mask", "rest").agg(F.array_sort(F.collect_set("print")).alias("same")).where(F.size("same") > 1)
    if whole:
        ends = groups.select("same", F.posexplode("same").alias("at", "a"))
        return ends.select("a", F.explode(F.slice("same", F.col("at") + 2, 1 << radius)).alias("b")).distinct()
    return groups.select(F.col("same")[0].alias("a"), F.explode(F.slice("same", 2, 1 << radius)).alias("b")).distinct()


def near_components(documents: DataFrame, key: str, text: str, words: int = 3, radius: int = 2) -> DataFrame:
    """Per row: key, print (signed long) and component_id, the smallest key reachable over links of at most ``radius`` bits.

    Equal fingerprints are one node, so copies make no pairs. Null and wordless
    texts have fingerprint 0 and link like any other; null keys are passed over in
    the choice of the smallest; an empty table gives no rows; repeated rows each
    get their row.
    """
    prints = materialize(with_fingerprint(documents.select(key, text), text, words), "prints")
    nodes = materialize(prints.groupBy("print").agg(F.min(key).alias("smallest")), "nodes")
    linked = materialize(components(links(nodes.select("print"), radius)), "components")
    roots = nodes.join(linked, nodes["print"] == linked["node"], "left").select(
        "print", "smallest", F.coalesce("component", "print").alias("component")
    )
    least = roots.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = materialize(roots.join(least, "component").select("print", "component_id"), "named")
    return prints.join(named, "print")


def hexadecimal(print_column: str):
    """Sixteen lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(print_column), 16, "0"))


# --- near copies, decided by their shingles ----------------------------------


def with_print_and_sketch(df: DataFrame, text: str, words: int, shingle: int) -> DataFrame:
    """Replace the text column by ``print`` and by the ``n``, ``digest`` and ``sketch`` of its set of shingles."""
    kept = [c for c in df.columns if c != text]
    added = "print long, n long, digest binary, sketch array<long>"
    schema = T.StructType([*(df.schema[c] for c in kept), *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            prints = np.array([fingerprint(value, words) for value in texts], dtype=np.uint64).view(np.int64)
            sets = [minhash.shingle_set(value, shingle) for value in texts]
            columns = [pa.array(prints), *minhash.set_columns(sets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=schema.names)
        give_back()

    return bounded_batches(df).select(*kept, text).mapInArrow(run, schema)


def copies(documents: DataFrame, key: str, text: str, words: int = 2, radius: int = 3, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, digest) of the documents that are copies of another one that stays; digest is the SHA-256 of the text.

    Texts with equal sets of shingles are one node, texts without a word too. A link
    is a pair of nodes whose sets share at least ``percent`` of their union, and all
    that links connect is one group, of which the text with the smallest key stays.

    Candidates are nodes in one component of the fingerprints of ``words`` words that
    are at most ``radius`` bits apart, found by multi-index hashing, and nodes that share
    a band of their sketches. Both are buckets to ``minhash.links``, which decides
    every candidate by its full set without listing the pairs of a bucket.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows = documents.select(F.col(key).alias("key"), digest.alias("of_text"), F.col(text).alias("text"))
    ids = materialize(with_print_and_sketch(rows, "text", words, shingle), "prints")
    nodes = ids.groupBy("digest").agg(F.min("key").alias("smallest"), F.first("n").alias("n"), F.first("print").alias("print"), F.min("sketch").alias("sketch"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    near = materialize(components(links(nodes.where("n > 0").select("print").distinct(), radius)), "components")
    group = nodes.where("n > 0").join(near.withColumnRenamed("node", "print"), "print", "left").select("node", F.coalesce("component", "print").alias("bucket"))
    linked = minhash.links(documents, key, text, nodes.where("n > 0"), shingle, percent, group)
    placed = nodes.join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    placed = materialize(ids.select("key", "of_text", "digest").distinct().join(placed, "digest").select("key", "of_text", "component"), "groups")
    stays = placed.groupBy("component").agg(F.min(F.struct(F.col("key").isNull(), "key", "of_text")).alias("stays"))
    stays = stays.select(F.col("stays.key").alias("key"), F.col("stays.of_text").alias("of_text"), F.lit(True).alias("stays"))
    same = placed["key"].eqNullSafe(stays["key"]) & (placed["of_text"] == stays["of_text"])
    return placed.join(stays, same, "left_anti").select("key", F.col("of_text").alias("digest"))


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``documents`` without the copies of others: one document of each group stays, the one with the smallest key.

    All columns stay as they are. Rows that repeat key and text count once; null
    keys are larger than none, so a document with a key stays if there is one; null
    texts are empty texts, and all texts without a word are one group.
    """
    lost = materialize(copies(documents, key, text, **how), "lost")
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost
    digest = F.sha2(F.coalesce(documents[text], F.lit("")), 256)
    left = documents.join(lost, documents[key].eqNullSafe(lost["key"]) & (digest == lost["digest"]), "left_anti")
    if documents.groupBy(key).count().where("count > 1").limit(1).count():
        left = left.dropDuplicates([key, text])
    return left
