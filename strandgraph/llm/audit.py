"""How filters of a corpus interact, from a sparse document-term matrix.

Words are encoded by one dictionary for the whole corpus, in two steps. A pass over
the texts cuts them into shards of bounded bytes; each shard is a block of the matrix
in CSR form whose columns are numbered by the shard's own list of distinct words.
Only these lists are brought together, in buckets by a digest of the word, and numbered
for the whole corpus, so a word moves once per shard and not per occurrence, packed with
the others of its bucket; then the shard's column numbers are replaced by the global ones. Row sums of the matrix are words, numbers of nonzero
entries are distinct words.

A document's failed filters make a mask; what any order of the filters does to it
follows from the mask alone, so counts per part and mask are all that is needed.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from strandgraph.llm.common import batch_rows, bounded_batches, give_back
from strandgraph.session import materialize

#: Bytes of text after which a shard is closed (a longer text makes a shard of its own), and what a row adds to them.
SHARD_BYTES, ROW_BYTES = 4 << 20, 100
#: Lists of words that an Arrow batch holds.
HELD = 8
#: Least number of buckets of the dictionary, and words of shards' lists that a bucket is made for.
BUCKETS, BUCKET_WORDS = 256, 1 << 20
#: Packed columns: a list of words or a bucket's part of it, the part's numbers, and a shard's entries, each code as its gap to the one before.
WORDS = pa.schema([("word", pa.string())])
PLACES = pa.schema([("place", pa.int32())])
ENTRIES = pa.schema([("gap", pa.int32()), ("count", pa.int32())])
PACKING = pa.ipc.IpcWriteOptions(compression="zstd")


def pack(schema: pa.Schema, *columns: pa.Array) -> bytes:
    """Columns of equal length as one compressed Arrow message, which moves and is stored as a single value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=PACKING) as out:
        out.write_batch(pa.RecordBatch.from_arrays(list(columns), schema=schema))
    return sink.getvalue().to_pybytes()


def unpack(packed: bytes) -> list[pa.Array]:
    return pa.ipc.open_stream(packed).read_next_batch().columns


def digests(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), np.int64, len(words))


def shards(documents: DataFrame, text: str, keep: Sequence[str], flags: dict[str, Callable[[bytes], bool]]) -> DataFrame:
    """CSR blocks with numbers of their own: shard, rows (kept columns and flags), n_words, words, indptr, entries.

    Words are runs of anything but ASCII white space; null texts count as empty. The
    flags are what has to be read off the UTF-8 text itself. ``words`` packs the
    shard's list in the order of the words' digests, ``entries`` the codes, which are
    places in that list, and the counts. Store the result before use: its shards are
    numbered by task.
    """
    row = T.StructType([documents.schema[c] for c in keep] + [T.StructField(name, T.BooleanType()) for name in flags])
    fields = {"shard": T.LongType(), "rows": T.ArrayType(row), "n_words": T.LongType(), "words": T.BinaryType(), "indptr": T.ArrayType(T.IntegerType()), "entries": T.BinaryType()}
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])

    def block(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        (batch,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        texts = pc.fill_null(batch.column(text), "")
        parts = pc.ascii_split_whitespace(texts)
        occurring, of_row = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        filled = pc.binary_length(occurring).to_numpy(zero_copy_only=False) > 0  # white space at an end of a text leaves an empty word
        if not filled.all():
            occurring, of_row = occurring.filter(pa.array(filled)), of_row[filled]
        encoded = occurring.dictionary_encode()
        order = np.argsort(digests(encoded.dictionary), kind="stable")
        code = np.empty(len(order), np.int64)
        code[order] = np.arange(len(order))
        places = of_row << 32 | code[encoded.indices.to_numpy(zero_copy_only=False)]
        places.sort()
        first = np.flatnonzero(np.diff(places, prepend=-1))
        codes, counts = places[first] & 0xFFFFFFFF, np.diff(first, append=len(places))
        indptr = np.searchsorted(places[first] >> 32, np.arange(len(texts) + 1))
        values = texts.cast(pa.binary()).to_pylist()
        told = [pa.array([flag(value) for value in values], pa.bool_()) for flag in flags.values()]
        rows = pa.StructArray.from_arrays([*(batch.column(c) for c in keep), *told], names=row.names)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        words = encoded.dictionary.take(pa.array(order)).cast(pa.string())
        entries = pack(ENTRIES, *(pa.array(x.astype(np.int32)) for x in (np.diff(codes, prepend=0), counts)))
        columns = [pa.array([shard], pa.int64()), one(rows), pa.array([len(words)], pa.int64()), pa.array([pack(WORDS, words)], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, one(pa.array(indptr.astype(np.int32))), pa.array([entries], pa.binary())], names=list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            sizes = ROW_BYTES + pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = 0
            while start < batch.num_rows:
                upto = size + np.cumsum(sizes[start:])
                n = min(int(np.searchsorted(upto, SHARD_BYTES)) + 1, len(upto))
                held.append(batch.slice(start, n))
                start, size = start + n, int(upto[n - 1])
                if size >= SHARD_BYTES:
                    yield block(shard, held)
                    held, size, shard = [], 0, shard + 1
        if held:
            yield block(shard, held)
        give_back()

    return bounded_batches(documents.select(*keep, text)).mapInArrow(run, schema)


def number_words(stored: DataFrame) -> DataFrame:
    """(shard, start, offset, places): the words of a shard's list in the dictionary of the corpus, from 0 without gaps.

    A bucket is a range of digests, so it holds a run of every shard's list, from code
    ``start`` on, and a shard and a bucket have one row, whatever the number of words.
    Equal words meet in their bucket, at most one per shard each, and are numbered
    there; there are as many buckets as keep one to about ``BUCKET_WORDS`` words.
    ``places`` packs the run's numbers in the bucket, ``offset`` is what the earlier
    buckets hold.
    """
    spark = stored.sparkSession
    total = stored.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(BUCKETS, -(-total // BUCKET_WORDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("words").to_pylist()):
                (words,) = unpack(packed)
                bucket = digests(words) * buckets >> 32
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                runs = [pack(WORDS, words.slice(at, n)) for at, n in zip(starts, np.diff(starts, append=len(bucket)))]
                columns = [pa.array(bucket[starts]), pa.array(np.full(len(starts), shard, np.int64)), pa.array(starts.astype(np.int32)), pa.array(runs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "shard", "start", "words"])

    def number(group: pa.Table) -> pa.Table:
        runs = [unpack(packed)[0] for packed in group.column("words").to_pylist()]
        encoded = pa.concat_arrays(runs).dictionary_encode()
        starts = np.cumsum([0] + [len(words) for words in runs])
        places = [pack(PLACES, encoded.indices.slice(at, len(words))) for at, words in zip(starts, runs)]
        size = pa.array(np.full(len(runs), len(encoded.dictionary), np.int64))
        columns = [group.column("bucket"), size, group.column("shard"), group.column("start"), pa.array(places, pa.binary())]
        return pa.table(columns, names=["bucket", "size", "shard", "start", "places"])

    dealt = stored.select("shard", "words").mapInArrow(deal, "bucket long, shard long, start int, words binary")
    with batch_rows(spark, HELD):
        numbered = materialize(dealt.groupBy("bucket").applyInArrow(number, "bucket long, size long, shard long, start int, places binary"), "words")
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    sizes = numbered.groupBy("bucket").agg(F.max("size").alias("size"))
    offsets = sizes.select("bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    return numbered.join(F.broadcast(offsets), "bucket").select("shard", "start", "offset", "places")


def encode(stored: DataFrame, numbers: DataFrame) -> DataFrame:
    """CSR blocks with global numbers: shard, rows, indptr, terms, counts.

    A shard's list of words is bounded by its bytes, so its numbers are gathered in one
    place. The terms of a row are distinct and stand in the order of the shard's codes.
    """
    lists = numbers.groupBy("shard").agg(F.collect_list(F.struct("start", "offset", "places")).alias("lists"))
    joined = stored.drop("words").join(lists, "shard", "left")
    schema = T.StructType([*(joined.schema[c] for c in ("shard", "rows", "indptr")), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                gaps, counts = unpack(one.column("entries")[0].as_py())
                table = np.empty(one.column("n_words")[0].as_py(), np.int64)
                for found in one.column("lists")[0].as_py() or ():
                    (places,) = unpack(found["places"])
                    table[found["start"] : found["start"] + len(places)] = found["offset"] + places.to_numpy().astype(np.int64)
                list_of = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                columns = [*(one.column(c) for c in ("shard", "rows", "indptr")), list_of(pa.array(table[np.cumsum(gaps.to_numpy())])), list_of(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return bounded_batches(joined).mapInArrow(run, schema)


def row_totals(matrix: DataFrame, words: str = "words", distinct: str = "distinct_words") -> DataFrame:
    """The kept columns of every row with its sum and its number of nonzero entries."""
    row = matrix.schema["rows"].dataType.elementType
    schema = T.StructType([*row.fields, T.StructField(words, T.LongType()), T.StructField(distinct, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                indptr = batch.column("indptr")[i].values.to_numpy(zero_copy_only=False)
                counts = batch.column("counts")[i].values.to_numpy(zero_copy_only=False)
                upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                rows = batch.column("rows")[i].values
                sums, filled = upto[indptr[1:]] - upto[indptr[:-1]], np.diff(indptr).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in row.names), pa.array(sums, pa.int64()), pa.array(filled)], names=schema.names)

    return bounded_batches(matrix.select("rows", "indptr", "counts")).mapInArrow(run, schema)


# --- orders of filters -------------------------------------------------------


def effects(names: str) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """(filter_order, step, mask, kept, removed, redundant, unique) for all orders of the filters, steps and masks.

    Bit k of a mask says that filter k of ``names`` fails. The table depends on the
    number of filters alone: 19,200 rows for five.
    """
    out = []
    for order in itertools.permutations(range(len(names))):
        label, earlier = "".join(names[k] for k in order), 0
        for step, k in enumerate(order, 1):
            own = 1 << k
            for mask in range(1 << len(names)):
                fails, gone = bool(mask & own), bool(mask & earlier)
                out.append((label, step, mask, not mask & (earlier | own), fails and not gone, fails and gone, mask == own))
            earlier |= own
    return out


def interactions(flagged: DataFrame, part: Column, flags: dict[str, Column], good: Column, toxic: Column) -> DataFrame:
    """Per part, order of the filters and step: what that step keeps, removes and would have removed.

    ``flags`` maps one-letter names to failure conditions, which count as not failed
    where they are null; so do ``good`` and ``toxic``. Columns: part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Of
    all orders a filter comes first among the f that a document fails in one of f,
    which is what ``shapley`` adds up. A part has all its rows, zeros included; no
    documents give no parts.
    """
    names = "".join(flags)
    yes = lambda c: F.coalesce(c, F.lit(False))
    mask = sum((F.when(yes(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(flags.values())), F.lit(0))
    counted = flagged.groupBy(part.alias("part"), mask.cast("int").alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yes(good)).alias("good"), F.count_if(yes(toxic)).alias("toxic")
    )
    schema = "filter_order string, step int, mask int, is_kept boolean, is_removed boolean, is_redundant boolean, is_unique boolean"
    table = F.broadcast(flagged.sparkSession.createDataFrame(effects(names), schema))  # a fixed number of rows
    orders = len(set(itertools.permutations(names)))
    share = F.when(F.expr("is_removed OR is_redundant"), F.lit(orders) / F.bit_count("mask")).otherwise(F.lit(0))
    total = lambda c, of: F.sum(F.when(F.col(c), F.col(of)).otherwise(F.lit(0))).alias
    return (
        counted.join(table, "mask")
        .withColumn("_share", share.cast("long"))
        .groupBy("part", "filter_order", "step")
        .agg(
            total("is_kept", "n")("kept"), total("is_removed", "n")("removed"), total("is_redundant", "n")("redundant"), total("is_unique", "n")("unique_fails"),
            total("is_removed", "good")("good_lost"), total("is_removed", "toxic")("toxic_lost"), F.sum(F.col("n") * F.col("_share")).alias("shapley"),
        )
    )


def first_copies(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """(digest, key) of the row with the smallest key among those of equal digest; combined before the shuffle."""
    return rows.groupBy(digest).agg(F.min(key).alias(key))


_CAPITALS, _SYMBOLS, _FOLLOWING = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", bytes(range(0x80, 0xC0))


def many_capitals(text: bytes) -> bool:
    """Whether over 2 % of the code points of a UTF-8 text are capitals A to Z."""
    points = len(text.translate(None, _FOLLOWING))
    return 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 2 * points


def has_symbol(text: bytes) -> bool:
    """Whether one of ``#$%&*|`` occurs."""
    return len(text.translate(None, _SYMBOLS)) < len(text)


def audit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The interactions of five filters over ``documents``, per source; null sources count as the empty one.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 2 % of
    the characters are capitals A to Z. D: one of ``#$%&*|`` occurs. E: the text
    equals that of a smaller key. Null texts are empty texts and copies of each other;
    a null key is neither smaller nor larger than any. Documents without a label are
    neither good nor toxic; of several labels of a key any 1 counts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), F.col(text).alias("text"))
    stored = materialize(shards(rows, "text", ["key", "part", "digest"], {"c": many_capitals, "d": has_symbol}), "shards")
    matrix = encode(stored, number_words(stored))
    with batch_rows(documents.sparkSession, 1):  # a row is a shard
        facts = materialize(row_totals(matrix), "facts")
    first = first_copies(facts.where("key IS NOT NULL"), "digest", "key").withColumn("is_first", F.lit(True))
    marks = labels.groupBy(F.col(key).alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flagged = facts.join(first, ["digest", "key"], "left").join(marks, "key", "left")
    flags = {
        "A": F.col("words") < 200,
        "B": F.lit(100) * F.col("distinct_words") < F.lit(50) * F.col("words"),
        "C": F.col("c"),
        "D": F.col("d"),
        "E": F.col("key").isNotNull() & F.col("is_first").isNull(),
    }
    return interactions(flagged, F.col("part"), flags, F.col("good"), F.col("toxic"))
