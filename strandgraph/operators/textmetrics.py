"""Text metrics over pairs(id, hyp, ref) of whole texts.

The metrics move each text once, hash-partitioned by its id. BLEU and METEOR look at a
pair in its row, so only totals leave the partitions. CIDEr keeps the n-grams in chunks of
texts and moves their keys once, packed, to count its document frequencies over the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.functions import text as t
from strandgraph.functions.stemming import stem
from strandgraph.functions.text import entities_loose
from strandgraph.operators.ordinal import one_per_key
from strandgraph.session import materialize

# --- fixed values ------------------------------------------------------------

CLINICAL_ENTITIES = [
    "atelectasis", "consolidation", "edema", "enlarged cardiomediastinum",
    "lung lesion", "lung opacity", "pleural effusion", "pleural other",
    "pneumonia", "pneumothorax",
    "opacity", "effusion", "infiltrate", "haziness", "fluid", "congestion",
    "cardiomegaly", "blunting", "thickening", "nodule", "mass", "interstitial",
    "airspace", "vascular", "markings", "lucency", "density", "infiltration",
]
# Treebank word rules, applied in order to the lowered text: (pattern, replacement).
WORD_RULES = [
    (r'"', r" '' "),
    (r"([.]{2,})", r" \1 "),
    (r"([^.])[.]([\])}>' ]*)(\s|$)", r"\1 . \2 \3"),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"([;@#$%&?!\[\](){}<>])", r" \1 "),
    (r"(--)", r" \1 "),
    (r"([^' ])('s|'m|'d|')(\s|$)", r"\1 \2 \3"),
    (r"([^' ])('ll|'re|'ve|n't)(\s|$)", r"\1 \2 \3"),
]
# What a text must hold for each of the rules to change it; None where nothing short says so.
RULE_MARKS = ['"', "..", ".", None, None, None, "--", "'", "'"]
CIDER_SIGMA = 6.0
MAX_N = 4
CHUNK_WORDS = 1 << 20  # words of a chunk of texts, both sides, for CIDEr


def align(refs: DataFrame, answers: DataFrame, order: str | None = None) -> DataFrame:
    """refs(ord, ref), answers(question_id, text) -> ord, hyp, ref; a missing answer is empty.

    The last answer of a question under the column ``order`` counts; without it a repeated question is an error.
    """
    found = one_per_key(answers, ["question_id"], order).select(F.col("question_id").alias("ord"), F.col("text").alias("_hyp"))
    return refs.join(found, "ord", "left").select("ord", F.coalesce("_hyp", F.lit("")).alias("hyp"), "ref")


def word_tokens(c: Column | str) -> Column:
    """Lowered words and punctuation marks."""
    s = F.lower(F.col(c) if isinstance(c, str) else c)

    for (pattern, replacement), mark in zip(WORD_RULES, RULE_MARKS):
        s = _by_rule(s, pattern, replacement.replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3"), mark)
    return t.words(s)


def _by_rule(s: Column, pattern: str, replacement: str, mark: str | None) -> Column:
    if mark is None:
        return F.regexp_replace(s, pattern, replacement)
    # The text gets a name, so that it is worked out once for its three uses.
    return F.element_at(F.transform(F.array(s), lambda x: F.when(x.contains(mark), F.regexp_replace(x, pattern, replacement)).otherwise(x)), 1)


def _tokenized(pairs: DataFrame, tokens) -> DataFrame:
    """id, h, r token arrays, partitioned by id.

    The partition count is given, because adaptive execution would merge partitions
    by the size of the texts and not by the work of the n-grams made from them.
    """
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("id", "hyp", "ref").repartition(width, "id").select("id", tokens("hyp").alias("h"), tokens("ref").alias("r"))


def _bleu_score(n_used: int) -> Column:
    """Geometric mean of the first precisions with a 0.1 numerator for none, and the brevity penalty."""
    logs = F.lit(0.0)
    for n in range(1, n_used + 1):
        hit = F.when(F.col(f"_m{n}") == 0, F.lit(0.1)).otherwise(F.col(f"_m{n}"))
        logs = logs + F.log(hit / F.greatest(F.col(f"_d{n}"), F.lit(1))) / n_used
    short = F.exp(1 - F.col("_rl") / F.greatest(F.col("_hl"), F.lit(1)))
    penalty = F.when(F.col("_hl") > F.col("_rl"), F.lit(1.0)).when(F.col("_hl") == 0, F.lit(0.0)).otherwise(short)
    return F.when(F.col("_m1") == 0, F.lit(0.0)).otherwise(penalty * F.exp(logs))


#: Words whose n-grams are counted at once for BLEU; a longer text is taken alone.
BLEU_WORDS = 1 << 18


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch (h, rs) in slices of about ``BLEU_WORDS`` words."""
    sizes = pc.list_value_length(batch.column("h")).to_numpy(zero_copy_only=False).astype(np.int64)
    others = batch.column("rs")
    lengths = pc.list_value_length(others.flatten()).to_numpy(zero_copy_only=False)
    sizes = sizes + np.bincount(pc.list_parent_indices(others).to_numpy(), weights=lengths, minlength=len(sizes)).astype(np.int64)
    part = np.cumsum(sizes) // BLEU_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def _bleu_counts(rows: pa.RecordBatch, max_n: int) -> dict[str, int]:
    """The sums of some rows; an n-gram is numbered by the number of its beginning and its last word, for all their texts at once."""
    hyps, refs = rows.column("h"), rows.column("rs")
    texts, parent = refs.flatten(), pc.list_parent_indices(refs).to_numpy().astype(np.int64)
    hl, rl = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (hyps, texts))
    words = pa.concat_arrays([hyps.flatten(), texts.flatten()]).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(hl) + len(rl)), np.concatenate([hl, rl]))
    order = np.lexsort((rl, np.abs(rl - hl[parent]), parent))
    sums = {"_hl": int(hl.sum()), "_rl": int(rl[order][np.unique(parent[order], return_index=True)[1]].sum())}
    number, many = words, int(words.max(initial=0)) + 1
    for n in range(1, max_n + 1):
        if n > 1:
            number = np.unique(number[:-1] * many + words[n - 1 :], return_inverse=True)[1]
        here = text[: len(number)] == text[n - 1 :]
        width = int(number.max(initial=0)) + 1
        found, times = np.unique(text[: len(number)][here] * width + number[here], return_counts=True)
        mine = found < len(hl) * width
        other, gram = np.divmod(found[~mine], width)
        theirs, place = np.unique(parent[other - len(hl)] * width + gram, return_inverse=True)
        most = np.zeros(len(theirs), np.int64)
        np.maximum.at(most, place, times[~mine])
        _, i, j = np.intersect1d(found[mine], theirs, assume_unique=True, return_indices=True)
        sums[f"_m{n}"] = int(np.minimum(times[mine][i], most[j]).sum())
        sums[f"_d{n}"] = int(np.maximum(hl - (n - 1), 1).sum())
    return sums


def _bleu_sums(found: DataFrame, max_n: int) -> DataFrame:
    """found(h, rs: token arrays of all references) -> one row of matched n-grams, lengths and n-gram numbers.

    A text and its references are counted where they lie; only sums leave a batch.
    """
    names = [*[f"_m{n}" for n in range(1, max_n + 1)], "_hl", "_rl", *[f"_d{n}" for n in range(1, max_n + 1)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = dict.fromkeys(names, 0)
            for rows in _sliced(batch):
                for c, x in _bleu_counts(rows, max_n).items():
                    sums[c] += x
            yield pa.RecordBatch.from_pydict({c: pa.array([x], pa.int64()) for c, x in sums.items()})

    parts = found.select("h", "rs").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def tokens(pairs: DataFrame) -> DataFrame:
    """id, h, r: the word tokens of both sides, as ``corpus_bleu`` and ``meteor_rows`` use them; a null text is an empty one."""
    return _tokenized(pairs, lambda c: word_tokens(F.coalesce(F.col(c), F.lit(""))))


def corpus_bleu(pairs: DataFrame, tokenized: DataFrame | None = None) -> DataFrame:
    """One row: bleu_1, bleu_2, bleu_4 over the whole corpus, one reference per hypothesis; a null text is an empty one.

    ``tokenized`` are the ``tokens`` of the pairs, where they are at hand.
    """
    tokenized = tokens(pairs) if tokenized is None else tokenized
    sums = _bleu_sums(tokenized.select("h", F.array("r").alias("rs")), MAX_N)
    return sums.select(*[_bleu_score(n).alias(f"bleu_{n}") for n in (1, 2, 4)])


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All items of a column of lists of longs, and the row of each."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(lists)), sizes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _ngram_keys(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of all n-grams up to MAX_N; the lowest bits of a key are n - 1."""
    keys, rows, key = [], [], words
    for n in range(1, MAX_N + 1):
        if n > 1:
            key = _mixed(key[:-1]) + words[n - 1 :]
        here = row[: len(key)] == row[n - 1 :]
        # Other products than those the longer n-grams are made with.
        keys.append((_mixed(key[here] + np.uint64(n)) & ~np.uint64(3)) | np.uint64(n - 1))
        rows.append(row[: len(key)][here])
    return np.concatenate(keys), np.concatenate(rows)


class _Grams:
    """The n-grams of a chunk: all keys in order, and (row, place of the key, occurrences) of each side."""

    def __init__(self, chunk: pa.Table) -> None:
        sides = [_ngram_keys(*_flat(chunk.column(c))) for c in ("h", "r")]
        self.keys, place = np.unique(np.concatenate([keys for keys, _ in sides]), return_inverse=True)
        cut = len(sides[0][0])
        # Row and place in one number: equal n-grams of a row are equal numbers.
        width = max(len(self.keys), 1)
        found = [np.unique(rows * width + places, return_counts=True) for (_, rows), places in zip(sides, (place[:cut], place[cut:]))]
        (self.h, self.h_times), (self.r, self.r_times) = found
        self.width = width

    def references(self) -> np.ndarray:
        """How many references of the chunk hold each key."""
        return np.bincount(self.r % self.width, minlength=len(self.keys))

    def cuts(self, bits: int) -> np.ndarray:
        """Where the keys of each value of the top ``bits`` begin, and the end of the last."""
        tops = (self.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.keys), np.int64)
        return np.searchsorted(tops, np.arange((1 << bits) + 1))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together; they compress well where the numbers are sorted or small."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(x: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _frequencies(hashed: DataFrame, bits: int) -> DataFrame:
    """hashed(chunk, id, h, r) -> chunk, range, several, df: the n-grams of a chunk that several references of the table hold.

    A chunk sends every n-gram once, whatever the number of its texts that have it, packed by
    the top bits of the key. A task counts one such range and answers the chunks that asked
    with a bit for every n-gram, in the order asked, and the frequencies above one.
    """

    def sent(chunk: pa.Table) -> pa.Table:
        grams = _Grams(chunk)
        seen = grams.references()
        cuts = grams.cuts(bits)
        filled = np.flatnonzero(np.diff(cuts))
        spans = [slice(cuts[i], cuts[i + 1]) for i in filled]
        return pa.table(
            {
                "range": pa.array(filled, pa.int64()),
                "chunk": pa.array([chunk.column("chunk")[0].as_py()] * len(spans), pa.int64()),
                "keys": pa.array([_planes(grams.keys[i]) for i in spans], pa.binary()),
                "seen": pa.array([_planes(seen[i]) for i in spans], pa.binary()),
            }
        )

    def counted(asked: pa.Table) -> pa.Table:
        parts = [_unplaned(x.as_py(), np.uint64) for x in asked.column("keys")]
        seen = np.concatenate([_unplaned(x.as_py(), np.int64) for x in asked.column("seen")])
        keys, place = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(place, weights=seen, minlength=len(keys)).astype(np.int64)[place]
        out, start = [], 0
        for chunk, part in zip(asked.column("chunk").to_pylist(), parts):
            mine = df[start : start + len(part)]
            start += len(part)
            several = mine > 1
            if several.any():
                out.append((chunk, np.packbits(several).tobytes(), _planes(mine[several])))
        chunks, bitmaps, dfs = zip(*out) if out else ((), (), ())
        ranges = [asked.column("range")[0].as_py()] * len(out)
        columns = [pa.array(chunks, pa.int64()), pa.array(ranges, pa.int64()), pa.array(bitmaps, pa.binary()), pa.array(dfs, pa.binary())]
        return pa.Table.from_arrays(columns, names=["chunk", "range", "several", "df"])

    asked = hashed.groupBy("chunk").applyInArrow(sent, "range long, chunk long, keys binary, seen binary")
    return asked.groupBy("range").applyInArrow(counted, "chunk long, range long, several binary, df binary")


def cider_rows(pairs: DataFrame) -> DataFrame:
    """id, cider (x10 scale) with document frequencies over the references; a null text is an empty one.

    Texts become lists of word hashes, stored once and dealt to chunks of bounded length.
    N-grams are keys of 62 bits made from them and stay in their chunk: what moves is every
    key of a chunk once, to be counted, and back the frequencies above one. N-grams of one
    reference or none weigh the same, so no frequency is no loss. Two n-grams of
    the same key would be counted as one: among 10^9 different ones a tenth is the chance
    that this happens to any two.
    """
    words = lambda c: F.transform(t.words(F.coalesce(F.col(c), F.lit(""))), lambda w: F.xxhash64(w))
    hashed = materialize(pairs.select("id", words("hyp").alias("h"), words("ref").alias("r")), "words")
    sizes = hashed.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("h") + F.size("r")), F.lit(0)).alias("words")).first()
    chunks = sizes["words"] // CHUNK_WORDS + 1
    hashed = hashed.select(F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), "id", "h", "r")
    bits = (chunks - 1).bit_length()
    back = _frequencies(hashed, bits)
    log_docs = float(np.log(max(sizes["docs"], 1)))
    schema = T.StructType([hashed.schema["id"], T.StructField("cider", T.DoubleType())])

    def scored(chunk: pa.Table, known: pa.Table) -> pa.Table:
        grams, docs = _Grams(chunk), chunk.num_rows
        idf = np.full(grams.width, log_docs)
        cuts = grams.cuts(bits)
        for at, several, df in zip(known.column("range").to_pylist(), known.column("several"), known.column("df")):
            asked = np.unpackbits(np.frombuffer(several.as_py(), np.uint8), count=cuts[at + 1] - cuts[at])
            idf[cuts[at] + np.flatnonzero(asked)] -= np.log(_unplaned(df.as_py(), np.int64))
        number = np.zeros(grams.width, np.int64)
        number[: len(grams.keys)] = (grams.keys & np.uint64(3)).astype(np.int64)

        def weighed(found: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The weight of every n-gram, and the (row, n) that it belongs to."""
            row, place = np.divmod(found, grams.width)
            return times * idf[place], row * MAX_N + number[place]

        (vh, at_h), (vr, at_r) = weighed(grams.h, grams.h_times), weighed(grams.r, grams.r_times)
        both, i, j = np.intersect1d(grams.h, grams.r, assume_unique=True, return_indices=True)
        total = lambda at, x: np.bincount(at, weights=x, minlength=docs * MAX_N).astype(np.float64)
        dot = total(at_h[i], np.minimum(vh[i], vr[j]) * vr[j])
        norm = np.sqrt(total(at_h, vh * vh)) * np.sqrt(total(at_r, vr * vr))
        cosine = np.divide(dot, norm, out=dot.copy(), where=norm > 0).reshape(docs, MAX_N).sum(axis=1)
        # The length difference is taken on bigrams, for every n.
        bigrams = [np.maximum(pc.list_value_length(chunk.column(c).combine_chunks()).to_numpy(zero_copy_only=False) - 1, 0) for c in ("h", "r")]
        away = (bigrams[0] - bigrams[1]).astype(np.float64)
        score = 10.0 / MAX_N * cosine * np.exp(-(away * away) / (2 * CIDER_SIGMA**2))
        return pa.table({"id": chunk.column("id"), "cider": pa.array(score, pa.float64())})

    return hashed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(scored, schema)


def cider(pairs: DataFrame) -> DataFrame:
    return cider_rows(pairs).agg(F.coalesce(F.avg("cider"), F.lit(0.0)).alias("cider"))


def multi_bleu(candidates: DataFrame, references: DataFrame, n_used: int = MAX_N) -> DataFrame:
    """candidates(id, hyp), references(id, ref), several per id -> one row: bleu, over the whole table.

    An n-gram of a hypothesis counts as often as it does in the one reference that has
    it most. The length compared with is that of the reference closest to the
    hypothesis, the shorter one of two equally close. Hypotheses without a reference and
    references without a hypothesis are left out; a null text is an empty one. Without
    any matching n-gram of some length the score is that of ``_bleu_score``.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    hyps = candidates.select("id", text("hyp").alias("hyp"))
    # Equal references of an id count once; an id's references are one record.
    refs = references.groupBy("id").agg(F.collect_set(text("ref")).alias("refs"))
    found = hyps.join(refs, "id").select(word_tokens("hyp").alias("h"), F.transform("refs", word_tokens).alias("rs"))
    return _bleu_sums(found, n_used).select(_bleu_score(n_used).alias("bleu"))


def _paired(h: Sequence[str], r: Sequence[str], mine: Sequence[int], others: Sequence[int]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs of places (both ascending) of equal words, the last with the last; free places of both sides."""
    places: dict[str, list[int]] = {}
    for i in others:
        places.setdefault(r[i], []).append(i)
    found, free = [], []
    for i in reversed(mine):
        rest = places.get(h[i])
        if rest:
            found.append((i, rest.pop()))
        else:
            free.append(i)
    return found, free[::-1], sorted(i for rest in places.values() for i in rest)


def meteor_places(h: Sequence, r: Sequence, stems: bool, known: dict, stem_of: Callable = stem) -> list[tuple[int, int]]:
    """Places of matched words, equal words first, then words of equal stems.

    In each stage the last free occurrence of a word on one side meets the last free
    one on the other, then the one before it, and so on. ``known`` keeps stems. Words may
    be given as numbers, if ``stem_of`` tells their stems.
    """
    found, mine, others = _paired(h, r, range(len(h)), range(len(r)))
    if stems and mine and others:
        for side, places in ((h, mine), (r, others)):
            for i in places:
                if side[i] not in known:
                    known[side[i]] = stem_of(side[i])
        h, r = ({i: known[side[i]] for i in places} for side, places in ((h, mine), (r, others)))
        found += _paired(h, r, mine, others)[0]
    return sorted(found)


#: Stems that a task keeps.
KEPT_STEMS = 200_000


def meteor_matches(tokenized: DataFrame, stems: bool = True) -> DataFrame:
    """tokenized(id, h, r) -> id, _h, _r: places (from 1) of matched words, see ``meteor_places``."""
    schema = T.StructType([tokenized.schema["id"], T.StructField("_h", T.IntegerType()), T.StructField("_r", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (mine, other) in enumerate(zip(batch.column("h"), batch.column("r"))):
                found = meteor_places(mine.as_py(), other.as_py(), stems, {})
                ids = batch.column("id").take(pa.array([at] * len(found), pa.int64()))
                places = [pa.array([pair[side] + 1 for pair in found], pa.int32()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([ids, *places], names=["id", "_h", "_r"])

    return tokenized.select("id", "h", "r").mapInArrow(run, schema)


def meteor_rows(pairs: DataFrame, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, stems: bool = True, tokenized: DataFrame | None = None) -> DataFrame:
    """id, meteor with the stages for equal words and (``stems``) for equal stems, both paired from the ends of the texts.

    A text without words scores 0; a null text is an empty one. A pair is matched in its
    row, so words are not moved. ``tokenized`` as in ``corpus_bleu``.
    """
    tokenized = tokens(pairs) if tokenized is None else tokenized
    schema = T.StructType([tokenized.schema["id"], *[T.StructField(c, T.LongType()) for c in ("_m", "_c", "_hl", "_rl")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, str] = {}

        def stem_of(number: int) -> str:
            word = told[number].as_py()
            if word not in kept:
                kept[word] = stem(word)
            return kept[word]

        for batch in batches:
            rows, known = [], {}
            sides = [batch.column(c) for c in ("h", "r")]
            ends = [np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False)).tolist() for x in sides]
            # The words of a batch by their numbers, which are cheaper to take out and to compare.
            words = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode()
            told, numbers = words.dictionary, words.indices.to_numpy()
            first = [0, ends[0][-1] if ends[0] else 0]
            for at in range(batch.num_rows):
                h, r = (numbers[a + (e[at - 1] if at else 0) : a + e[at]].tolist() for a, e in zip(first, ends))
                found = meteor_places(h, r, stems, known, stem_of)
                chunks = sum(i == 0 or (x - found[i - 1][0], y - found[i - 1][1]) != (1, 1) for i, (x, y) in enumerate(found))
                rows.append((len(found), chunks, len(h), len(r)))
            if len(kept) > KEPT_STEMS:
                kept.clear()
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "_m", "_c", "_hl", "_rl"])

    matched = tokenized.mapInArrow(run, schema)
    p, r = F.col("_m") / F.col("_hl"), F.col("_m") / F.col("_rl")
    mean = p * r / (alpha * p + (1 - alpha) * r)
    penalty = gamma * F.pow(F.col("_c") / F.col("_m"), F.lit(beta))
    return matched.select("id", F.when(F.col("_m") > 0, mean * (1 - penalty)).otherwise(F.lit(0.0)).alias("meteor"))


def meteor(pairs: DataFrame, tokenized: DataFrame | None = None) -> DataFrame:
    return meteor_rows(pairs, tokenized=tokenized).agg(F.coalesce(F.avg("meteor"), F.lit(0.0)).alias("meteor"))


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence by bit-parallel dynamic programming over one big integer."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, token in enumerate(a):
        masks[token] = masks.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        common = row & masks.get(token, 0)
        row = ((row + common) | (row - common)) & full
    return len(a) - row.bit_count()


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stemmed(c: Column | str) -> Column:
    """The stems of a column of lowered words, a batch at a time."""
    return F.pandas_udf(_stems, "string")(c)


#: Words up to this length are not stemmed for ROUGE.
UNSTEMMED = 3


def rouge_l_rows(pairs: DataFrame, stemmed: bool = True) -> DataFrame:
    """id, rouge_l: F1 of the longest common subsequence of ASCII words, longer words by their stems."""
    tokenized = pairs.select("id", t.ascii_tokens("hyp").alias("h"), t.ascii_tokens("ref").alias("r"))
    schema = tokenized.select("id").schema.add("lcs", "long").add("hl", "long").add("rl", "long")

    def words(found: Sequence[str]) -> list[str]:
        return [stem(w) if len(w) > UNSTEMMED else w for w in found] if stemmed else list(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "lcs": [lcs_length(words(h), words(r)) for h, r in zip(batch["h"], batch["r"])],
                    "hl": batch["h"].map(len),
                    "rl": batch["r"].map(len),
                }
            )

    # F1 of lcs/hl and lcs/rl is 2 lcs / (hl + rl).
    score = F.coalesce(F.try_divide(2.0 * F.col("lcs"), F.col("hl") + F.col("rl")), F.lit(0.0))
    return tokenized.mapInPandas(run, schema).select("id", score.alias("rouge_l"))


def rouge_l(pairs: DataFrame) -> DataFrame:
    return rouge_l_rows(pairs).agg(F.coalesce(F.avg("rouge_l"), F.lit(0.0)).alias("rouge_l"))


def mentioned(c: Column | str, terms: Sequence[str] = tuple(CLINICAL_ENTITIES)) -> Column:
    """The terms contained in the lowered text."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.array_compact(F.array(*[F.when(low.contains(term), F.lit(term)) for term in terms]))


def entity_rows(pairs: DataFrame, terms: Sequence[str] = tuple(CLINICAL_ENTITIES)) -> DataFrame:
    """id, recall (null without reference entities), hallucination (null without hypothesis entities)."""
    found = pairs.select("id", mentioned("hyp", terms).alias("h"), mentioned("ref", terms).alias("r"))
    return found.select(
        "id",
        F.try_divide(F.size(F.array_intersect("h", "r")), F.size("r")).alias("recall"),
        F.try_divide(F.size(F.array_except("h", "r")), F.size("h")).alias("hallucination"),
    )


def entity_scores(pairs: DataFrame, terms: Sequence[str] = tuple(CLINICAL_ENTITIES)) -> DataFrame:
    """One row: entity_recall, hallucination_rate; texts without entities are left out of the means."""
    return entity_rows(pairs, terms).agg(
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("entity_recall"),
        F.coalesce(F.avg("hallucination"), F.lit(0.0)).alias("hallucination_rate"),
    )


def set_prf_rows(sets: DataFrame) -> DataFrame:
    """sets(id, hyp ARRAY, ref ARRAY of triplets) -> id, precision, recall, f1; two empty sets score 1."""

    def entities(c: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(c, entities_loose)))

    found = sets.select("id", entities("hyp").alias("h"), entities("ref").alias("r"))
    both = F.size(F.array_intersect("h", "r"))
    empty = (F.size("h") == 0) & (F.size("r") == 0)
    p = F.when(empty, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both, F.size("h")), F.lit(0.0)))
    r = F.when(empty, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both, F.size("r")), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return found.select("id", p.alias("precision"), r.alias("recall")).withColumn("f1", f1)


def set_prf(sets: DataFrame) -> DataFrame:
    """One row: mean precision, recall and f1 in percent with two digits, and num_samples."""
    return set_prf_rows(sets).agg(
        *[F.round(F.avg(c) * 100, 2).alias(c) for c in ("precision", "recall", "f1")], F.count(F.lit(1)).alias("num_samples")
    )


def metric_report(pairs: DataFrame, terms: Sequence[str] = tuple(CLINICAL_ENTITIES)) -> DataFrame:
    """One row with every metric in percent (two digits) and num_samples.

    The pairs are made once, and their tokens too, which two metrics share.
    """
    pairs = materialize(pairs.select("id", "hyp", "ref"), "pairs", "zstd")
    told = materialize(tokens(pairs), "tokens", "zstd")
    parts = [corpus_bleu(pairs, told), meteor(pairs, told), rouge_l(pairs), cider(pairs), entity_scores(pairs, terms)]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    scaled = out.select(*[F.round(F.col(c) * 100, 2).alias(c) for c in out.columns])
    return scaled.crossJoin(pairs.agg(F.count(F.lit(1)).alias("num_samples")))
