"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of three letters binds
(multiplies) those of its letters, permuted (rotated) by their place; a text
bundles (adds) the vectors of all its trigrams; a language prototype bundles the
normalised vectors of its texts. The prototype with the largest cosine wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.llm.common import bounded_batches, give_back

#: Components of a vector.
DIMENSIONS = 1024
SEED = 11
#: Texts per language that the prototypes are bundled from, on average; drawn by a digest of the key.
TRAIN_TEXTS = 5_000
#: Languages a model may have: each is one vector that every task holds.
LANGUAGES = 4_096
#: Components of normalised vectors are added as whole numbers of this fraction, so sums don't depend on their order.
UNIT = 1 << 20
#: Characters and texts that are turned to vectors at a time; longer texts are a block of their own.
BLOCK_CHARS, BLOCK_TEXTS = 500_000, 256
#: Sizes up to which trigram codes are counted in a table, not sorted.
TABLE = 1 << 22

UNDETERMINED = "und"


@dataclass
class Letters:
    """Random vectors of letters, made from the code point alone and kept for the task."""

    dimensions: int
    known: dict[int, np.ndarray] = field(default_factory=dict)

    def __getitem__(self, point: int) -> np.ndarray:
        got = self.known.get(point)
        if got is None:
            draw = np.random.Generator(np.random.PCG64([SEED, point])).integers(0, 2, self.dimensions, dtype=np.int8)
            got = self.known[point] = 2 * draw - 1
        return got


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number and trigram number of every trigram, code points of each distinct trigram).

    Texts are lowered; everything but letters counts as one space, also in front
    of and behind a text; only trigrams with a letter in the middle count.
    """
    lowered = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(t) for t in lowered])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    present = np.flatnonzero(np.bincount(points))
    letters = np.array([p for p in present if chr(p).isalpha()], dtype=np.int64)
    number = np.zeros(int(points.max()) + 1, dtype=np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    codes = number[points]
    first = np.zeros(len(codes), dtype=bool)
    first[np.cumsum(lengths)[:-1]] = True
    keep = (codes > 0) | first
    keep[1:] |= codes[:-1] > 0
    keep[0] = True
    codes, owner = codes[keep], owner[keep]
    base = len(letters) + 1
    whole = (codes[1:-1] > 0) & (owner[:-2] == owner[2:])
    grams = ((codes[:-2] * base + codes[1:-1]) * base + codes[2:])[whole]
    owner = owner[1:-1][whole]
    if base**3 <= TABLE:
        distinct = np.flatnonzero(np.bincount(grams, minlength=1))
        at = np.zeros(base**3, dtype=np.int64)
        at[distinct] = np.arange(len(distinct))
        numbers = at[grams]
    else:
        distinct, numbers = np.unique(grams, return_inverse=True)
    if not len(grams):
        distinct = distinct[:0]
    spelled = np.concatenate([[0], letters])[np.stack([distinct // base**2, distinct // base % base, distinct % base], axis=1)]
    return owner, numbers, spelled


#: Distinct trigrams whose vectors are held at a time.
SLICE = 8192


def bundle(texts: list[str], letters: Letters) -> np.ndarray:
    """One row per text: the sum of the vectors of its trigrams (all 0 without a letter)."""
    owner, numbers, spelled = trigrams(texts)
    if not len(owner):
        return np.zeros((len(texts), letters.dimensions), dtype=np.float32)
    size = len(spelled)
    points, place = np.unique(spelled, return_inverse=True)
    table = np.stack([letters[int(p)] for p in points])
    place = place.reshape(-1, 3)
    counts = np.bincount(owner * size + numbers, minlength=len(texts) * size).reshape(len(texts), size)
    out = np.zeros((len(texts), letters.dimensions), dtype=np.float32)
    for at in range(0, size, SLICE):
        first, second, third = place[at : at + SLICE].T
        bound = np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]
        out += counts[:, at : at + SLICE].astype(np.float32) @ bound.astype(np.float32)
    return out


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) in bounded pieces."""
    start, block, chars = 0, [], 0
    for i, text in enumerate(texts):
        block.append(text or "")
        chars += len(block[-1])
        if chars >= BLOCK_CHARS or len(block) == BLOCK_TEXTS:
            yield start, block
            start, block, chars = i + 1, [], 0
    if block:
        yield start, block


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: the CRC-32 of its key as text is divisible by ``folds``. False for null keys."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


@dataclass
class Profiles:
    """Language prototypes: names in code point order and one unit row each."""

    names: list[str]
    rows: np.ndarray


def train(df: DataFrame, text: str, lang: str, key: str, texts: int = TRAIN_TEXTS, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes of all languages of ``df`` from about ``texts`` texts each (all, if a language has fewer).

    Rows with a null text, language or key are left out. Every task adds up its
    texts by language, so what is shuffled is one vector per task and language.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    sizes = {row[0]: row[1] for row in rows.groupBy(lang).count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Profiles([], np.zeros((0, dimensions)))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, texts / n))])
    sample = rows.where(draw < share[F.col(lang)]).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        letters = Letters(dimensions)
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for start, block in blocks(batch.column("text").to_pylist()):
                vectors = bundle(block, letters).astype(np.float64)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                whole = np.rint(vectors / np.where(norms > 0, norms, 1) * UNIT).astype(np.int64)
                for name, row in zip(names[start : start + len(block)], whole):
                    sums[name] = sums.get(name, 0) + row
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "sums": [v.tolist() for v in sums.values()]}, schema=arrow)

    arrow = pa.schema([("lang", pa.string()), ("sums", pa.list_(pa.int64()))])
    parts = bounded_batches(sample).mapInArrow(run, "lang string, sums array<long>")
    added = parts.select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows_ = np.zeros((len(sizes), dimensions))
    names = sorted(sizes)
    place = {name: i for i, name in enumerate(names)}
    for lang_, at, x in added.collect():  # languages x dimensions, both bounded
        rows_[place[lang_], at] = x
    norms = np.linalg.norm(rows_, axis=1, keepdims=True)
    return Profiles(names, rows_ / np.where(norms > 0, norms, 1))


def predict(df: DataFrame, text: str, profiles: Profiles, name: str = "lang_pred", score: str = "score", keep: bool = False) -> DataFrame:
    """Replace the text column (or with ``keep`` follow all columns) by the predicted language and the cosine, cut to 0 and 1.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned.
    Ties go to the first name. Nothing but the text is looked at.
    """
    kept = [c for c in df.columns if keep or c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    names, prototypes = profiles.names, profiles.rows.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(prototypes.shape[1])
        for batch in batches:
            found, scores = [], []
            for _, block in blocks(batch.column(text).to_pylist()):
                vectors = bundle(block, letters)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = vectors @ prototypes.T / np.where(norms > 0, norms, 1)[:, None] if names else np.zeros((len(block), 1))
                best = np.argmax(cosines, axis=1)
                known = [bool(names) and any(map(str.isalpha, t)) for t in block]
                found += [names[b] if k else UNDETERMINED for b, k in zip(best, known)]
                scores += [float(min(1.0, max(0.0, c[b]))) if k else 0.0 for c, b, k in zip(cosines, best, known)]
            columns = [*(batch.column(c) for c in kept), pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, name, score])
        give_back()

    return bounded_batches(df).select(*kept, *([] if keep else [text])).mapInArrow(run, schema)


#: Classes of equal width that cosines are counted in for a percentile.
CLASSES = 1 << 20


def least_score(df: DataFrame, text: str, lang: str, key: str, profiles: Profiles, share: float = 0.01) -> float:
    """The cosine that all but ``share`` of all texts with a language and a letter reach; 0 where nothing was learned.

    Cosines are cut down to a whole number of ``CLASSES`` and counted, so what is gathered is bounded.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    if not profiles.names:
        return 0.0
    found = predict(rows.select(F.col(text).alias("text")), "text", profiles).where(F.col("lang_pred") != UNDETERMINED)
    counted = found.groupBy(F.floor(F.col("score") * CLASSES).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return (counted.agg(F.percentile("at", share, F.col("n"))).first()[0] or 0.0) / CLASSES
