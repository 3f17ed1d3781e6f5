"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = logistic(w . x - cut_k): one weight vector for all grades and one
ascending cut per grade. The output is the expected grade, the sum of these
probabilities. Features are words and word beginnings that tell toxic from clean
texts; x is log(1 + count).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.llm.common import BROADCAST_ROWS, bounded_batches, give_back
from strandgraph.session import materialize

#: Labelled texts the model is fitted on, on average; drawn by a digest of the key.
TRAIN_TEXTS = 20_000
#: Features of a model.
FEATURES = 4_096
#: Toxic texts a feature must occur in.
SUPPORT = 2
#: Letters of a word's beginning that are a feature of longer words.
BEGINNING = 6
#: Grades of toxic texts: equal parts of them by their share of telling words. Grade 0 is a clean text.
GRADES = 3
SEED = 5
#: Fit: steps, step length and weight of the squared weights.
STEPS, RATE, RIDGE = 400, 0.1, 1e-4

_WORDS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> tuple[Counter, int]:
    """Counts of the features of a text, and its number of words; a word's beginning ends in ``*``."""
    words = _WORDS.findall((text or "").lower())
    counts = Counter(words)
    for word, n in list(counts.items()):
        if len(word) > BEGINNING:
            counts[word[:BEGINNING] + "*"] += n
    return counts, len(words)


@dataclass
class Model:
    """Weights by feature and the ascending cuts; no cut means that nothing was learned."""

    weights: dict[str, float]
    cuts: list[float]


def graded(toxic: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Grades from toxic flags: 0 for clean, 1 to GRADES by the rank of the share of telling words among the toxic."""
    grades = np.zeros(len(toxic), dtype=np.int64)
    at = np.flatnonzero(toxic)
    order = at[np.argsort(share[at], kind="stable")]
    grades[order] = 1 + np.arange(len(order)) * GRADES // max(1, len(order))
    return grades


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, size: int, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) of the sparse matrix with these entries, by gradient steps with momentum and scaling."""
    n, top = len(grades), int(grades.max())
    counts = np.bincount(grades, minlength=top + 1)
    tail = (counts[::-1].cumsum()[::-1][1:] + 0.5) / (n + 1)
    start = -np.log(tail / (1 - tail))
    gaps = np.maximum(np.diff(start), 1e-3)
    # cuts are the first one and the logarithms of the steps between them, so they stay in order
    theta = np.concatenate([np.zeros(size), start[:1], np.log(gaps)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    inner = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1):
        w, steps = theta[:size], np.exp(theta[size + 1 :])
        cuts = theta[size] + np.concatenate([[0.0], np.cumsum(steps)])
        margin = np.bincount(rows, values * w[columns], minlength=n)
        above = np.column_stack([np.ones(n), inner(margin[:, None] - cuts[None, :]), np.zeros(n)])
        chance = np.maximum(above[np.arange(n), grades] - above[np.arange(n), grades + 1], 1e-12)
        slope = above * (1 - above)
        each = np.zeros((n, top + 2))
        each[np.arange(n), grades] = slope[np.arange(n), grades] / chance
        each[np.arange(n), grades + 1] -= slope[np.arange(n), grades + 1] / chance
        by_margin = each.sum(axis=1) / n
        by_cut = -each[:, 1 : top + 1].sum(axis=0) / n
        tails = by_cut[::-1].cumsum()[::-1]
        gradient = np.concatenate([RIDGE * w - np.bincount(columns, values * by_margin[rows], minlength=size), [-tails[0]], -tails[1:] * steps])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta - RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:size], theta[size] + np.concatenate([[0.0], np.cumsum(np.exp(theta[size + 1 :]))])


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", texts: int = TRAIN_TEXTS) -> Model:
    """Fit on about ``texts`` labelled texts (all, if there are fewer).

    A key that repeats in ``labels`` is toxic if any of its rows is, and of several
    texts of a key the first in order counts; null keys and flags are left out. Features are counted in Spark; what comes to the driver is
    bounded by ``texts`` and ``FEATURES``. Without both kinds of labels nothing is
    learned and every text is clean.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(key).agg(F.max(toxic).cast("int").alias("toxic"))
    n, bad = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not bad or bad == n:
        return Model({}, [])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    chosen = known.where(draw < min(1.0, texts / n))
    chosen = F.broadcast(chosen) if texts <= BROADCAST_ROWS // 2 else chosen  # the draw bounds it
    sample = documents.select(F.col(key), F.col(text).alias("text")).join(chosen, key).groupBy(key).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("key"), batch.column("toxic"), [c for _, c in found], [list(c) for c, _ in found], [list(c.values()) for c, _ in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    arrow = pa.schema(
        [("key", pa.int64()), ("toxic", pa.int32()), ("words", pa.int64()), ("features", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
    )
    numbered = sample.select(F.col(key).cast("long").alias("key"), "toxic", "text")
    counted = materialize(bounded_batches(numbered).mapInArrow(run, "key long, toxic int, words long, features array<string>, counts array<long>"), "features")
    n, bad = counted.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not bad or bad == n:
        return Model({}, [])
    each = counted.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    lift = F.log((F.col("bad") + 0.1) / (bad + 0.1)) - F.log((F.col("all") - F.col("bad") + 0.1) / (n - bad + 0.1))
    ranked = each.where(F.col("bad") >= SUPPORT).withColumn("lift", lift).withColumn("rank", F.col("lift") * F.sqrt("bad"))
    picked = ranked.where("lift > 0").orderBy(F.desc("rank"), "feature").limit(FEATURES).select("feature", "lift")
    telling = {row["feature"]: row["lift"] for row in picked.collect()}
    place = {name: i for i, name in enumerate(sorted(telling))}
    if not place:
        return Model({}, [])
    numbers = F.broadcast(counted.sparkSession.createDataFrame(sorted(place.items()), "feature string, at int"))  # at most FEATURES rows
    entries = counted.select("key", F.explode(F.arrays_zip("features", "counts")).alias("e")).select("key", F.col("e.features").alias("feature"), F.col("e.counts").alias("n"))
    # Numbers only, as Arrow columns: at most ``texts`` rows and the entries of their chosen features.
    found = entries.join(numbers, "feature").select("key", "at", "n").toArrow()
    keys, toxic_, words = (counted.select("key", "toxic", "words").toArrow().sort_by("key").column(c).to_numpy() for c in ("key", "toxic", "words"))
    rows = np.searchsorted(keys, found.column("key").to_numpy())
    columns, values = found.column("at").to_numpy().astype(np.int64), found.column("n").to_numpy()
    order = np.lexsort((columns, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    strong = np.array([telling[name] for name in sorted(telling)]) > np.log(10)
    share = np.bincount(rows, values * strong[columns], minlength=len(keys)) / np.maximum(1, words)
    weights, cuts = fit(rows, columns, np.log1p(values), len(place), graded(toxic_, share))
    return Model(dict(zip(place, weights.tolist())), cuts.tolist())


NAMES = ("severity", "toxic_chance", "grade")


def predict(df: DataFrame, text: str, model: Model, names: tuple[str, str, str] = NAMES, keep: bool = False) -> DataFrame:
    """Replace the text column (or with ``keep`` follow all columns) by the expected grade, the chance of grade 1 or more and the likeliest grade.

    Null and empty texts have no feature and are clean; without a model all are 0.
    """
    kept = [c for c in df.columns if keep or c != text]
    added = [(names[0], T.DoubleType(), pa.float64()), (names[1], T.DoubleType(), pa.float64()), (names[2], T.IntegerType(), pa.int32())]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind, _ in added])
    weights, cuts = model.weights, np.array(model.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.zeros(batch.num_rows)
            for i, value in enumerate(batch.column(text)):
                counts, _ = features(value.as_py())
                margins[i] = sum(weights[f] * np.log1p(counts[f]) for f in counts.keys() & weights.keys())
            above = 1 / (1 + np.exp(-np.clip(margins[:, None] - cuts[None, :], -40, 40)))
            chance = above[:, 0] if len(cuts) else np.zeros(batch.num_rows)
            grades = -np.diff(np.column_stack([np.ones(batch.num_rows), above, np.zeros(batch.num_rows)]), axis=1)
            results = [above.sum(axis=1), chance, grades.argmax(axis=1)]
            columns = [*(batch.column(c) for c in kept), *(pa.array(r, kind) for r, (_, _, kind) in zip(results, added))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(name for name, _, _ in added)])
        give_back()

    return bounded_batches(df).select(*kept, *([] if keep else [text])).mapInArrow(run, schema)


def clean_limit(documents: DataFrame, labels: DataFrame, model: Model, share: float = 0.995, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> float:
    """The severity that ``share`` of all clean labelled texts do not exceed; infinite if there are none or nothing was learned.

    Texts are scored where they stand; only keys and severities move.
    """
    if not model.cuts:
        return float("inf")
    clean = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(toxic).alias("toxic")).where("toxic = 0").select(key)
    scored = predict(documents.where(F.col(key).isNotNull()).select(F.col(key), F.col(text).alias("text")), "text", model).select(key, "severity")
    limit = exact_percentile(scored.join(clean, key, "left_semi").select("severity"), share)
    return float("inf") if limit is None else limit


#: Ranges that a pass of ``exact_percentile`` counts.
RANGES = 1_024


def exact_percentile(values: DataFrame, share: float) -> float | None:
    """As the function ``percentile`` of a column of doubles; None without values.

    Its place is found in ever finer ranges of the stored values, so no task holds all that differ.
    """
    name = values.columns[0]
    stored = materialize(values.where(F.col(name).isNotNull()), "values")
    n, least, most = stored.agg(F.count(F.lit(1)), F.min(name), F.max(name)).first()
    if not n:
        return None

    def ranked(rank: int) -> float:
        low, high = least, most
        while low < high:
            place = F.least(F.floor((F.col(name) - low) / ((high - low) / RANGES)), F.lit(RANGES - 1))
            within = stored.where(F.col(name).between(low, high)).groupBy(place.alias("place"))
            for _, rows, low, high in sorted(within.agg(F.count(F.lit(1)), F.min(name), F.max(name)).collect()):
                if rank < rows:
                    break
                rank -= rows
        return low

    at = (n - 1) * share
    below = int(at)
    low = ranked(below)
    return low if at == below else (below + 1 - at) * low + (at - below) * ranked(below + 1)
