"""Exact cosine top-k of captions per query vector, and what is kept of it.

Like a flat inner-product index, every query meets every vector. The work is cut
into (query block, corpus block) tasks by hashed ids: each task multiplies two
bounded blocks and passes on only the best ``k`` of each query, so neither pairs
nor scores of a whole query are ever gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.operators.ordinal import seeded_draw, top_per_group
from strandgraph.session import column

QUERY_BLOCK_ROWS = 8192
CORPUS_BLOCK_ROWS = 65536
SCORES_AT_A_TIME = 4_000_000  # 32 MB, of which rounding holds three copies
SCORE_DIGITS = 9  # scores are rounded before ranking, so summation order cannot change ties


def normalize_l2(vec: Column | str) -> Column:
    """Unit-length vector in DOUBLE; a zero vector stays zero."""
    v = F.transform(column(vec), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def _unit(rows: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1.0)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, equal ones in order; only what reaches the k-th largest is sorted."""
    if k < len(scores):
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.argsort(-scores[near], kind="stable")][:k]


def _block_topk(k: int, out_names: list[str]):
    def run(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or corpus.empty:
            return pd.DataFrame({n: [] for n in out_names})
        corpus = corpus.sort_values("cid", kind="stable")  # equal scores: smaller id first
        right = _unit(corpus["vec"])
        cids, qids, width = corpus["cid"].to_numpy(), queries["qid"].to_numpy(), min(k, len(corpus))
        parts = []
        step = max(1, SCORES_AT_A_TIME // len(corpus))
        for start in range(0, len(queries), step):
            scores = np.round(_unit(queries["vec"].iloc[start : start + step]) @ right.T, SCORE_DIGITS) + 0.0
            best = np.stack([_best(row, width) for row in scores])
            parts.append(
                pd.DataFrame(
                    {
                        "qid": np.repeat(qids[start : start + step], width),
                        "cid": cids[best].ravel(),
                        "score": np.take_along_axis(scores, best, axis=1).ravel(),
                    }
                )
            )
        return pd.concat(parts, ignore_index=True)

    return run


def topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_blocks: int | None = None,
    corpus_blocks: int | None = None,
) -> DataFrame:
    """queries(qid, vec), corpus(cid, vec) -> qid, cid, score, rank; equal scores by cid.

    Block counts come from row counts unless they are given.
    """
    nq = query_blocks or max(1, -(-queries.count() // QUERY_BLOCK_ROWS))
    nc = corpus_blocks or max(1, -(-corpus.count() // CORPUS_BLOCK_ROWS))

    def blocks(own: str, n: int, other: str, m: int, df: DataFrame, key: str) -> DataFrame:
        return df.select(
            key,
            "vec",
            F.pmod(F.xxhash64(key), F.lit(n)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other),
        )

    left = blocks("qb", nq, "cb", nc, queries, "qid").groupBy("qb", "cb")
    right = blocks("cb", nc, "qb", nq, corpus, "cid").groupBy("qb", "cb")
    schema = T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("cid", corpus.schema["cid"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    run = _block_topk(k, schema.names)

    def task(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return run(q, c)

    local = left.cogroup(right).applyInPandas(task, schema)
    return top_per_group(local, ["qid"], [F.desc("score"), "cid"], k, rank="rank")


def topk_probed(
    queries: DataFrame, corpus: DataFrame, k: int, pivots: int = 16, probes: int = 14, seed: int = 7, block: int = CORPUS_BLOCK_ROWS
) -> DataFrame:
    """Approximate form of ``topk``: every corpus vector lies in the cell of its nearest pivot, and a query looks into its ``probes`` nearest cells.

    The pivots are a repeatable sample of the corpus. Scores are exact, only
    neighbours in cells that are not probed are missed: with all cells probed the
    result is that of ``topk``. Large cells are cut into blocks by hashed ids. The
    default suits vectors without clusters; clustered ones need few probes.
    """
    chosen = corpus.where(F.size("vec") > 0).orderBy(seeded_draw("cid", seed), "cid").limit(pivots).collect()  # bounded
    if not chosen:
        return topk(queries, corpus, k)
    marks = _unit(pd.Series([row["vec"] for row in chosen]))
    blocks = max(1, -(-corpus.count() // block))

    def in_cells(df: DataFrame, key: str, cells: int, spread: Column) -> DataFrame:
        schema = T.StructType([df.schema[key], df.schema["vec"], T.StructField("cells", T.ArrayType(T.LongType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    near = np.argsort(-np.round(_unit(batch["vec"]) @ marks.T, SCORE_DIGITS), axis=1, kind="stable")[:, :cells]
                    yield batch.assign(cells=list(near))

        placed = df.select(key, "vec").mapInPandas(run, schema)
        return placed.select(key, "vec", F.explode("cells").alias("cell"), spread.alias("part"))

    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    left = in_cells(queries, "qid", min(probes, len(chosen)), every).withColumn("part", F.explode("part")).groupBy("cell", "part")
    right = in_cells(corpus, "cid", 1, F.pmod(F.xxhash64("cid"), F.lit(blocks))).groupBy("cell", "part")
    schema = T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("cid", corpus.schema["cid"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    run = _block_topk(k, schema.names)

    def task(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return run(q, c)

    return top_per_group(left.cogroup(right).applyInPandas(task, schema), ["qid"], [F.desc("score"), "cid"], k, rank="rank")


def topk_one(corpus: DataFrame, vector: DataFrame, k: int = 7) -> DataFrame:
    """Nearest ``k`` of corpus(cid, vec) to the single row of vector(vec): cid, score; no Python involved."""
    query = vector.select(normalize_l2("vec")).scalar()
    unit = corpus.withColumn("_u", normalize_l2("vec")).withColumn("_q", query)
    score = F.aggregate(F.zip_with("_u", "_q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return unit.select("cid", (F.round(score, SCORE_DIGITS)).alias("score")).orderBy(F.desc("score"), "cid").limit(k)


def retrieve(
    ranked: DataFrame, query_images: DataFrame, captions: DataFrame, keep: int = 7, strict: bool = False
) -> DataFrame:
    """ranked(qid, cid, rank), query_images(qid, img_id), captions(cid, img_id, caption) -> img_id, captions.

    Neighbours of the same image are dropped, then the best ``keep`` stay in rank
    order. ``strict`` fails when an image is left with fewer.
    """
    mine = query_images.select("qid", F.col("img_id").alias("_mine"))
    theirs = captions.select("cid", F.col("img_id").alias("_theirs"), "caption")
    found = ranked.join(mine, "qid").join(theirs, "cid")
    other = found.where(F.col("_mine") != F.col("_theirs"))
    best = top_per_group(other, ["qid"], ["rank"], keep)
    # At most ``keep`` captions per query.
    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "caption"))).alias("_c"))
    joined = mine.join(lists, "qid", "left").select(
        "qid",
        F.col("_mine").alias("img_id"),
        F.coalesce(F.transform("_c", lambda c: c["caption"]), F.array().cast("array<string>")).alias("captions"),
    )
    if strict:
        short = F.size("captions") < keep
        failed = F.raise_error(F.format_string(f"fewer than {keep} neighbours for image %s", F.col("img_id").cast("string")))
        joined = joined.withColumn("captions", F.when(short, failed.cast("array<string>")).otherwise(F.col("captions")))
    return joined


def build_datastore(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """records(img_id, triplets), vectors(img_id, vec) -> id, caption, vec; only records with triplets."""
    captions = records.where(F.size("triplets") > 0).select("img_id", F.array_join("triplets", "; ").alias("caption"))
    return captions.join(vectors, "img_id").select(F.col("img_id").alias("id"), "caption", normalize_l2("vec").alias("vec"))
