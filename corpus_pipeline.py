"""From documents to tokens: language, toxicity, near-copies, mix, pieces.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept
and returns a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns of ``docs``, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import bpe, hyperlang, mixing, simhash, toxicity
from strandgraph.llm.common import fresh, table, word_count
from strandgraph.llm.queries import WEIGHTS, piece_model
from strandgraph.session import materialize

#: A text is in no known language if its cosine is under this share of what 99 of 100 texts with a language reach ...
LANGUAGE_SHARE = 0.2
#: ... and it has at least so many letters; a shorter one says too little.
LETTERS = 50
#: This share of the clean labelled texts is under the severity from which a text counts as toxic.
CLEAN_SHARE = 0.995


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter or are unlike every learned language.

    Where no document has a language nothing can be unlike it, and all texts with a letter stay.
    """
    name, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    profiles = hyperlang.train(docs, "text", "lang", "doc_id")
    if not profiles.names:
        return docs.where(F.regexp_count("text", F.lit(r"\p{L}")) > 0)
    least = LANGUAGE_SHARE * hyperlang.least_score(docs, "text", "lang", "doc_id", profiles)
    found = hyperlang.predict(docs, "text", profiles, name, score, keep=True)
    short = F.regexp_count("text", F.lit(r"\p{L}")) < LETTERS
    known = F.when(F.col(name) == hyperlang.UNDETERMINED, F.lit(False)).when(F.col(score) >= least, F.lit(True)).otherwise(short)
    return found.where(known).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of a severity that hardly a clean labelled one has; model and limit come from the labels in ``sf_dir``."""
    names = tuple(fresh(docs, name) for name in ("severity", "toxic_chance", "grade"))
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    limit = toxicity.clean_limit(docs, labels, model, CLEAN_SHARE)
    found = toxicity.predict(docs, "text", model, names, keep=True)
    return found.where(F.col(names[0]) <= limit).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays, the one with the smallest doc_id."""
    return simhash.one_of_each(docs, "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source takes its target of words."""
    row, copies = fresh(docs, "row"), fresh(docs, "copies")
    size = word_count(F.col("text"))
    unique = docs.agg(F.count(F.lit(1)) == F.count_distinct("doc_id")).first()[0]
    # Rows whose doc_id doesn't name them get a stored number.
    rows = docs.withColumn(row, F.col("doc_id")) if unique else materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    narrow = materialize(rows.select(F.col(row).alias("row"), F.col("doc_id").alias("key"), "source", size.alias("size")), "sizes")
    # Copies are counted where the texts stand; nothing but the plan moves.
    mixed = mixing.with_copies(rows, mixing.plan(narrow, WEIGHTS), row, "doc_id", "source", size, copies).where(F.col(copies) > 0)
    return mixed.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids."""
    return bpe.with_tokens(docs.select("doc_id", "text"), "text", piece_model(), ids=True)


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: No SQL can express the learned stages; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
