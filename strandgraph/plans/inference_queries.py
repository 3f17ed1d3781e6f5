"""Registered queries: a model applied to a table, and applied again after it failed on some rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.operators import inference as I
from strandgraph.plans import fixtures as fx
from strandgraph.session import materialize


class Scorer:
    """A stand-in for a model: plain arithmetic, which fails on texts with a bar as long as it is strict."""

    def __init__(self, strict: bool):
        self.strict = strict

    def __call__(self, texts: list[str]) -> list[int]:
        if self.strict and any("|" in text for text in texts):
            raise ValueError("a bar")
        return [(31 * len(text) + 7 * text.count("e")) % 1000 for text in texts]


def _scored(spark, d, strict, done=None):
    docs = fx.table(spark, d, "documents")
    return I.with_model_output(docs, "doc_id", "text", lambda: Scorer(strict), "long", batch_rows=64, done=done)


def model_output(spark, d):
    return _scored(spark, d, strict=True).select("doc_id", F.col("output").alias("score"), "error")


def model_resume(spark, d):
    """The rows that failed are tried again with a model that does not; the others are taken over."""
    first = materialize(_scored(spark, d, strict=True), "scores")
    return _scored(spark, d, strict=False, done=first).select("doc_id", F.col("output").alias("score"), "error")


QUERIES = {f.__name__: f for f in (model_output, model_resume)}

_SCORE = "(31 * length(text) + 7 * (length(text) - length(replace(text, 'e', '')))) % 1000"
ORACLE = {
    "model_output": f"""
        SELECT doc_id, CASE WHEN NOT contains(text, '|') THEN {_SCORE} END AS score, CASE WHEN contains(text, '|') THEN 'ValueError: a bar' END AS error FROM documents""",
    "model_resume": f"SELECT doc_id, {_SCORE} AS score, NULL::VARCHAR AS error FROM documents",
}
