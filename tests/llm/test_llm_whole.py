"""Limits that are learned come from all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import toxicity


def test_the_clean_limit_is_that_of_all_clean_texts(spark):
    n, high = 30_000, 200
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("bad "), F.greatest(F.col("id") - (n - high), F.lit(0)).cast("int")).alias("text"))
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    labels = labels.union(spark.createDataFrame([(None, 0), (n - 1, 1), (n + 5, 0)], "doc_id long, toxic int"))
    model = toxicity.Model({"bad": 1.0}, [1.0, 2.0, 3.0])
    margins = np.log1p(np.maximum(np.arange(n - 1) - (n - high), 0))
    severity = (1 / (1 + np.exp(np.array(model.cuts)[None, :] - margins[:, None]))).sum(axis=1)
    assert toxicity.clean_limit(docs, labels, model, 0.995) == pytest.approx(np.quantile(severity, 0.995), rel=1e-12)
    assert toxicity.clean_limit(docs, labels.limit(0), model) == toxicity.clean_limit(docs, labels, toxicity.Model({}, [])) == float("inf")


@pytest.mark.parametrize("rows", [[1.0], [2.0, 2.0, 2.0], [0.0, 1e-18, 1e-18, 3.0, None], [float(i * i % 89) / 7 for i in range(5_000)]])
def test_percentiles_are_those_of_the_function(spark, rows):
    values = spark.createDataFrame([(x,) for x in rows], "x double")
    for share in (0.0, 0.3, 0.5, 0.995, 1.0):
        assert toxicity.exact_percentile(values, share) == values.agg(F.percentile("x", share)).first()[0]
    assert toxicity.exact_percentile(values.limit(0), 0.5) is None
