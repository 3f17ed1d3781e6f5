"""Thresholds that come from all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import hyperlang


def test_least_score_looks_at_every_text(spark):
    words = ["water", "house", "stone", "river", "garden", "maison", "pierre", "fleuve", "jardin"]
    rows = [(i, " ".join(words[(i * k + i // 7) % 9] for k in range(1, 3 + i % 5)), "en" if i % 2 else "fr") for i in range(7000)]
    docs = spark.createDataFrame([*rows, (7000, "12 34", "en"), (7001, None, "en"), (7002, "zzz qqq", None)], "doc_id long, text string, lang string")
    profiles = hyperlang.train(docs, "text", "lang", "doc_id")
    for share in (0.001, 0.01, 0.37):
        learned = docs.where("lang IS NOT NULL AND text IS NOT NULL")
        scores = [r["score"] for r in hyperlang.predict(learned, "text", profiles).where(F.col("lang_pred") != "und").select("score").collect()]
        found = hyperlang.least_score(docs, "text", "lang", "doc_id", profiles, share)
        assert found == pytest.approx(np.percentile(scores, 100 * share), abs=2 / hyperlang.CLASSES)
        assert hyperlang.least_score(docs.where("lang IS NULL"), "text", "lang", "doc_id", profiles, share) == 0.0
