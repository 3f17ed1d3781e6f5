"""The report makes its pairs once, and BLEU counts as a plain version does."""

import random
import re
from collections import Counter

import pytest

from strandgraph.operators import textmetrics as M
from strandgraph.plans import metric_queries as Q


def test_the_report_makes_pairs_and_tokens_once(spark, folder, monkeypatch):
    plans, write = [], M.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(M, "materialize", lambda df, *a, **b: (plans.append(plan(df)), write(df, *a, **b))[1])
    plans.append(plan(Q.metric_report(spark, folder)))
    assert sum(len(re.findall(r"FileScan parquet.*documents\.parquet", p)) for p in plans) == 3  # references, and answers with their stale ones
    assert sum("regexp_replace" in p for p in plans) == 1


def plain_sums(rows, top):
    out = Counter()
    for h, rs in rows:
        for n in range(1, top + 1):
            grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            most = Counter()
            for r in rs:
                most |= grams(r)
            out[f"_m{n}"] += sum((grams(h) & most).values())
            out[f"_d{n}"] += max(len(h) - n + 1, 1)
        out["_hl"] += len(h)
        out["_rl"] += min((abs(len(r) - len(h)), len(r)) for r in rs)[1]
    return out


@pytest.mark.parametrize("words", [1, 50, 1 << 18])
def test_ngrams_of_slices_are_the_plain_ones(spark, monkeypatch, words):
    monkeypatch.setattr(M, "BLEU_WORDS", words)
    rng = random.Random(words)
    text = lambda: rng.choices("abcde", k=rng.randint(0, 9))
    rows = [(text(), [text() for _ in range(rng.randint(1, 3))]) for _ in range(200)] + [([], [[]]), (["a"], [[], ["a", "a"]])]
    found = M._bleu_sums(spark.createDataFrame(rows, "h array<string>, rs array<array<string>>"), 4).first().asDict()
    assert found == dict(plain_sums(rows, 4))
    empty = M._bleu_sums(spark.createDataFrame([], "h array<string>, rs array<array<string>>"), 4).first().asDict()
    assert set(empty.values()) == {0}
    assert M._bleu_sums(spark.createDataFrame([([], [[]])], "h array<string>, rs array<array<string>>"), 2).first()["_d2"] == 1


def test_rules_are_left_out_only_where_they_change_nothing(spark):
    rng = random.Random(3)
    bits = ["a", "b", " ", ".", "..", "--", "---", "'s", "n't", "'ll", "'", '"', ",", ":", "1", "!", ")", "é", "\n"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(600)] + [(999, None)]
    df = spark.createDataFrame(rows, "id int, x string")

    def plain(x):
        for pattern, replacement in M.WORD_RULES:
            x = re.sub(pattern.replace(r"$)", r"\Z)") if not pattern.endswith("$") else r"([:,])\Z", replacement, x)
        return x.split()

    for row in df.select("id", "x", M.word_tokens("x").alias("w")).collect():
        assert row["w"] == (None if row["x"] is None else plain(row["x"].lower())), row["x"]
