"""Text metrics that look at a pair in its row."""

import math
from collections import Counter

import pytest

from strandgraph.operators import textmetrics as M
from strandgraph.plans import metric_queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_and_ngrams_are_not_moved(spark, folder):
    for name in ("meteor", "meteor_exact", "meteor_turns", "bleu", "bleu_multi"):
        text = plan(Q.QUERIES[name](spark, folder))
        assert "Generate" not in text and "gram" not in text, name


def test_null_texts_are_empty(spark):
    pairs = spark.createDataFrame([(1, None, "a b"), (2, "a b", None), (3, None, None), (4, "a b c d e", "a b c d e")], "id int, hyp string, ref string")
    assert M.corpus_bleu(pairs).first()["bleu_1"] == pytest.approx(5 / 9)
    scores = {r["id"]: r["meteor"] for r in M.meteor_rows(pairs).collect()}
    assert scores[1] == scores[2] == scores[3] == 0.0 and scores[4] > 0.99
    assert M.meteor_rows(pairs.limit(0)).count() == 0


def plain_cider(pairs):
    def grams(text):
        w = (text or "").split()
        return [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, 5)]

    df = Counter(g for _, _, ref in pairs for counts in grams(ref) for g in counts)
    out = {}
    for i, hyp, ref in pairs:
        h, r, total = grams(hyp), grams(ref), 0.0
        for n in range(4):
            vh, vr = ({g: c * math.log(len(pairs) / max(1, df[g])) for g, c in side[n].items()} for side in (h, r))
            norm = math.sqrt(sum(x * x for x in vh.values())) * math.sqrt(sum(x * x for x in vr.values()))
            total += sum(min(x, vr[g]) * vr[g] for g, x in vh.items() if g in vr) / norm if norm else 0.0
        away = sum(h[1].values()) - sum(r[1].values())
        out[i] = 2.5 * total * math.exp(-away * away / 72)
    return out


@pytest.mark.parametrize("words", [1 << 20, 40])
def test_cider_in_chunks_beside_a_plain_version(spark, monkeypatch, words):
    monkeypatch.setattr(M, "CHUNK_WORDS", words)
    rows = [(i, " ".join(f"w{(i * j) % (3 + i % 17)}" for j in range(i % 23)), " ".join(f"w{(i * j + j) % (2 + i % 19)}" for j in range(i % 29))) for i in range(120)]
    rows += [(200, None, "w1 w2 w3"), (201, "w1 w2", None), (202, None, None), (203, "", " "), (204, "a a a a a", "a a a"), (205, "b c", "c b")]
    pairs = spark.createDataFrame(rows, "id long, hyp string, ref string")
    found = {r["id"]: r["cider"] for r in M.cider_rows(pairs).collect()}
    assert found == pytest.approx(plain_cider(rows))
    assert M.cider_rows(pairs.limit(0)).count() == 0 and M.cider(pairs.limit(0)).first()["cider"] == 0.0


def test_cider_moves_no_row_of_an_ngram(spark, folder):
    for name in ("cider", "cider_rows"):
        text = plan(Q.QUERIES[name](spark, folder))
        assert "Generate" not in text and "gram#" not in text, name
