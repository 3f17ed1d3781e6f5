"""Blocks of scores stay small, and results don't depend on their size."""

import tracemalloc

import numpy as np
import pandas as pd

from strandgraph.operators import retrieval as V


def test_scores_of_a_block_are_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [v for v in rng.normal(size=(V.CORPUS_BLOCK_ROWS // 2, 8))]
    corpus = pd.DataFrame({"cid": range(len(vectors)), "vec": vectors})
    queries = pd.DataFrame({"qid": range(600), "vec": vectors[:600]})
    run = V._block_topk(5, ["qid", "cid", "score"])
    tracemalloc.start()
    found = run(queries, corpus)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    monkeypatch.setattr(V, "SCORES_AT_A_TIME", 1)
    pd.testing.assert_frame_equal(found, run(queries, corpus))
