"""What makes the audit's matrix and the encoder cheap changes none of their results."""

import dataclasses
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from strandgraph.llm import audit, bpe, pieces
from strandgraph.llm.pieces import SPACE
from strandgraph.session import materialize

MODEL = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = ["", " ", "a", "\ta  b\r\n", "a b a\x0bb\x0cc", "é\x85é \x1cé é é", "한 a " * 40, "x" * 5000, None] + [f"w{i} w{i % 7}\n" for i in range(2500)]


def test_a_shard_outlasts_batches_and_its_words_do_not_move_as_rows(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(audit, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or materialize(df, name))
    docs = materialize(spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string").coalesce(1))
    stored = materialize(audit.shards(docs, "text", ["key"], {}))
    assert stored.count() == 1  # not one per batch of 1,000 rows
    numbers = audit.number_words(stored)
    assert numbers.count() <= audit.BUCKETS
    assert len(plans) == 1 and "Generate" not in plans[0]
    totals = {r["key"]: (r["words"], r["distinct_words"]) for r in audit.row_totals(audit.encode(stored, numbers)).collect()}
    words = [(text or "").encode().split() for text in TEXTS]
    assert totals == {key: (len(w), len(set(w))) for key, w in enumerate(words)}


def test_words_keep_their_numbers_over_shards_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(audit, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(audit, "BUCKET_WORDS", 10)  # more buckets than the least number
    docs = materialize(spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string").repartition(3, F.col("key")))
    stored = materialize(audit.shards(docs, "text", ["key"], {}))
    shards = audit.encode(stored, audit.number_words(stored)).collect()
    assert len(shards) > 10
    number: dict[bytes, int] = {}
    for shard in shards:
        for row, start, end in zip(shard["rows"], shard["indptr"], shard["indptr"][1:]):
            words = set((TEXTS[row["key"]] or "").encode().split())
            terms = set(shard["terms"][start:end])
            assert len(terms) == len(words) == end - start
            if len(words) == 1:
                assert number.setdefault(words.copy().pop(), min(terms)) == min(terms)
    seen = np.unique(np.concatenate([shard["terms"] for shard in shards]))
    assert seen.tolist() == list(range(len({w for text in TEXTS for w in (text or "").encode().split()})))


# --- pieces ------------------------------------------------------------------


def test_neighbours_are_read_off_their_own_merges(monkeypatch):
    model = pieces.load(MODEL)
    encoder = bpe.Encoder(model)
    names = random.Random(4).sample(range(1, encoder.known), 400) + [encoder.code[x] for x in ("a", "aa", "aaaa", SPACE, SPACE * 2, SPACE * 4)]
    for left, right in itertools.product(names[-60:], names):
        both = [encoder.names[left], encoder.names[right]]
        assert encoder.agree(left, right) == (encoder.merge("".join(both)) == both)
    merged = []
    monkeypatch.setattr(bpe.Encoder, "merge", lambda self, text, *more, merge=bpe.Encoder.merge: merged.append(text) or merge(self, text, *more))
    encoder, words = bpe.Encoder(model), "".join(random.Random(5).choices("aeinrst ", k=20_000))
    split = [encoder.split(segment) for segment in model.segments(words)]
    pairs = {pair for codes in split for pair in zip(codes, codes[1:])}
    assert len(merged) < len(pairs) / 2  # before: one for every pair of neighbours, and for those that were tried in vain


def test_equal_scores_are_merged_again():
    made = {x: i for i, x in enumerate([SPACE, "a", "b", "ab", "ba", "aa", "aba", "bab", SPACE + "a"])}
    for scores in ([0, 0, 0, -1, -1, -1, -1, -1, -1], [0, 0, 0, -5, -4, -3, -1, -2, -2], [0, 0, 0, -1, -2, -2, -3, -3, -4]):
        encoder = bpe.Encoder(pieces.Pieces(made, dict(zip(made, map(float, scores))), (), 9, (*made, ""), 3, rf"{SPACE}*[^{SPACE}]+|{SPACE}+"))
        for size in range(1, 9):
            for text in map("".join, itertools.product("ab", repeat=size)):
                assert [encoder.names[c] for c in encoder.split(text)] == encoder.merge(text) or not whole(encoder, text)


def whole(encoder, text):
    """Whether every part that the merges leave is made of its own characters, as pieces of trained models are."""
    return all(encoder.merge(part) == [part] for part in encoder.merge(text))


def test_texts_that_decode_to_others(spark):
    model = dataclasses.replace(pieces.load(MODEL), bytes_=())  # without byte pieces unknown characters are lost
    rows = [(0, "a 日本 b"), (1, "▁plain  text\n"), (2, "日本"), (3, "x" * 100 + "本"), (4, None), (5, "日本 b 日本")]
    encoder = bpe.Encoder(model)
    for row in bpe.with_tokens(spark.createDataFrame(rows, "id long, text string").coalesce(1), "text", model, decoded=True, ids=True).collect():
        text = rows[row["id"]][1] or ""
        assert row["token_ids"] == encoder.encode(text) and row["n_tokens"] == len(row["token_ids"])
        assert row["decoded_text"] == bpe.decode(row["token_ids"], model)
        assert row["decoded_sha256"] == hashlib.sha256(row["decoded_text"].encode()).hexdigest()
