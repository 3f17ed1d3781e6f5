"""The registered queries of the subpackage at the smallest size, beside their oracles or plain versions of them."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
import sentencepiece

from strandgraph.llm import registry, simhash
from tests.compare import compare, connect

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.fixture(scope="module")
def docs(folder):
    return duckdb.sql(f"SELECT * FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, folder, con, name):
    rows, problem = compare(registry.QUERIES[name](spark, folder), con, registry.ORACLE[name])
    assert not problem
    assert rows


def run(spark, folder, name, key="doc_id"):
    return {row[key]: row for row in registry.QUERIES[name](spark, folder).collect()}


def test_op1(spark, folder):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    found = {}
    for row in registry.QUERIES["op1_hilbert"](spark, folder).collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    assert sorted(found) == [i for i in ids if i % 100 == 0]
    hits = total = 0
    for query, got in found.items():
        got.sort()
        away = np.sqrt(((points - points[ids == query]) ** 2).sum(axis=1))
        away[ids == query] = np.inf
        assert [g[0] for g in got] == list(range(1, 11))
        assert [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
        assert np.allclose([g[2] for g in got], [away[ids == g[1]][0] for g in got], rtol=0, atol=1e-12)
        hits += len({g[1] for g in got} & set(ids[np.lexsort((ids, away))[:10]].tolist()))
        total += 10
    assert hits / total >= 0.9


def test_op3(spark, folder, docs):
    found = run(spark, folder, "op3_toxicity")
    assert sorted(found) == [d[0] for d in docs]
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    right = [found[i]["toxic"] == bool(t) for i, t in labels.items()]
    assert np.mean(right) > 0.95
    assert all(0 <= row["severity"] <= 3 and (row["severity"] > 0.5) >= row["toxic"] for row in found.values())


def test_op4(spark, folder, docs):
    found = run(spark, folder, "op4_mix")
    assert found == run(spark, folder, "op4_mix")  # reruns agree
    sizes = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    source = {d[0]: d[3] for d in docs}
    total: dict = {}
    for i, n in sizes.items():
        total[source[i]] = total.get(source[i], 0) + n
    names = sorted(total)
    weight = {name: (5, 2, 1)[k % 3] for k, name in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        share = rest / sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * total[s] if s in full else share * weight[s] for s in names}
        over = {s for s in names if target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    taken = dict.fromkeys(names, 0)
    for i, row in found.items():
        assert (row["size"], row["source_size"]) == (sizes[i], total[source[i]])
        assert row["target"] == pytest.approx(target[source[i]], rel=1e-9)
        assert 0 <= row["taken"] <= 3 * row["size"]
        taken[source[i]] += row["taken"]
    for s in names:  # a source of ten documents cannot come nearer than its smaller ones allow
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + min(n for i, n in sizes.items() if source[i] == s)


def test_op5(spark, folder, docs):
    found = run(spark, folder, "op5_language")
    assert sorted(found) == [d[0] for d in docs]
    for i, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1
    assert np.mean([found[d[0]]["lang_pred"] == d[2] for d in docs if found[d[0]]["held_out"]]) > 0.95


def test_op6(spark, folder, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = run(spark, folder, "op6_pieces")
    for d in docs:
        ids = library.encode(d[1] or "")
        row = found[d[0]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op7(spark, folder, docs):
    from strandgraph.llm import pieces

    model = pieces.load(MODEL)
    found = run(spark, folder, "op7_token_counts")
    for d in docs[:60]:
        assert found[d[0]]["n_tokens"] == sum(plain_count(word, model) for word in model.segments(d[1] or ""))


def plain_count(word, model):
    """Tokens of the best of all segmentations, by the textbook recursion from the front."""
    unknown = min(model.scores.values()) - 10
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + model.scores[word[s:end]], -s, best[s][1] + 1) for s in range(end) if word[s:end] in model.scores]
        if word[end - 1] not in model.scores:
            options.append((best[end - 1][0] + unknown, -end, best[end - 1][1] + len(word[end - 1].encode())))
        score, _, count = max(options)
        best.append((score, count))
    return best[-1][1]


def test_op8(spark, folder, docs):
    found = run(spark, folder, "op8_shard")
    shards: dict = {}
    for d in docs:
        row, raw = found[d[0]], (d[1] or "").encode()
        assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards.setdefault(row["shard"], []).append((row["slot"], row["size"]))
    assert sorted(shards) == list(range(8))
    largest = max(row["size"] for row in found.values())
    target = sum(row["size"] for row in found.values()) / 8
    for rows in shards.values():
        assert sorted(slot for slot, _ in rows) == list(range(len(rows)))
        assert abs(sum(size for _, size in rows) - target) <= 2 * largest


def test_op9(spark, folder, docs):
    found = run(spark, folder, "op9_simhash")
    prints = np.array([simhash.fingerprint(d[1], 3) for d in docs], dtype=np.uint64)
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 2):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    for i, d in enumerate(docs):
        assert found[d[0]]["fingerprint"] == f"{int(prints[i]):016x}"
        assert found[d[0]]["component_id"] == docs[root(i)][0]
