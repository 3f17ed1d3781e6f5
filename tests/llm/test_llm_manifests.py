"""Operators 11 to 13 on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, beside plain versions."""

import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from strandgraph.llm import audit, merkle, minhash
from strandgraph.session import materialize
from tests.llm.test_llm_edges import LONG, ROWS, SCHEMA, brute_groups, families


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(ROWS, SCHEMA).repartition(3))


def plain_log(leaves):
    """All levels of a tree over its leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([hashlib.sha256("".join(row[i : i + 3]).encode()).hexdigest() for i in range(0, len(row), 3)])
    return levels


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100])
def test_positions_address_the_log(count):
    leaves = [f"leaf{i}" for i in range(count)]
    levels = plain_log(leaves)
    log = merkle.append_log(leaves, merkle.height(count))
    assert log[-1] == levels[-1][0] and len(log) == sum(map(len, levels))
    for level, row in enumerate(levels):
        assert [log[merkle.position(level, i, count)] for i in range(len(row))] == row
    for i in range(count):
        assert merkle.fold(leaves[i], merkle.block_steps(log, i, count, merkle.height(count))) == levels[-1][0]


@pytest.mark.parametrize("stride", [1, 2, 5])
def test_manifest_over_several_strides(spark, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    rows = [(i, [None, "", "b", "é"][min(i % 7, 3)], f"{i:064x}") for i in range(150)] + [(None, "b", "f" * 64), (3, "é", f"{3:064x}")]
    df = spark.createDataFrame(rows, "id long, part string, leaf string").withColumn("held", F.when(F.col("id") == 5, "0" * 64).otherwise(F.col("leaf"))).withColumn("root", F.lit(1))
    made = merkle.manifest(df.drop("root"), "part", ["id"], "leaf")
    found = merkle.prove(made, "held").collect()
    names = sorted({r[1] for r in rows}, key=lambda n: (n is not None, (n or "").encode()))
    groups = {n: sorted((r for r in rows if r[1] == n), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for n in names}
    trees = {n: plain_log([r[2] for r in group]) for n, group in groups.items()}
    top = plain_log([trees[n][-1][0] for n in names])

    def siblings(levels, i):
        out = ""
        for row in levels[:-1]:
            first = i - i % 3
            out += "".join(row[k] for k in range(first, min(first + 3, len(row))) if k != i)
            i //= 3
        return out

    want = {}
    for g, n in enumerate(names):
        for i, r in enumerate(groups[n]):
            proof = hashlib.sha256((siblings(trees[n], i) + siblings(top, g)).encode()).hexdigest()
            want.setdefault((r[0], r[2]), set()).add((trees[n][-1][0], top[-1][0], proof))
    assert len(found) == len(rows)
    assert all((r["subroot"], r["root"], r["proof_sha256"]) in want[(r["id"], r["leaf"])] for r in found)
    assert {r["id"] for r in found if not r["verified"]} == {5}


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "id long, part string, leaf string, held string")
    assert merkle.prove(merkle.manifest(df, "part", ["id"], "leaf"), "held").count() == 0


def test_audit_edges(spark, docs, monkeypatch):
    monkeypatch.setattr(audit, "SHARD_BYTES", 40)  # many shards
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    clash = docs.withColumns({"part": F.lit("x"), "key": F.lit(1), "words": F.lit(2), "digest": F.lit("d"), "c": F.lit(True)})
    found = {(r["part"], r["filter_order"], r["step"]): r for r in audit.audit(clash, labels).collect()}
    masks = {}
    for key, text, _, source, _ in ROWS:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if key is not None and any(r[0] is not None and r[0] < key and (r[1] or "") == text for r in ROWS) else set()
        masks.setdefault(source or "", []).append((fails, key in (0, 6), key == 0))
    assert len(found) == 600 * len(masks)
    for part, rows in masks.items():
        removed = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                r, gone = found[(part, order, step)], lambda m: bool(m & set(order[: step - 1]))  # noqa: B023
                lost = [x for x in rows if f in x[0] and not gone(x[0])]
                assert (r["removed"], r["good_lost"], r["toxic_lost"]) == (len(lost), sum(x[1] for x in lost), sum(x[2] for x in lost))
                assert r["kept"] == sum(not x[0] & set(order[:step]) for x in rows)
                assert r["redundant"] == sum(f in x[0] and gone(x[0]) for x in rows)
                assert r["unique_fails"] == sum(x[0] == {f} for x in rows)
                removed[f] = removed.get(f, 0) + len(lost)
        assert all(found[(part, o, s)]["shapley"] == removed[o[s - 1]] for o in ("ABCDE", "EDCBA") for s in range(1, 6))
    assert audit.audit(clash.limit(0), labels.limit(0)).count() == 0


def test_matrix_has_one_number_per_word(spark, docs, monkeypatch):
    monkeypatch.setattr(audit, "SHARD_BYTES", 40)
    stored = materialize(audit.shards(docs, "text", ["doc_id"], {}))
    rows = audit.encode(stored, audit.number_words(stored)).collect()
    words = {w for r in ROWS for w in (r[1] or "").split()}
    assert {t for r in rows for t in r["terms"]} == set(range(len(words)))
    assert sum(len(r["rows"]) for r in rows) == len(ROWS)
    assert max(max(r["counts"], default=0) for r in rows) == LONG.split().count("the")


def test_minhash_edges(spark, docs):
    clash = docs.withColumns({"key": F.lit(1), "n": F.lit(2), "digest": F.lit("d"), "node": F.lit(3), "sketch": F.lit(4)})
    rows = minhash.near_copies(clash).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert by[1] == (by[0][0], 0, False) and by[0][2]
    assert all(by[i] == (0, i, True) for i in (2, 3, 4))
    assert by[6] == (6, 6, True) and by[7] == (1, 7, True) and by[None][1:] == (None, True)
    assert minhash.near_copies(clash.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [4, 512])
def test_minhash_components_are_those_of_all_pairs(spark, monkeypatch, unit):
    monkeypatch.setattr(minhash, "UNIT", unit)
    texts = families(5, 5)
    df = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_copies(df).collect()} == brute_groups(texts, 85)


def test_sketches_fill_every_coordinate():
    for size in (1, 2, 10, 300, 5000):
        values = minhash.mixed(minhash.np.arange(size, dtype=minhash.np.uint64))
        assert (minhash._fill([values]) != minhash.np.iinfo(minhash.np.uint64).max).all()
