"""The model hook, stems, several references and hops, on literal rows."""

import math

import pytest

from strandgraph.functions.stemming import stem
from strandgraph.operators import graph as G
from strandgraph.operators import inference as I
from strandgraph.operators import textmetrics as M

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "activate": "activ", "effective": "effect", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "sky": "sky", "at": "at", "enjoyed": "enjoy",
}


def test_stems():
    assert {word: stem(word) for word in STEMS} == STEMS


def test_stemmed_rouge(spark):
    pairs = spark.createDataFrame([(1, "He was running and jumped", "he was run and jumping")], "id int, hyp string, ref string")
    assert M.rouge_l_rows(pairs).first()["rouge_l"] == 1.0
    assert M.rouge_l_rows(pairs, stemmed=False).first()["rouge_l"] == pytest.approx(0.6)


def test_multi_bleu(spark):
    hyps = spark.createDataFrame([(1, "the the the the the the the"), (2, None), (3, "no reference")], "id int, hyp string")
    refs = spark.createDataFrame([(1, "the cat is on the mat"), (1, "there is a cat on the mat"), (2, "a b"), (4, "no hypothesis")], "id int, ref string")
    # Clipped by the reference that has "the" twice; of lengths 6 and 7 the latter is the closest to 7.
    assert M.multi_bleu(hyps, refs, 1).first()["bleu"] == pytest.approx(2 / 8 * math.exp(1 - 9 / 7))
    same = spark.createDataFrame([(1, "one two three four five")], "id int, hyp string")
    assert M.multi_bleu(same, same.selectExpr("id", "hyp AS ref").union(refs)).first()["bleu"] == pytest.approx(1)
    assert M.multi_bleu(hyps.limit(0), refs).first()["bleu"] == 0.0


class Halves:
    """Fails on whole batches with a 13 and gives too few outputs for batches with a 7."""

    def __call__(self, values):
        if 13 in values:
            raise KeyError("unlucky")
        return [v / 2 for v in values if v != 7]


def test_model_hook(spark):
    rows = [(i, i if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, x long").repartition(3)
    found = {r["k"]: (r["output"], r["error"]) for r in I.with_model_output(df, "k", "x", Halves, "double", batch_rows=4).collect()}
    want = {k: (None if x is None else x / 2, None) for k, x in rows}
    want[13] = (None, "KeyError: 'unlucky'")
    want[7] = (None, "ValueError: 0 outputs for 1 inputs")
    assert found == want


def test_model_hook_resumes(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "bb"), (3, None, None), (4, "x", "y")], "k long, a string, b string")
    done = spark.createDataFrame([(1, 99, None), (4, None, "broke"), (8, 5, None)], "k long, output long, error string")

    def make():
        return lambda rows: [len(r["a"] or "") + 10 * len(r["b"] or "") for r in rows]

    found = {r["k"]: (r["output"], r["error"]) for r in I.with_model_output(df, "k", ["a", "b"], make, "long", batch_chars=1, done=done).collect()}
    assert found == {1: (99, None), 2: (20, None), 3: (None, None), 4: (11, None)}
    assert I.with_model_output(df.limit(0), "k", ["a", "b"], make, "long").count() == 0


def test_hops(spark):
    chain = [(f"e{i}", f"n{i}", f"n{i + 1}", "r") for i in range(6)]
    hub = [(f"h{i}", "n1", f"leaf{i}", "r") for i in range(50)]
    edges = spark.createDataFrame(chain + hub + [("loop", "n0", "n0", "r"), ("again", "n1", "n0", "r")], "edge_id string, start_id string, end_id string, rel_type string")
    seeds = spark.createDataFrame([("n0",), ("alone",), (None,)], "node_index string")
    found = {(r["seed"], r["node"]): r["hop"] for r in G.within_hops(edges, seeds, 3).collect()}
    want = {("n0", f"n{i}"): i for i in range(4)} | {("n0", f"leaf{i}"): 2 for i in range(50)} | {("alone", "alone"): 0}
    assert found == want
    names = [f"n{i}" for i in range(7)] + [f"leaf{i}" for i in range(50)]
    nodes = spark.createDataFrame([(n, n, "disease" if n == "n0" else "other") for n in names], "node_index string, node_name string, label string")
    ids = lambda hops: {r["edge_id"] for r in G.subgraph_within(nodes, edges, seeds, hops).collect()}
    assert ids(1) == {"e0", "loop", "again"}
    assert ids(2) == ids(1) | {"e1"} | {f"h{i}" for i in range(50)}
    assert ids(3) == ids(2) | {"e2"}
