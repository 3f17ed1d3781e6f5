"""Weighted fuzzy names beside a plain score over all pairs."""

import random
from functools import lru_cache

import pytest

from strandgraph.operators import fuzzy as Z
from strandgraph.plans import link_queries as Q


@lru_cache(maxsize=None)
def plain_ratio(a, b):
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return 200 * row[-1] / (len(a) + len(b))


def plain_window(a, b):
    """Over all substrings that are as long as the shorter text, or touch an end of the longer one and are shorter."""
    best = 0.0
    for s, l in ((a, b), (b, a)):
        if len(s) > len(l):
            continue
        for i in range(len(l)):
            for j in range(i + 1, min(len(l), i + len(s)) + 1):
                if j - i == len(s) or i == 0 or j == len(l):
                    best = max(best, plain_ratio(s, l[i:j]))
    return best


def plain_score(a, b):
    a, b = " ".join(a.split()), " ".join(b.split())
    if not a or not b:
        return 0.0
    x, y = a.split(), b.split()
    shared = sorted(set(x) & set(y))
    first, second = shared + sorted(set(x) - set(y)), shared + sorted(set(y) - set(x))
    join = " ".join
    apart = max(len(a), len(b)) / min(len(a), len(b))
    if apart < 1.5:
        looks = [plain_ratio(join(sorted(x)), join(sorted(y))), plain_ratio(join(first), join(second))]
        if shared:
            looks += [plain_ratio(join(shared), join(first)), plain_ratio(join(shared), join(second))]
        return max(plain_ratio(a, b), 0.95 * max(looks))
    weight = 0.9 if apart <= 8 else 0.6
    words = 100.0 if shared else max(plain_window(join(sorted(x)), join(sorted(y))), plain_window(join(first), join(second)))
    return max(plain_ratio(a, b), weight * plain_window(a, b), 0.95 * weight * words)


def _texts(seed, count):
    """Names of few letters and words, many of them edited, cut, reordered or repeated."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(14)] + ["pleural", "effusion", "heart", "failure", "of"]
    out = []
    for _ in range(count):
        name = " ".join(r.choice(words) for _ in range(r.randint(1, 4)))
        for _ in range(r.choice([0, 0, 1, 2])):
            at = r.randrange(len(name) + 1)
            name = r.choice([name[:at] + r.choice("abcd ") + name[at:], name[:at] + name[at + 1 :], name[at:] + " " + name[:at], name[: at + 3]])
        out.append(name)
    return out


@pytest.fixture(scope="module")
def names():
    return _texts(1, 170) + ["  spaced   out ", "", " ", "laceration"], _texts(2, 170) + ["out spaced", "", "aeration", "laceration of the heart"]


def _frames(spark, names):
    left = spark.createDataFrame([(n,) for n in names[0]] + [(None,), (names[0][0],)], "entity string")
    right = spark.createDataFrame([(n,) for n in names[1]] + [(None,), (names[1][0],)], "key string")
    return left, right


def test_score(names):
    tidy = lambda n: " ".join(n.split())
    for a, b in zip(names[0] * 4, names[1] + names[1][7:] + names[1][31:] + names[1][88:]):
        assert Z.weighted_ratio(tidy(a), tidy(b)) == pytest.approx(plain_score(a, b))
    assert Z.weighted_ratio("aeration", "laceration") == pytest.approx(200 * 8 / 18)
    assert Z.weighted_ratio("heart failure", "failure heart") == pytest.approx(95)
    assert Z.weighted_ratio("duct", "bile duct stone") == pytest.approx(90)
    assert Z.weighted_ratio("duct", "d" * 40) == pytest.approx(0.6 * 40)  # the window "d" at an end


@pytest.mark.parametrize("cutoff", [86, 88, 92, 96, 100])
def test_no_pair_is_lost(spark, names, cutoff):
    want = {(a, b): s for a in set(names[0]) for b in set(names[1]) if (s := round(plain_score(a, b), 6)) >= cutoff - 1e-9}
    found = {(r["entity"], r["key"]): r["score"] for r in Z.weighted_pairs(*_frames(spark, names), cutoff).collect()}
    assert set(found) == set(want)
    assert found == pytest.approx(want)


@pytest.mark.parametrize("cutoff", [81, 85, 88])
def test_best_key(spark, names, cutoff):
    found = {r["entity"]: (r["key"], r["score"]) for r in Z.weighted_best(*_frames(spark, names), cutoff).collect()}
    want = {}
    for a in set(names[0]):
        score, key = min((-round(plain_score(a, b), 6), b) for b in set(names[1]))
        if -score >= cutoff - 1e-9:
            want[a] = (key, pytest.approx(-score))
    assert found == want


def test_stage_and_bounds(spark, names):
    left, right = _frames(spark, names)
    for cutoff in (80, 101):
        with pytest.raises(ValueError):
            Z.weighted_best(left, right, cutoff)
    with pytest.raises(ValueError):
        Z.weighted_pairs(left, right, 85)
    assert Z.weighted_pairs(left.limit(0), right).count() == 0
    assert Z.weighted_best(left, right.limit(0), 85).count() == 0
    entities = spark.createDataFrame([("the",), ("abnormalities of the duct",), ("lacerations",)], "entity string")
    keys = spark.createDataFrame([("duct", "Duct"), ("laceration", "Laceration"), ("laceration", "Cut"), ("the", "The")], "key string, canonical string")
    assert {(r["entity"], r["canonical"]) for r in Z.weighted_stage(entities, keys).collect()} == {("lacerations", "Cut")}
    assert {r["entity"] for r in Z.weighted_stage(entities, keys, min_ratio=0).collect()} == {"lacerations", "abnormalities of the duct"}


def test_queries_over_whole_tables(spark, folder):
    """link_graph beside all nodes for every fortieth mention."""
    mentions = sorted(r["entity"] for r in Q.entities(spark, folder).collect() if len(r["entity"]) > 3)[::40]
    keys = {r["node_name"].lower(): r["node_name"] for r in Q.near_nodes(spark, folder).collect()}
    want = {}
    for a in mentions:
        score, key = min((-round(Z.weighted_ratio(a, b), 6), b) for b in keys)
        if -score >= 85 - 1e-9:
            want[a] = keys[key]
    found = {r["entity"]: r["canonical"] for r in Q.link_graph(spark, folder).collect()}
    assert {a: found[a] for a in mentions if a in found} == want


def test_names_are_made_once(spark):
    """Candidates look at the names several times; what they come from is not worked out again."""
    frame = lambda column: spark.createDataFrame([("effusion",), ("edema",)], f"{column} string").where(f"length({column}) > 3")
    for found in (Z.weighted_pairs(frame("entity"), frame("key")), Z.weighted_best(frame("entity"), frame("key"), 85.0)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "forms-" in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 2
