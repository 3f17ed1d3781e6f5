"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strandgraph.llm import bpe, components, hilbert, hyperlang, minhash, mixing, pieces, sharding, simhash, spotsigs, tokencounts, toxicity, warc
from strandgraph.session import materialize, shared_path

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "the long story of a word " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the river ran to the sea and the boats of the town lay on the sand in the evening sun"
ROWS = [
    (0, PROSE, "en", "a", 1),
    (1, PROSE, "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n", "fr", "b", 3),
    (5, "été où la mer était dans le ciel et les oiseaux sur la plage", "fr", None, 1),
    (6, LONG, "en", "b", 1),
    (6, LONG, "en", "b", 1),
    (None, "le chat dort sur la table de la cuisine", "fr", "b", 1),
    (7, "x", None, "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(ROWS, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(df, n=len(ROWS)):
    rows = df.collect()
    assert len(rows) == n
    return rows


# --- spot signatures ---------------------------------------------------------


def test_spots_edges(docs, empty):
    prints = spotsigs.with_fingerprint(docs, "text", "fingerprint")
    by_text = {}
    for row in same_rows(prints):
        by_text.setdefault(row["text"], set()).add(row["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[None] == by_text[""] == by_text[" \t\n"]
    assert len(by_text[LONG].pop()) == 8 * len(set(["of+a", "the"]))  # two different spots, however often
    assert spotsigs.with_fingerprint(empty, "text", "f").count() == 0


def test_spots_ignore_case_and_signs(spark):
    df = spark.createDataFrame([("The cat sat on the mat today.",), ("the CAT -- sat on, the mat today",)], "text string")
    assert len({r["f"] for r in spotsigs.with_fingerprint(df, "text", "f").collect()}) == 1


def test_next_document(docs, empty):
    whole = spotsigs.with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "fingerprint")
    rows = same_rows(spotsigs.with_next(whole, "doc_id", "text"))
    heads = {(r["doc_id"], r["text"]): r["head"] for r in rows}
    assert heads[(0, PROSE)] == PROSE[: len(PROSE) // 4]
    assert heads[(5, ROWS[5][1])] == LONG[: len(ROWS[5][1]) // 4]
    assert heads[(7, "x")] == ""
    assert heads[(None, ROWS[8][1])] == PROSE[: len(ROWS[8][1]) // 4]
    nothing = spotsigs.with_fingerprint(empty.select("doc_id", "text"), "text", "fingerprint")
    assert spotsigs.with_next(nothing, "doc_id", "text").count() == 0


def test_spot_links(spark):
    random.seed(4)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    texts = []
    for _ in range(12):
        words = [w for _ in range(60) for w in ("the", random.choice(vocabulary), random.choice(vocabulary))]
        texts += [" ".join(words), " ".join(words), " ".join(words[:-3]), " ".join(words[6:]), " ".join(words[:90])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = materialize(spotsigs.with_fingerprint(df, "text", "f").select("doc_id", "f"))
    members, links = spotsigs.near_links(prints, "doc_id", "f", 0.8)
    sets = {r["doc_id"]: frozenset(r["f"][i : i + 8] for i in range(0, len(r["f"]), 8)) for r in prints.collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {i: first[s] for i, s in sets.items()}
    expected = set()
    for a, i in first.items():
        for b, j in first.items():
            if i < j and len(a & b) / len(a | b) >= 0.8:
                expected.add((i, j))
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} == expected
    assert expected


# --- toxicity, language ------------------------------------------------------


def test_toxicity_edges(spark, docs, empty):
    clean = [(100 + i, f"{PROSE} number {i}", 0) for i in range(40)]
    bad = [(200 + i, f"{PROSE} you {' '.join(['utter fool'] * (1 + i % 5))}", 1) for i in range(20)]
    corpus = spark.createDataFrame([r[:2] for r in clean + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in clean + bad] + [(None, 1), (100, None), (200, 1)], "doc_id long, toxic int")
    model = toxicity.train(corpus, labels)
    assert model.cuts == sorted(model.cuts)
    known = {r["doc_id"]: r for r in toxicity.predict(corpus, "text", model).collect()}
    assert all((known[r[0]]["toxic_chance"] >= 0.5) == bool(r[2]) for r in clean + bad)
    assert known[204]["severity"] > known[200]["severity"] > known[100]["severity"]
    rows = same_rows(toxicity.predict(docs, "text", model))
    assert all(r["toxic_chance"] < 0.5 and r["grade"] == 0 for r in rows)
    assert toxicity.predict(empty, "text", model).count() == 0
    nothing = toxicity.train(empty, labels.where("toxic = 2"))
    assert all(r["severity"] == 0 for r in same_rows(toxicity.predict(docs, "text", nothing)))
    same = toxicity.train(corpus.union(corpus), labels)
    assert same.weights.keys() == model.weights.keys()


def test_language_edges(docs, empty):
    profiles = hyperlang.train(docs, "text", "lang", "doc_id")
    assert profiles.names == ["en", "fr"]
    by_text = {r["text"]: r for r in same_rows(hyperlang.predict(docs, "text", profiles, keep=True))}
    assert by_text[PROSE]["lang_pred"] == by_text[LONG]["lang_pred"] == "en"
    assert by_text[ROWS[5][1]]["lang_pred"] == by_text[ROWS[8][1]]["lang_pred"] == "fr"
    for text in (None, "", " \t\n"):
        assert (by_text[text]["lang_pred"], by_text[text]["score"]) == ("und", 0.0)
    assert hyperlang.predict(empty, "text", profiles).count() == 0
    none = hyperlang.train(empty, "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in same_rows(hyperlang.predict(docs, "text", none))} == {"und"}


def test_bundle_is_the_plain_sum():
    letters = hyperlang.Letters(64)
    got = hyperlang.bundle(["Ab c!", "été", "12 3", ""], letters)

    def plain(text):
        total = np.zeros(64)
        space = np.zeros(64, dtype=np.int8)
        del space
        padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in padded:
            padded = padded.replace("  ", " ")
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            if b != " ":
                x, y, z = (letters[0 if ch == " " else ord(ch)].astype(int) for ch in (a, b, c))
                total += np.roll(x, 2) * np.roll(y, 1) * z
        return total

    for row, text in zip(got, ["Ab c!", "été", "12 3", ""]):
        assert np.array_equal(row, plain(text))


# --- mixing, sharding --------------------------------------------------------


def test_mixing_edges(spark, docs, empty):
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("key"), "source", F.length("text").cast("long").alias("size"))
    rows = materialize(rows.fillna(0, ["size"]))
    mixed = same_rows(mixing.balance(rows, [5, 2, 1]))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    total = sum(r["size"] for r in mixed)
    targets = {r["source_size"]: r["target"] for r in mixed}
    assert sum(targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s for s, t in targets.items())
    none = materialize(rows.limit(0))
    assert mixing.balance(none, [5, 2, 1]).count() == 0
    assert all(r["taken"] == 0 for r in mixing.balance(materialize(rows.withColumn("size", F.lit(0).cast("long"))), [1]).collect())


def test_sharding_edges(spark, docs, empty):
    def shard(df, n):
        return sharding.shard_by_bytes(materialize(sharding.text_sizes(df)), "doc_id", "size", "digest", n).collect()

    assert shard(empty, 8) == []
    rows = shard(docs, 3)
    assert len(rows) == len(ROWS)
    for k in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    hot = spark.createDataFrame([(i, "same words" if i % 3 == 0 else f"other {i % 7} words") for i in range(3000)], "doc_id long, text string")
    rows = shard(hot.repartition(5), 8)
    sizes = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)  # a third of all rows are one group, which is split
    few = spark.createDataFrame([(i, f"text {i % 40} " + "y" * (i % 40)) for i in range(80)], "doc_id long, text string")
    rows = shard(few, 4)
    groups = {}
    for r in rows:
        groups.setdefault(bytes(r["digest"]), set()).add(r["shard"])
    largest = max(r["size"] for r in rows)
    whole = {}
    for r in rows:
        whole[bytes(r["digest"])] = whole.get(bytes(r["digest"]), 0) + r["size"]
    assert all(len(g) == 1 for d, g in groups.items() if whole[d] <= largest)


# --- near copies -------------------------------------------------------------


def test_fingerprint_is_the_plain_one():
    text = "One two THREE two Three ÄÖ four"
    words = ["one", "two", "three", "two", "three", "ÄÖ", "four"]
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]), seed=42).intdigest() for i in range(5)]
    plain = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 5)
    assert simhash.fingerprint(text, 3) == plain
    assert simhash.fingerprint(" a  B\n", 3) == xxhash.xxh64("a b", seed=42).intdigest()
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == 0


@pytest.mark.parametrize("radius", [2, 3])
@pytest.mark.parametrize("crowd", [10**9, 3])
def test_links_of_fingerprints(spark, radius, crowd):
    random.seed(radius)
    base = [random.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:
        for _ in range(8):
            prints.add(b ^ sum(1 << i for i in random.sample(range(64), random.randint(1, 4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = materialize(spark.createDataFrame([(p,) for p in signed], "print long"))
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(df, radius, crowd).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and (a ^ b & (1 << 64) - 1).bit_count() <= radius}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= radius}
    assert got <= want
    assert closed(got, signed) == closed(want, signed)
    if crowd > len(signed):
        assert got == want


def test_whole_links_do_not_depend_on_crowd(spark):
    """0, 1, 2, 4 and so on agree outside the same three bits; every pair of them comes, not only those with the smallest."""
    df = materialize(spark.createDataFrame([(p,) for p in [*range(8), 1 << 40, -1]], "print long"))
    small, large = ({frozenset((r["a"], r["b"])) for r in simhash.links(df, 3, crowd, whole=True).collect()} for crowd in (1, 10**9))
    assert small == large
    assert len(small) == 28 + 7  # all pairs of 0 to 7, and the other with those of at most two bits
    assert frozenset((1, 2)) in small


def closed(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for link in links:
        a, b = (root(x) for x in link)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    random.seed(9)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(100)]
    other = [(random.randint(2000, 2300), random.randint(2000, 2300)) for _ in range(200)]
    links = chain + star + other + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == closed([x for x in links if x[0] != x[1]], nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_components_edges(docs, empty):
    rows = same_rows(simhash.near_components(docs, "doc_id", "text"))
    by = {(r["doc_id"], r["print"]): r["component_id"] for r in rows}
    blank = simhash.fingerprint("", 3)
    assert {by[(i, blank)] for i in (2, 3, 4)} == {2}
    assert {v for (i, _), v in by.items() if i in (0, 1)} == {0}
    assert {v for (i, _), v in by.items() if i == 6} == {6}
    assert simhash.near_components(empty, "doc_id", "text").count() == 0


def test_one_of_each(spark, docs, empty):
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 2, 5, 6, 7]
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert simhash.one_of_each(empty).count() == 0
    words = [f"word{i}" for i in range(900)]
    near = [" ".join(words), " ".join(words + ["tail"]), " ".join(words[:450] + ["extra"] + words[450:]), " ".join(words[::-1])]
    df = materialize(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == [0, 3]


def shingles(text, words=5):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_groups(texts, percent):
    """Root of each text over all pairs whose shingles share at least this much of their union."""
    sets = [shingles(t) for t in texts]
    links = {(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    return closed(links, range(len(texts)))


def families(seed, edits):
    """Texts edited apart from a base, so that some are linked to many others, some to one and some to none."""
    random.seed(seed)
    texts = []
    for family in range(4):
        base = [f"w{family}x{i}" for i in range(200)]
        for _ in range(25):
            words = list(base)
            for at in random.sample(range(200), random.randint(0, edits)):
                words[at] = f"e{random.getrandbits(40)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("one_print", [False, True])
@pytest.mark.parametrize("unit", [3, 512])
def test_copies_are_those_of_all_pairs(spark, monkeypatch, one_print, unit):
    """Also with all texts under one fingerprint, and with buckets cut into many units."""
    texts = families(12, 6)
    if one_print:
        monkeypatch.setattr(simhash, "fingerprint", lambda text, words: 7)
    monkeypatch.setattr(minhash, "UNIT", unit)
    roots = brute_groups(texts, 80)
    assert len(set(roots.values())) > 8  # some edits are too many
    df = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    kept = [r["doc_id"] for r in simhash.one_of_each(df).collect()]
    assert sorted(kept) == sorted(set(roots.values()))


# --- nearest neighbours ------------------------------------------------------


def test_hilbert_curve_is_one():
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = hilbert.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(side**dims))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()  # neighbours on the curve are neighbours in space


def test_nearest_edges(spark):
    schema = "vec_id long, embedding array<float>"
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)]
    odd = [(300, None), (400, [0.0, 0.0, 0.0]), (500, [nan, 1.0, 1.0]), (600, [inf, 1.0, 1.0]), (700, [None, 1.0, 1.0]), (800, [1.0]), (None, [1.0, 1.0, 1.0]), (0, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows + odd, schema)
    got = hilbert.nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, window=1.0).collect()
    points = {i: np.array(v) for i, v in rows}
    for query in (0, 100, 200):
        away = sorted((np.sqrt(((points[i] - points[query]) ** 2).sum()), i) for i in points if i != query)[:10]
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == query)
        assert [m[2] for m in mine] == [i for _, i in away]
    assert {r["query_id"] for r in got} == {0, 100, 200}
    one = spark.createDataFrame([(0, [1.0, 2.0])], schema)
    assert hilbert.nearest(one, "vec_id", "embedding", F.lit(True)).count() == 0
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], schema)
    assert hilbert.nearest(few, "vec_id", "embedding", F.col("vec_id") == 0).count() == 3
    assert hilbert.nearest(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


def test_nearest_with_a_third_equal(spark, monkeypatch):
    """A query inside a run of equal vectors sees the smallest ids of the run, one beside it the rows beyond it."""
    draw = np.random.default_rng(5)
    points = {i: ([1.0, 2.0, 3.0] if i % 3 == 0 else [float(x) for x in draw.integers(-40, 40, 3)]) for i in range(300)}
    points[1] = [1.0, 2.0, 3.5]
    df = spark.createDataFrame(list(points.items()), "vec_id long, embedding array<float>")
    monkeypatch.setattr(hilbert, "BLOCK", 8)
    got = hilbert.nearest(df, "vec_id", "embedding", F.col("vec_id").isin(0, 1, 297), k=5, window=0.05).collect()
    mine = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 1, 297)}
    assert mine[297] == [(i, 0.0) for i in (0, 3, 6, 9, 12)]
    assert mine[0] == [(i, 0.0) for i in (3, 6, 9, 12, 15)]
    assert mine[1] == [(i, 0.5) for i in (0, 3, 6, 9, 12)]


# --- pieces ------------------------------------------------------------------


def tricky():
    random.seed(2)
    letters = "aethins ▁ \n.,;rouldé1日\r)"
    made = ["".join(random.choice(letters) for _ in range(random.randint(1, 90))) for _ in range(1500)]
    return made + ["", " ", "   ", "\n\n a\n", "<s> </s> <unk> <0x0A>", "▁a▁▁b", " " * 40 + "x", "x" * 3000, "🙂👍🏽", "\x00\x01 z", ");\r\n"]


def test_encoding_is_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = pieces.load(MODEL)
    encoder = bpe.Encoder(model)
    for text in tricky():
        ids = library.encode(text)
        assert encoder.encode(text) == ids
        assert bpe.decode(ids, model) == library.decode(ids)


def test_encoding_edges(docs, empty):
    model = pieces.load(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    clash = docs.withColumn("n_pieces", F.lit(1))
    for row in same_rows(bpe.with_tokens(clash.select("doc_id", "n_pieces", "text"), "text", model, decoded=True, ids=True)):
        assert row["n_tokens"] == len(row["token_ids"])
        assert library.decode(row["token_ids"]) == row["decoded_text"]
    assert bpe.with_tokens(empty, "text", model).count() == 0


def test_unigram_counts_are_the_library():
    """Beside the library with the same pieces as a unigram model; scores are cut so that its single precision is exact."""
    import dataclasses

    from sentencepiece import sentencepiece_model_pb2 as proto

    message = proto.ModelProto()
    with open(MODEL, "rb") as file:
        message.ParseFromString(file.read())
    message.trainer_spec.model_type = 1
    for piece in message.pieces:
        if piece.type == pieces.NORMAL:
            piece.score = max(piece.score, -32000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=message.SerializeToString())
    model = pieces.load(MODEL)
    model = dataclasses.replace(model, scores={k: max(v, -32000.0) for k, v in model.scores.items()})
    trie = tokencounts.Trie(model)
    for text in tricky()[:600] + [PROSE, ROWS[5][1]]:
        assert sum(trie.tokens(word) for word in model.segments(text)) == len(library.encode(text))


def test_count_edges(docs, empty):
    model = pieces.load(MODEL)
    rows = same_rows(tokencounts.with_counts(docs, "text", model))
    blank = {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)}
    assert blank == {0}
    assert len({r["n_tokens"] for r in rows if r["doc_id"] == 6}) == 1
    assert tokencounts.with_counts(empty, "text", model).count() == 0


# --- archives ----------------------------------------------------------------


def test_archive(spark):
    warc.register(spark)
    body, other = "<p>" + "same page " * 30, "<p>é" * 60
    rows = [(5, "http://a/", body), (3, "http://b/\r\nX: y", body), (9, None, body), (None, "u", body), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", other), (8, "u", other * 400)]
    pages = spark.createDataFrame(rows + [(3, "http://b/", body)], "page_id long, url string, html string")
    path = shared_path(spark, "archive")
    warc.as_records(pages, "page_id", "url", "html").repartition(2).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    got = [(r["record_type"], r["record_id"], r["refers_to"], r["payload_length"]) for r in back.collect()]
    assert len(got) == 11
    assert sorted(g[1] for g in got if g[0] == "revisit" and g[1]) == ["<urn:page:5>", "<urn:page:9>"]
    assert {g[2] for g in got if g[0] == "revisit"} == {"<urn:page:3>"}
    full = {warc_key: bytes(p) for warc_key, p in back.where("record_type = 'response'").select("record_id", "payload").collect()}
    assert full["<urn:page:8>"].decode() == other * 400
    assert full["<urn:page:4>"] == full["<urn:page:6>"] == b""
    plan = back.where("record_type = 'revisit' AND payload_length > 5")._jdf.queryExecution().executedPlan().toString()
    assert "record_type" in plan
    one = spark.read.format("warc").option("splitbytes", 200).load(path).where("record_id IN ('<urn:page:7>', '<urn:page:8>')")
    assert one.count() == 2
    assert spark.read.format("warc").option("splitbytes", 100).load(path).count() == 11
    none = shared_path(spark, "archive")
    warc.as_records(pages.limit(0), "page_id", "url", "html").write.format("warc").mode("append").save(none)
    assert spark.read.format("warc").load(none).count() == 0


def test_foreign_archive(spark, tmp_path):
    import gzip

    warc.register(spark)
    plain = b"".join(
        b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, i, len(body), body)
        for i, (kind, body) in enumerate([(b"warcinfo", b"software: x\r\n"), (b"resource", b"hello \r\n\r\nWARC/1.0 inside"), (b"resource", b"")])
    )
    (tmp_path / "a.warc").write_bytes(plain)
    parts = plain.split(b"WARC/1.0\r\n")[1:]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.0\r\n" + p) for p in parts))
    rows = spark.read.format("warc").load(str(tmp_path)).where("record_type = 'resource'").collect()
    assert sorted(bytes(r["payload"]) for r in rows) == [b"", b"", b"hello \r\n\r\nWARC/1.0 inside", b"hello \r\n\r\nWARC/1.0 inside"]


# --- pipeline ----------------------------------------------------------------


def test_pipeline_small(spark, folder, docs):
    """Every stage on a table with null ids, repeated rows and columns that clash with those the operators add."""
    clash = materialize(docs.withColumns({"row": F.lit(1), "copies": F.lit("x"), "lang_pred": F.lit(0), "severity": F.lit(2), "key": F.lit(3), "digest": F.lit(4), "print": F.lit(5)}))
    columns, counts = clash.columns, [clash.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, clash, folder))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        counts.append(out.count())
        clash = out
    assert counts[1] == 7 and counts[2] == 7  # the blank texts go, nothing is toxic
    assert counts[3] == 5  # copies go


def test_pipeline_is_its_stages(spark, folder):
    """run() beside the same decisions taken from the operators' own results on the small table."""
    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, folder))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r["doc_id"] for r in got} <= texts.keys()
    for row in got:
        assert row["token_ids"] == library.encode(texts[row["doc_id"]])
    copies = {}
    for row in got:
        copies[row["doc_id"]] = copies.get(row["doc_id"], 0) + 1
    assert max(copies.values()) <= 3
