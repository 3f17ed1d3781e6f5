"""Weighted fuzzy names: scores that know words and parts, and a join that loses no pair above a cutoff.

The score of two texts is the best of four looks at them, each from 0 to 100:
the whole texts (twice the longest common subsequence over both lengths), their
words in sorted order and as sets (times 0.95), and, for lengths at least 1.5
times apart, the best window of the longer text (times 0.9; 0.6 beyond 8 times)
in place of the sorted words. Runs of blanks count as one, the ends are trimmed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.session import materialize

# Fixed values of the score.
WORDS = 0.95  # weight of looks at words
PART = 0.9  # weight of windows ...
SMALL_PART = 0.6  # ... in far longer texts
UNLIKE_LENGTHS = 1.5  # from here on windows are compared
FAR_LENGTHS = 8.0  # above this, windows weigh less
DIGITS = 6  # scores are rounded before they are compared

#: What one common word is worth if the lengths are 1.5 to 8 times apart.
SHARED_WORD = 100 * WORDS * PART
#: Longest piece of the index.
LONGEST_PIECE = 6
ROUNDING = 1e-9


# --- the score -----------------------------------------------------------------


def _common(a: str) -> Callable[[str], int]:
    """Longest common subsequence with ``a``, bit-parallel."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | (1 << i)
    full = (1 << len(a)) - 1

    def length(b: str) -> int:
        row = full
        for letter in b:
            met = row & places.get(letter, 0)
            row = ((row + met) | (row - met)) & full
        return len(a) - row.bit_count()

    return length


def ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 100.0 if a == b else 200.0 * _common(a)(b) / (len(a) + len(b))


def window_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of its length in the longer one, cut at the ends."""
    if not a or not b:
        return 0.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b) if len(a) < len(b) else _windows(b, a)


def _windows(short: str, long: str) -> float:
    if short in long:
        return 100.0
    n, common = len(short), _common(short)
    parts = {long[max(start, 0) : start + n] for start in range(1 - n, len(long))}
    return max(200.0 * common(part) / (n + len(part)) for part in parts)


def _split(a: str, b: str) -> tuple[str, str, str, str, str]:
    """Sorted words of both texts, then the common words and those of one text only."""
    mine, other = a.split(" "), b.split(" ")
    first, second = set(mine), set(other)
    lists = sorted(mine), sorted(other), sorted(first & second), sorted(first - second), sorted(second - first)
    return tuple(" ".join(words) for words in lists)


def word_ratio(a: str, b: str) -> float:
    mine, other, shared, only_a, only_b = _split(a, b)
    best = ratio(mine, other)
    if not shared:
        return max(best, ratio(only_a, only_b))
    if not only_a or not only_b:
        return 100.0
    longer_a, longer_b = f"{shared} {only_a}", f"{shared} {only_b}"
    return max(best, ratio(shared, longer_a), ratio(shared, longer_b), ratio(longer_a, longer_b))


def word_window_ratio(a: str, b: str) -> float:
    mine, other, shared, only_a, only_b = _split(a, b)
    return 100.0 if shared else max(window_ratio(mine, other), window_ratio(only_a, only_b))


def weighted_ratio(a: str, b: str) -> float:
    """The score of two texts with single blanks; an empty text is like nothing."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    one_word = " " not in a and " " not in b  # the looks at words are those at the texts, and weigh less
    if apart < UNLIKE_LENGTHS:
        return best if one_word else max(best, WORDS * word_ratio(a, b))
    weight = PART if apart <= FAR_LENGTHS else SMALL_PART
    if one_word:
        return max(best, weight * window_ratio(a, b))
    return max(best, weight * window_ratio(a, b), WORDS * weight * word_window_ratio(a, b))


def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(weighted_ratio(x, y), DIGITS) for x, y in zip(a, b)], dtype="float64")


# --- candidates ----------------------------------------------------------------


#: Bits of a letter signature.
BITS = 64


def _signature(text: Column) -> Column:
    """A bit for every letter and its number among equal ones, blanks aside; some share a bit."""
    letters = F.filter(F.split(text, ""), lambda x: (x != " ") & (x != ""))

    def places(x: Column) -> Column:
        numbers = F.sequence(F.lit(1), F.size(F.filter(letters, lambda y: y == x)))
        return F.transform(numbers, lambda i: F.pmod(F.xxhash64(x, i), F.lit(BITS)).cast("int"))

    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    return F.aggregate(F.flatten(F.transform(F.array_distinct(letters), places)), F.lit(0).cast("long"), lambda bits, n: bits.bitwiseOR(bit(n)))


def _forms(df: DataFrame, name: str, side: int) -> DataFrame:
    """side, name, text, words, l (length), u (length of the distinct words joined), signatures, of every name but blank ones.

    ``bits`` are those of all letters, ``own`` those of the distinct words.
    """
    text = F.trim(F.regexp_replace(name, r"\s+", " "))
    rows = df.select(F.lit(side).alias("side"), F.col(name).alias("name"), text.alias("text")).where(F.col("text") != "").distinct()
    words = rows.withColumn("words", F.split("text", " "))
    joined = F.array_join(F.array_distinct("words"), " ")
    return words.withColumns({"l": F.length("text"), "u": F.length(joined), "bits": _signature(F.col("text")), "own": _signature(joined)})


def _stored_forms(left: DataFrame, right: DataFrame) -> DataFrame:
    """The forms of left(entity) and right(key), written once: candidates look at them four times."""
    return materialize(_forms(left, "entity", 0).unionByName(_forms(right, "key", 1)), "forms")


def _cut(words: Column, width: Column) -> Column:
    """Disjoint pieces of ``width`` letters, none across two words."""

    def pieces(word: Column) -> Column:
        starts = F.sequence(F.lit(1), F.floor(F.length(word) / width).cast("int"))
        return F.transform(starts, lambda i: F.substring(word, (i - 1) * width + 1, width))

    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= width), pieces))


def _count(words: Column, width: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.floor(F.length(w) / width).cast("int"))


def _edits(share: float, length: str) -> Column:
    return F.floor(F.col(length) * share + ROUNDING).cast("int")


def _pieces(forms: DataFrame, cutoff: float) -> DataFrame:
    """kind, side, name, text, l, u, need, piece: ``need`` rarest of the pieces find every partner of the kind.

    A score from the cutoff on leaves room for few inserted and deleted letters, and each
    spoils one piece at most. So of more pieces than edits one is whole inside a word of
    the partner, in whatever order its words stand. Kinds: lengths are alike (``like``, asked
    by the text whose distinct words are shorter), a window of the longer text (``part``,
    asked by the shorter text), a window of its distinct words (``words``).
    """

    def edits_of(least: float) -> float:  # of a text to a partner as long as possible
        return 2 * (1 - least) / least

    whole, part, words = cutoff / 100, cutoff / 100 / PART, cutoff / SHARED_WORD
    distinct, all_words = F.array_distinct("words"), F.col("words")
    widths = F.array(*[F.lit(n) for n in range(LONGEST_PIECE, 0, -1)])

    def kind(label: str, needs: Sequence[tuple[Column, Column]], of: Column) -> Column:
        fits = lambda n: reduce(lambda x, y: x & y, [_count(w, n) >= need for w, need in needs])
        width = F.element_at(F.filter(widths, fits), 1)
        return F.struct(F.lit(label).alias("kind"), of.alias("of"), needs[0][1].alias("need"), width.alias("width"))

    whole_need, distinct_need = _edits(edits_of(whole), "l") + 1, _edits(edits_of(whole / WORDS), "u") + 1
    kinds = [kind("like", [(all_words, whole_need), (distinct, distinct_need)], all_words)] if whole <= 1 else []
    if part <= 1:
        kinds.append(kind("part", [(all_words, _edits(2 * (1 - part), "l") + 1)], all_words))
    if words <= 1:
        kinds.append(kind("words", [(distinct, _edits(2 * (1 - words), "u") + 1)], distinct))
    asked = forms.select("side", "name", "text", "l", "u", "own", (F.size("words") > F.size(distinct)).alias("repeats"), F.explode(F.array(*kinds)).alias("k"))
    listed = asked.select("side", "name", "text", "l", "u", "own", "repeats", "k.kind", "k.need", F.explode(_cut(F.col("k.of"), F.col("k.width"))).alias("piece"))
    # With a word repeated, the distinct words need pieces of their own: all are asked.
    return listed.withColumn("need", F.when(F.col("repeats"), F.col("l")).otherwise(F.col("need"))).drop("repeats")


def _grams(forms: DataFrame) -> DataFrame:
    """side, name, text, l, u, piece: every distinct substring of a word, up to the longest piece."""

    def of_width(word: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - (n - 1))
        return F.when(F.length(word) >= n, F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    found = F.transform("words", lambda w: F.concat(*[of_width(w, n) for n in range(1, LONGEST_PIECE + 1)]))
    return forms.select("side", "name", "text", "l", "u", "bits", F.explode(F.array_distinct(F.flatten(found))).alias("piece"))


def _missing(kind: Column, l: Column, u: Column, other: Column, cutoff: float) -> Column:
    """How many letters of the asking text the partner may lack, which its length may narrow."""
    whole, part, words = cutoff / 100, min(1.0, cutoff / 100 / PART), min(1.0, cutoff / SHARED_WORD)
    at_most = lambda least, n: n * (2 * (1 - least) / (2 - least))
    like = F.greatest(l - (l + other) * (whole / 2), at_most(min(1.0, whole / WORDS), u))
    return F.when(kind == "like", like).when(kind == "part", at_most(part, l)).otherwise(at_most(words, u)) + ROUNDING


def _met(forms: DataFrame, cutoff: float) -> DataFrame:
    """entity, key, a, b (their texts): every pair that can reach the cutoff, beside pairs of one common word."""
    grams = _grams(forms)
    common = grams.groupBy((1 - F.col("side")).alias("side"), "piece").agg(F.count(F.lit(1)).alias("n"))
    pieces = _pieces(forms, cutoff).join(common, ["side", "piece"], "left")
    row = ["kind", "side", "name", "text", "l", "u", "own", "need"]
    rare = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))), 1, F.first("need"))
    chosen = pieces.groupBy(*row).agg(rare.alias("rare")).select(*row, F.explode(F.array_distinct("rare")).alias("r")).where("r.n > 0")
    p = chosen.select(*row, F.col("r.piece").alias("piece")).alias("p")
    g = grams.alias("g")
    l, other = F.col("p.l"), F.col("g.l")
    short, long = F.least(l, other), F.greatest(l, other)
    like = long < short * UNLIKE_LENGTHS
    within = ~like & (long <= short * FAR_LENGTHS)
    asks = (F.col("p.u") < F.col("g.u")) | ((F.col("p.u") == F.col("g.u")) & (F.col("p.side") == 0))
    fits = F.when(F.col("kind") == "like", like & asks).when(F.col("kind") == "part", within & (l < other)).otherwise(within & asks)
    # Letters without a partner show in the signatures, so most pairs end here.
    lacks = F.bit_count(F.col("p.own").bitwiseAND(F.bitwise_not(F.col("g.bits"))))
    fits &= lacks <= _missing(F.col("kind"), l, F.col("p.u"), other, cutoff)
    met = p.join(g, (F.col("p.piece") == F.col("g.piece")) & (F.col("p.side") == 1 - F.col("g.side")) & fits)
    mine = F.col("p.side") == 0
    sides = [F.when(mine, F.col(f"p.{c}")).otherwise(F.col(f"g.{c}")) for c in ("name", "text")]
    others = [F.when(mine, F.col(f"g.{c}")).otherwise(F.col(f"p.{c}")) for c in ("name", "text")]
    return met.select(sides[0].alias("entity"), others[0].alias("key"), sides[1].alias("a"), others[1].alias("b")).distinct()


def _one_word(left: DataFrame, right: DataFrame) -> DataFrame:
    """entity, key, a, b: for every entity the first key with a word of it and a length 1.5 to 8 times apart.

    Keys are reduced to the first one per word and length before they meet the entities,
    so a frequent word costs no more rows than there are lengths.
    """
    worded = lambda df: df.select("name", "text", "l", F.explode(F.array_distinct("words")).alias("word"))
    first = worded(right).groupBy("word", F.col("l").alias("kl")).agg(F.min(F.struct(F.col("name").alias("key"), F.col("text").alias("b"))).alias("k"))
    short, long = F.least("l", "kl"), F.greatest("l", "kl")
    met = worded(left).join(first, "word").where((long >= short * UNLIKE_LENGTHS) & (long <= short * FAR_LENGTHS))
    return met.groupBy(F.col("name").alias("entity")).agg(F.first("text").alias("a"), F.min("k").alias("k")).select("entity", "k.key", "a", "k.b")


def _scored(met: DataFrame, cutoff: float) -> DataFrame:
    score = F.pandas_udf(_scores, "double")("a", "b")
    return met.select("entity", "key", score.alias("score")).where(F.col("score") >= cutoff - ROUNDING)


def _checked(cutoff: float) -> None:
    if not 80 < cutoff <= 100:
        raise ValueError("the cutoff must be over 80 and at most 100")


def weighted_pairs(left: DataFrame, right: DataFrame, cutoff: float = 88.0) -> DataFrame:
    """left(entity), right(key) -> entity, key, score: all pairs with a weighted score of at least the cutoff.

    No pair is lost: see ``_pieces``. Null and blank names have no pairs, repeated ones count
    once. The cutoff must be over what one common word is worth (85.5), or nearly all texts
    with a common word would be pairs; ``weighted_best`` goes below it.
    """
    _checked(cutoff)
    if cutoff <= SHARED_WORD:
        raise ValueError(f"the cutoff must be over {SHARED_WORD:g}")
    return _scored(_met(_stored_forms(left, right), cutoff), cutoff)


def weighted_best(left: DataFrame, right: DataFrame, cutoff: float = 88.0) -> DataFrame:
    """left(entity), right(key) -> entity, key, score: the best key from the cutoff (over 80) on, ties to the first key."""
    _checked(cutoff)
    forms = _stored_forms(left, right)
    met = _met(forms, cutoff)
    if cutoff <= SHARED_WORD:
        # Where nothing is better, the first key with a common word is the best one.
        met = met.unionByName(_one_word(forms.where("side = 0"), forms.where("side = 1")))
    best = _scored(met, cutoff).groupBy("entity").agg(F.min(F.struct((-F.col("score")).alias("s"), "key")).alias("b"))
    return best.select("entity", "b.key", (-F.col("b.s")).alias("score"))


def weighted_stage(entities: DataFrame, keys: DataFrame, cutoff: float = 88.0, min_len: int = 4, min_ratio: float = 0.7) -> DataFrame:
    """entities(entity), keys(key, canonical) -> entity, canonical: a stage for ``linking.link`` by the weighted score.

    Shorter entities than ``min_len`` are skipped; an entity whose best key is shorter than
    ``min_ratio`` of it gets none (0 turns this off). Of several names of a key the first counts.
    """
    best = weighted_best(entities.where(F.length("entity") >= min_len), keys, cutoff)
    kept = best.where(F.length("key") >= min_ratio * F.length("entity"))
    names = keys.groupBy("key").agg(F.min("canonical").alias("canonical"))
    return kept.join(names, "key").select("entity", "canonical")
