"""Document fingerprints from spot signatures, and near-duplicates by them.

A spot is a run of common words (the anchor); its signature is the anchor and the
chain of content words that follow it. Common words lie in running prose, so
menus and other boilerplate leave few spots. The fingerprint is the set of all
signatures of a text, each as eight hex digits of its MD5, sorted and joined.

Everything is DataFrame functions; texts never pass through Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandgraph.llm.sharding import place
from strandgraph.session import materialize

#: Common words of a few languages: they open a spot and are never part of a chain.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their there they this to was were which "
    "will with you "
    "au aux ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas pour que qui sa se ses son sont sur un une "
    "aber als am an auch auf aus bei bis das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht oder "
    "sich sie sind und von vor war wie wird zu zum zur "
    "al como con del el ella en entre era es esta este fue ha la las lo los más muy no para pero por que se si sin su sus un una y"
).split()
ANCHORS = sorted(set(ANCHORS))

#: Content words in a chain.
CHAIN = 2
#: Hex digits of a signature.
WIDTH = 8


def _word(token: Column) -> Column:
    return F.substring_index(token, "+", -1)


def with_fingerprint(df: DataFrame, text: str, name: str, chain: int = CHAIN) -> DataFrame:
    """Add the fingerprint of a text column; null counts as the empty text.

    Words are runs of letters in lower case. A text without any whole spot has one
    signature, that of all its words, so equal texts always have equal fingerprints
    and a text without words has the one of no words. Case and everything between
    words are ignored.
    """
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+")
    # "of the dog ran" becomes the tokens "of+the+dog" and "ran".
    marked = F.transform(words, lambda x: F.when(x.isin(ANCHORS), F.concat(x, F.lit("+"))).when(x == "", "").otherwise(F.concat(x, F.lit(" "))))
    tokens = F.split(F.rtrim(F.array_join(marked, "")), " ")
    step = df.withColumn("_tokens", tokens)

    def signature(token: Column, at: Column) -> Column:
        rest = [F.get("_tokens", at + k) for k in range(1, chain)]
        # the last token may be a run of anchors with no content word
        whole = token.contains("+") & (_word(rest[-1] if rest else token) != "")
        return F.when(whole, F.substring(F.md5(F.concat_ws(" ", token, *map(_word, rest))), 1, WIDTH))

    step = step.withColumn("_spots", F.array_compact(F.transform("_tokens", signature)))
    everything = F.array(F.substring(F.md5(F.array_join("_tokens", " ")), 1, WIDTH))
    spots = F.when(F.size("_spots") > 0, F.array_sort(F.array_distinct("_spots"))).otherwise(everything)
    return step.withColumn(name, F.array_join(spots, "")).drop("_tokens", "_spots")


def signatures(fingerprint: Column) -> Column:
    """The signatures of a fingerprint, sorted."""
    return F.regexp_extract_all(fingerprint, F.lit(f".{{{WIDTH}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; those of very unlike length still give the exact value."""
    shared = F.size(F.array_intersect(signatures(a), signatures(b)))
    both = (F.length(a) + F.length(b)) / WIDTH
    ratio = F.transform(F.array(shared), lambda n: n / (both - n))[0]  # so that the sets are compared once
    return F.when(a == b, 1.0).otherwise(ratio)


def with_next(docs: DataFrame, key: str, text: str, portion: int = 4) -> DataFrame:
    """Add to (key, text, fingerprint) ``head`` and ``next_fingerprint`` of the next document.

    The next document has the next larger key, after the largest the smallest; null
    keys come first. Where a key repeats, all its rows share the next key, and the
    text with the smallest digest stands for a repeated next key. ``head`` is as
    much of the next text as 1 / portion of the longest text of the key. A table of
    one key is followed by itself.

    Texts are shuffled once, by key, and both joins use that exchange; only heads
    and fingerprints (packed to bytes) move a second time. Positions come from prefix sums over the
    keys alone.
    """
    digest = F.unhex(F.sha2(text, 256))
    need = F.floor(F.length(text) / portion)
    keys = docs.groupBy(key).agg(F.max(need).alias("need"), F.min(digest).alias("digest"), F.count(F.lit(1)).alias("size"))
    keys = materialize(place(materialize(keys, "keys"), [key], "size"), "keys")
    repeated = keys.where("size > 1").limit(1).count() > 0
    n = F.lit(max(keys.count(), 1))
    follows = keys.select(F.col(key).alias("next_key"), F.col("digest").alias("next_digest"), "position")
    owners = keys.select(F.col(key).alias("owner"), "need", F.pmod(F.col("position") + 1, n).alias("position"))
    links = materialize(owners.join(follows, "position").drop("position"), "links")
    docs = docs.withColumn("fingerprint", F.unhex("fingerprint"))
    heads = docs.join(links, docs[key].eqNullSafe(links["next_key"])).where(digest == F.col("next_digest") if repeated else F.lit(True))
    heads = heads.select("owner", F.expr(f"left({text}, need)").alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    if repeated:
        heads = heads.dropDuplicates(["owner"])
    both = docs.join(heads, docs[key].eqNullSafe(heads["owner"])).drop("owner")
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "next_fingerprint")})


def near_links(prints: DataFrame, key: str, fingerprint: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (key, class_id) and all links (class_a, class_b, likeness) of at least ``threshold``.

    A class is the documents of one fingerprint; its id is the smallest key, so
    copies never make pairs. Classes are partitioned by set length into bands in
    which lengths grow by at most 1 / threshold: classes that match lie in the same
    or in neighbouring bands. In a band only those are compared that share one of
    the rarest len - ceil(threshold * len) + 1 signatures, which is no loss, and
    only lengths within the threshold. Then the exact likeness decides.
    """
    members = materialize(prints.groupBy(fingerprint).agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    membership = prints.join(members.select(fingerprint, "class_id"), fingerprint).select(key, "class_id")
    sets = members.select("class_id", (F.length(fingerprint) / WIDTH).cast("int").alias("len"), F.explode(signatures(F.col(fingerprint))).alias("sig"))
    often = sets.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = sets.join(often, "sig")  # a signature of one class can't join it to another
    # Rarest first; a signature of one class is rarer than all that are left here.
    alone = F.col("len") - F.count(F.lit(1)).over(W.partitionBy("class_id"))
    place_ = F.row_number().over(W.partitionBy("class_id").orderBy("df", "sig")) + alone
    index = ranked.withColumn("_at", place_).where(F.col("_at") <= F.col("len") - F.ceil(F.col("len") * threshold) + 1)
    band = F.floor(F.log(F.col("len").cast("double")) / math.log(1 / threshold) + 1e-9)
    index = materialize(index.select("class_id", "len", "sig", band.alias("band")), "index")
    left = index.select(F.col("class_id").alias("class_a"), F.col("len").alias("len_a"), "sig", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = index.select(F.col("class_id").alias("class_b"), F.col("len").alias("len_b"), "sig", "band")
    near = (F.col("len_a") >= F.col("len_b") * threshold) & (F.col("len_a") <= F.col("len_b"))
    once = (F.col("len_a") < F.col("len_b")) | (F.col("class_a") < F.col("class_b"))
    pairs = left.join(right, ["sig", "band"]).where(near & once).select("class_a", "class_b").distinct()
    first = members.select(F.col("class_id").alias("class_a"), F.col(fingerprint).alias("_a"))
    second = members.select(F.col("class_id").alias("class_b"), F.col(fingerprint).alias("_b"))
    scored = pairs.join(first, "class_a").join(second, "class_b").withColumn("likeness", likeness(F.col("_a"), F.col("_b")))
    ends = F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")
    return membership, scored.where(F.col("likeness") >= threshold).select(*ends, "likeness")
