"""Multi-turn conversations: checks, rendering in five styles, masks and lengths.

A conversation is one record (an ordered array of turns); it is gathered by its
id once and everything else happens inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandgraph.functions import text as t

STYLES = ("SINGLE", "TWO", "MPT", "LLAMA_2", "PLAIN")
IMAGE_LENGTH = 128


def turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, turns ARRAY<STRUCT<role, text>> in turn order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return conversations.groupBy("conv_id").agg(
        F.transform(ordered, lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text"))).alias("turns")
    )


def drop_leading_non_human(conv: DataFrame, human: str = "user") -> DataFrame:
    """Remove a first turn that is not the human's and add ``alternates``.

    ``alternates`` tells whether the rest is human, other, human, ...; a caller that
    wants an error instead uses ``require_alternating``.
    """
    skips = F.coalesce(F.element_at("turns", 1)["role"] != human, F.lit(False))
    kept = conv.withColumn(
        "turns", F.when(skips, F.slice("turns", F.lit(2), F.size("turns"))).otherwise(F.col("turns"))
    )
    flags = F.transform("turns", lambda e, i: (e["role"] == human) == (F.pmod(i, F.lit(2)) == 0))
    return kept.withColumn("alternates", F.forall(flags, lambda f: f))


def require_alternating(conv: DataFrame) -> DataFrame:
    failed = F.raise_error(F.concat(F.lit("roles do not alternate in conversation "), F.col("conv_id").cast("string")))
    ok = F.when(F.col("alternates"), F.lit(True)).otherwise(failed.cast("boolean"))
    return conv.withColumn("alternates", ok)


def open_last_turn(conv: DataFrame, human: str = "user", other: str = "assistant") -> DataFrame:
    """Add an empty reply after a closing human turn, to be generated."""
    waiting = F.coalesce(F.element_at("turns", -1)["role"] == human, F.lit(False))
    empty = F.struct(F.lit(other).alias("role"), F.lit(None).cast("string").alias("text"))
    return conv.withColumn("turns", F.when(waiting, F.concat("turns", F.array(empty))).otherwise(F.col("turns")))


def render(
    conv: DataFrame,
    style: str,
    system: str,
    roles: dict[str, str],
    sep: str,
    sep2: str | None = None,
) -> DataFrame:
    """conv(conv_id, turns) -> conv_id, prompt. A null or empty text is an open turn."""
    if style not in STYLES:
        raise ValueError(f"invalid style: {style}")
    names = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    seps = F.array(F.lit(sep), F.lit(sep2 if sep2 is not None else sep))

    def piece(e: Column, i: Column) -> Column:
        name, text, odd = F.try_element_at(names, e["role"]), e["text"], F.pmod(i, F.lit(2))
        closing = seps[odd]
        if style == "SINGLE":
            full, empty = t.concat(name, ": ", text, sep), t.concat(name, ":")
        elif style == "TWO":
            full, empty = t.concat(name, ": ", text, closing), t.concat(name, ":")
        elif style == "MPT":
            full, empty = t.concat(name, text, sep), name
        elif style == "PLAIN":
            full, empty = F.concat(text, closing), F.lit("")
        else:
            folded = F.when(i == 0, t.concat(_system_block(system), text)).otherwise(text)
            asked = t.concat(sep, "[INST] ", folded, " [/INST]")
            full, empty = F.when(odd == 0, asked).otherwise(t.concat(" ", text, " ", sep2 or "")), F.lit("")
        return F.when(t.is_blank(text), empty).otherwise(full)

    body = F.array_join(F.transform("turns", piece), "")
    if style == "LLAMA_2":
        # The separator is removed from the left as a set of characters.
        prompt = t.lstrip(body, sep) if sep else body
        first = F.element_at("turns", 1)
        valid = ~t.is_blank(first["text"]) & (first["role"] == next(iter(roles)))
        prompt = F.when(F.coalesce(valid, F.lit(False)), prompt).otherwise(
            F.raise_error(F.lit("the first turn must be a non-empty user turn")).cast("string")
        )
    else:
        head = system if style == "PLAIN" else system + sep
        prompt = t.concat(head, body)
    return conv.select("conv_id", prompt.alias("prompt"))


def _system_block(system: str) -> str:
    return f"<<SYS>>\n{system}\n<</SYS>>\n\n" if system else system


def normalize_images(conv: DataFrame, wrap: tuple[str, str] | None = None, tag: tuple[str, str] | None = None) -> DataFrame:
    """Every turn with an image mark gets it on its own first line."""
    fixed = F.transform(
        "turns", lambda e: F.struct(e["role"].alias("role"), t.normalize_image_token(e["text"], wrap, tag).alias("text"))
    )
    return conv.withColumn("turns", fixed)


def mask_spans(conversations: DataFrame, target: str = "assistant", human: str = "user") -> DataFrame:
    """conv_id, turn, span_start, span_end, masked in words; only complete rounds keep their target.

    Spans are half-open word positions inside the conversation. A target turn
    counts when a turn of ``human`` comes right before it.
    """
    w = W.partitionBy("conv_id").orderBy("turn")
    n = t.word_count("text").cast("long")
    counted = conversations.withColumn("_n", n).withColumn("_prev", F.lag("role").over(w))
    end = F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))
    keeps = (F.col("role") == target) & F.coalesce(F.col("_prev") == human, F.lit(False))
    return counted.select(
        "conv_id", "turn", (end - F.col("_n")).alias("span_start"), end.alias("span_end"), (~keeps).alias("masked")
    )


def sample_lengths(conversations: DataFrame, has_image: Column | None = None) -> DataFrame:
    """conv_id, length (words, plus a fixed length for an image), signed_length (negative without image).

    ``has_image`` is a column that holds per turn; a conversation has an image when any turn does.
    """
    flag = F.lit(False) if has_image is None else has_image
    summed = conversations.groupBy("conv_id").agg(
        F.sum(t.word_count("text")).alias("_words"), F.max(F.coalesce(flag, F.lit(False))).alias("_image")
    )
    return summed.select(
        "conv_id",
        (F.col("_words") + F.when(F.col("_image"), IMAGE_LENGTH).otherwise(0)).alias("length"),
        F.when(F.col("_image"), F.col("_words")).otherwise(-F.col("_words")).alias("signed_length"),
    )
