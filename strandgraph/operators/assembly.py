"""Training records: images, splits, retrieved triplets, prompts and questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import text as t
from strandgraph.functions.labels import decode_labels
from strandgraph.operators.ordinal import first_by, latest_by, one_per_key, seeded_draw, with_ordinal
from strandgraph.session import column

# --- fixed values ------------------------------------------------------------

QUESTION_TEMPLATE = "Which signs show that the patient has {pathologies}?"
QUESTION_TEMPLATES = [
    "Which signs show that the patient has {pathologies}?",
    "Explain why these {pathologies} are present in the image.",
    "What evidence in the image indicates {pathologies}?",
    "How can you tell that the patient has {pathologies} from the image?",
    "What features suggest the presence of {pathologies} in this image?",
]
PROMPT_TRIPLETS = "<image>\nThe image-specific triplets from the knowledge graph are: "
PROMPT_CHAINS = "The multi-hop reasoning chains are: "
PROMPT_QUESTION = "And for the given image, "
TEXT = "array<string>"
STUDY = ["subject_id", "study_id"]

# --- images ------------------------------------------------------------------


def image_path(subject: Column | str, study: Column | str, dicom: Column | str) -> Column:
    """``pSS/pSUBJECT/sSTUDY/DICOM.jpg``."""
    subject = column(subject)
    return t.concat("p", F.substring(subject, 1, 2), "/p", subject, "/s", column(study), "/", column(dicom), ".jpg")


def image_manifest(wanted: DataFrame, metadata: DataFrame, prefix: str) -> DataFrame:
    """url: the distinct, sorted addresses (``prefix`` and image path) of the wanted studies."""
    keys = wanted.select("subject_id", "study_id").distinct()
    kept = metadata.join(keys, ["subject_id", "study_id"], "left_semi")
    url = t.concat(prefix, image_path("subject_id", "study_id", "dicom_id"))
    return kept.select(url.alias("url")).distinct().orderBy("url")


def pending(wanted: DataFrame, cached: DataFrame, path: str = "rel_path") -> DataFrame:
    """Distinct wanted paths that are not cached yet."""
    return wanted.select(path).distinct().join(cached.select(path).distinct(), path, "left_anti")


def choose_image(rows: DataFrame, metadata: DataFrame, files: DataFrame, split: DataFrame, default_split: str = "train") -> DataFrame:
    """rows(patient_id, report_id, ...) + img_id, rel_path, split.

    A study's image is its smallest dicom_id with a listed file; rows of studies
    without one are dropped. The split is looked up by subject, study and image.
    """
    return with_images(rows, study_images(metadata, files, split, default_split))


def with_images(rows: DataFrame, images: DataFrame) -> DataFrame:
    """rows(patient_id, report_id, ...) with the columns of ``study_images``; rows without an image are dropped.

    Rows that bring subject_id and study_id keep them, and where they lie.
    """
    if {"subject_id", "study_id"} <= set(rows.columns):
        return rows.join(images, STUDY)
    keyed = rows.withColumn("subject_id", F.expr("substring(patient_id, 2)")).withColumn("study_id", F.expr("substring(report_id, 2)"))
    return keyed.join(images, STUDY).drop(*STUDY)


def study_images(metadata: DataFrame, files: DataFrame, split: DataFrame, default_split: str = "train", within: Sequence[str] = ()) -> DataFrame:
    """subject_id, study_id, img_id, rel_path, split: the image of every study that has one.

    ``within`` is given as the columns of the study where the files have them too. Tables that lie together by them are not moved again.
    """
    paths = metadata.withColumn("rel_path", image_path("subject_id", "study_id", "dicom_id"))
    if within:
        listed = _looked_up(paths, files.select(*within, "rel_path").distinct(), "rel_path", within, "left_semi")
    else:
        listed = paths.join(files.select("rel_path").distinct(), "rel_path", "left_semi")
    chosen = listed.groupBy("subject_id", "study_id").agg(F.min(F.struct("dicom_id", "rel_path")).alias("_i"))
    images = chosen.select(
        "subject_id", "study_id", F.col("_i.dicom_id").alias("img_id"), F.col("_i.rel_path").alias("rel_path")
    )
    splits = split.select("subject_id", "study_id", F.col("dicom_id").alias("img_id"), "split")
    unique = splits.groupBy("subject_id", "study_id", "img_id").agg(F.max("split").alias("split"))
    # Images get their split before they meet the (larger) rows.
    found = _looked_up(images, unique, "img_id", within) if within else images.join(unique, [*STUDY, "img_id"], "left")
    return found.withColumn("split", F.coalesce("split", F.lit(default_split)))


# --- conversations -----------------------------------------------------------


def split_blocks(blocks: Column) -> Column:
    """The ``;``-separated triplets of all blocks, trimmed, non-empty, first occurrence kept."""
    pieces = F.flatten(F.transform(blocks, lambda b: F.split(b, ";")))
    return F.array_distinct(F.filter(F.transform(pieces, t.strip), lambda p: p != ""))


def build_prompt(question: Column, triplets: Column, chains: Column | None = None) -> Column:
    """The human turn; the chain sentence is there only when ``chains`` is non-empty."""
    head = t.concat(PROMPT_TRIPLETS, F.array_join(triplets, "; "), ". ")
    if chains is not None:
        shown = t.concat(PROMPT_CHAINS, F.array_join(chains, "; "), ". ")
        head = F.concat(head, F.when(F.size(chains) > 0, shown).otherwise(""))
    return t.concat(head, PROMPT_QUESTION, question)


def question(pathologies: Column, key: Column | str | None = None, seed: int = 0, templates: Sequence[str] = (QUESTION_TEMPLATE,)) -> Column:
    """The question about the pathologies; with several templates one is drawn per key."""
    made = [F.replace(F.lit(q), F.lit("{pathologies}"), pathologies) for q in templates]
    if len(made) == 1:
        return made[0]
    draw = F.conv(F.substring(seeded_draw(key, seed), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*made), (F.pmod(draw, F.lit(len(made))) + 1).cast("int"))


def two_turns(human: Column, gpt: Column) -> Column:
    def turn(who: str, value: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), value.alias("value"))

    return F.array(turn("human", human), turn("gpt", gpt))


def _placed(df: DataFrame, within: Sequence[str]) -> DataFrame:
    return df.repartition(*within) if within else df


def _looked_up(rows: DataFrame, side: DataFrame, key: str, within: Sequence[str], how: str = "left") -> DataFrame:
    """rows with the columns of the row of ``side`` that has the same ``key``, if there is one.

    Spark moves both sides by all columns that a join finds equal, so with ``within``
    the key is compared by its order, inside the few rows that lie together.
    """
    if not within:
        return rows.join(side, key, how)
    theirs = side.withColumnsRenamed({c: f"_at_{c}" for c in [*within, key]})
    match = (F.col(key) >= F.col(f"_at_{key}")) & (F.col(key) <= F.col(f"_at_{key}"))
    for c in within:
        match &= F.col(c) == F.col(f"_at_{c}")
    return rows.join(theirs, match, how).drop(*[f"_at_{c}" for c in [*within, key]])


def with_triplet_source(rows: DataFrame, retrieved: DataFrame, order: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Add blocks and branch: the image's retrieved blocks, else the row's own, else none.

    The last retrieval of an image under ``order`` counts; without it a repeated image is an error.
    ``within`` as in ``build_conversations``.
    """
    keys = [*within, "img_id"]
    found = one_per_key(_placed(retrieved, within), keys, order).select(*keys, t.text_blocks("captions", True).alias("_found"))
    joined = _looked_up(rows, found, "img_id", within)
    own = t.text_blocks("triplets", True)
    has = F.coalesce(F.size("_found") > 0, F.lit(False))
    branch = F.when(has, "retrieved").when(F.size(own) > 0, "row").otherwise("none")
    return joined.withColumn("branch", branch).withColumn("blocks", F.when(has, F.col("_found")).otherwise(own)).drop("_found")


def build_conversations(
    rows: DataFrame,
    retrieved: DataFrame,
    chains: DataFrame | None = None,
    multihop: bool = False,
    templates: Sequence[str] = (QUESTION_TEMPLATE,),
    seed: int = 0,
    retrieved_order: str | None = None,
    chains_order: str | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """rows(img_id, rel_path, split, sentence_id, img_labels, nle, triplets, ord) -> id, split, image, sentence_id, branch, conversations.

    The first row per (image, sentence) counts. ``chains`` (img_id = sentence id,
    chains) enter the prompt only with ``multihop``. Of repeated images and chains the
    last one under the given order column counts; without one a repeat is an error.

    ``within`` names columns of all three tables that an image and a sentence fix, such as
    those of its study. Rows that lie together by them are not moved again.
    """
    unique = first_by(rows, [*within, "img_id", "sentence_id"], "ord")
    sourced = with_triplet_source(unique, retrieved, retrieved_order, within)
    extra = None
    if multihop and chains is not None:
        table = one_per_key(_placed(chains, within), [*within, "img_id"], chains_order).select(*within, F.col("img_id").alias("sentence_id"), F.col("chains").alias("_chains"))
        sourced = _looked_up(sourced, table, "sentence_id", within)
        extra = F.coalesce("_chains", F.array().cast(TEXT))
    asked = question(decode_labels("img_labels"), "img_id", seed, templates)
    prompt = build_prompt(asked, split_blocks(F.col("blocks")), extra)
    return sourced.select(
        F.col("img_id").alias("id"),
        "split",
        F.col("rel_path").alias("image"),
        "sentence_id",
        "branch",
        two_turns(prompt, F.col("nle")).alias("conversations"),
    )


def attach_first_k(rows: DataFrame, retrieved: DataFrame, k: int = 7, order: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """The last row per image with its first ``k`` retrieved captions, of the image's last retrieval under ``order``.

    ``within`` as in ``build_conversations``.
    """
    keys = [*within, "img_id"]
    last = latest_by(rows, keys, "ord")
    found = one_per_key(_placed(retrieved, within), keys, order).select(*keys, F.slice("captions", 1, k).alias("_k"))
    return _looked_up(last, found, "img_id", within).withColumn("kg_triplets", F.coalesce("_k", F.array().cast(TEXT))).drop("_k")


def source_stats(conversations: DataFrame) -> DataFrame:
    """branch -> n: where the prompt's triplets came from."""
    return conversations.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


def to_questions(conversations: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """question_id (dense position under ``order``), image, text without the image mark."""
    first = F.element_at("conversations", 1)["value"]
    keys = [column(c).alias(f"_order{i}") for i, c in enumerate(order)]
    rows = conversations.select("image", t.strip_image_prefix(first).alias("text"), *keys)
    return with_ordinal(rows, [f"_order{i}" for i in range(len(keys))], name="question_id").select("question_id", "image", "text")


def to_chat(conversations: DataFrame) -> DataFrame:
    """id, messages ARRAY<STRUCT<role, content>>, prompt_messages (first only), tagged prompt and full text."""
    human = t.strip_image_prefix(F.element_at("conversations", 1)["value"])
    gpt = F.element_at("conversations", 2)["value"]

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    tagged = t.concat("<|user|>\n<|image_1|>\n", human, "<|end|>\n<|assistant|>\n")
    return conversations.select(
        "id",
        F.array(message("user", human), message("assistant", gpt)).alias("messages"),
        F.array(message("user", human)).alias("prompt_messages"),
        tagged.alias("prompt_text"),
        t.concat(tagged, gpt, "<|end|>").alias("full_text"),
    )
