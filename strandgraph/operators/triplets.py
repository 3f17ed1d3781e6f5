"""Relation triplets per report and per image, and the entity vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import text as t
from strandgraph.operators.ordinal import one_per_key
from strandgraph.operators.reports import report_key

NO_TRIPLETS = "array<string>"


def report_triplets(annotations: DataFrame) -> DataFrame:
    """annotations(report_id, processed_annotations) -> report_id, triplets.

    Relations are flattened in order, a null list counts as empty, first occurrence kept.
    """
    lists = F.transform(
        "processed_annotations", lambda a: F.coalesce(a["suggestive_of"], F.array().cast(NO_TRIPLETS))
    )
    triplets = F.array_distinct(F.flatten(F.coalesce(lists, F.array().cast("array<array<string>>"))))
    return annotations.select("report_id", triplets.alias("triplets"))


def attach_triplets(rows: DataFrame, by_report: DataFrame, order: str | None = None) -> DataFrame:
    """Left join on the report key; a row without a match gets an empty array.

    The last entry of a report under ``order`` counts; without it a repeated report is an error.
    """
    keyed = rows.withColumn("_key", report_key("report_id", "sentence_id"))
    lookup = one_per_key(by_report, ["report_id"], order).select(F.col("report_id").alias("_key"), F.col("triplets").alias("_found"))
    return (
        keyed.join(lookup, "_key", "left")
        .withColumn("triplets", F.coalesce("_found", F.array().cast(NO_TRIPLETS)))
        .drop("_key", "_found")
    )


def merge_in_order(rows: DataFrame, keys: list[str], items: str, order: str, out: str, single: bool = False) -> DataFrame:
    """Per key the union of the rows' arrays, first occurrence first; keys with none get [].

    Repeats are removed before the arrays are built: (key, item) is aggregated to its
    first position on the map side, so a hot key only collects its distinct items.
    With ``single`` a row has one item instead of an array; its position is a plain
    value then, which is aggregated without sorting.
    """
    if single:
        exploded, place = rows.select(*keys, F.col(order).alias("_ord"), F.col(items).alias("_item")), F.col("_ord")
    else:
        exploded = rows.select(*keys, F.col(order).alias("_ord"), F.posexplode_outer(items).alias("_i", "_item"))
        place = F.struct("_ord", "_i")
    firsts = exploded.groupBy(*keys, "_item").agg(F.min(place).alias("_at"))
    entry = F.when(F.col("_item").isNotNull(), F.struct("_at", "_item"))
    return firsts.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_item"]).alias(out)
    )


def image_triplets(rows: DataFrame) -> DataFrame:
    """rows(img_id, rel_path, split, triplets, ord) -> one row per image.

    Triplets are the ordered union over the image's rows; other fields come from its first row.
    """
    merged = merge_in_order(rows, ["img_id"], "triplets", "ord", "triplets")
    first = rows.groupBy("img_id").agg(F.min_by(F.struct("rel_path", "split"), "ord").alias("_f"))
    return first.join(merged, "img_id").select(
        "img_id", F.col("_f.rel_path").alias("rel_path"), F.col("_f.split").alias("split"), "triplets"
    )


def vocabulary(rows: DataFrame, triplets: str = "triplets") -> DataFrame:
    """Distinct lowered entities of the triplets with exactly one separator -> entity."""
    each = rows.select(F.explode(triplets).alias("_t")).distinct()
    return each.select(F.explode(t.entities_strict("_t")).alias("entity")).distinct()


def triplet_stats(by_report: DataFrame) -> DataFrame:
    """One row: reports, empty_reports, empty_report_pct."""
    empty = F.count_if(F.size("triplets") == 0)
    total = F.count(F.lit(1))
    return by_report.agg(
        total.alias("reports"),
        empty.alias("empty_reports"),
        F.round(100 * empty / F.greatest(total, F.lit(1)), 1).alias("empty_report_pct"),
    )


def text_source_stats(texts: DataFrame) -> DataFrame:
    """source -> n, for the output of report_text."""
    return texts.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def keep_splits(df: DataFrame, splits: list[str] | tuple[str, ...] = ("train", "val")) -> DataFrame:
    return df.where(F.col("split").isin(list(splits)))


def drop_empty_triplets(df: DataFrame) -> DataFrame:
    return df.where(F.size("triplets") > 0)


def max_tokens(df: DataFrame, text: Column | str, n: int = 100) -> DataFrame:
    """Rows whose text has at most ``n`` whitespace tokens."""
    return df.where(t.word_count(text) <= n)
