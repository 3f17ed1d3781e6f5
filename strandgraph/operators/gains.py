"""Gain analysis over a metric table (model, condition, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Metrics where less is better: their gain is base minus condition.
LOWER_IS_BETTER = ("hallucination_rate",)


def gains(metrics: DataFrame, base: str = "Base", lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """condition, model, metric, base, value, gain for every condition but the base."""
    reference = metrics.where(F.col("condition") == base).select("model", "metric", F.col("value").alias("base"))
    others = metrics.where(F.col("condition") != base).join(reference, ["model", "metric"])
    difference = F.col("value") - F.col("base")
    return others.select(
        "condition", "model", "metric", "base", "value",
        F.when(F.col("metric").isin(list(lower_is_better)), -difference).otherwise(difference).alias("gain"),
    )


def gain_table(gain_rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per (condition, model) with base_<metric> and gain_<metric> columns."""
    cells = []
    for m in metrics:
        mine = F.col("metric") == m
        cells += [F.max(F.when(mine, F.col("base"))).alias(f"base_{m}"), F.max(F.when(mine, F.col("gain"))).alias(f"gain_{m}")]
    return gain_rows.groupBy("condition", "model").agg(*cells)


def gain_summary(table: DataFrame, score: str = "overall", auto: str = "cider") -> DataFrame:
    """One row per condition of gain_table: correlation, fit, halves, medians, extremes and flags.

    The weak half are the floor(n/2) lowest base scores; medians are the upper ones;
    correlation is NaN and the fit flat when a side does not vary. One row per model
    and condition comes in, so the per-condition windows are small.
    """
    x, y, a = F.col(f"base_{score}"), F.col(f"gain_{score}"), F.col(f"gain_{auto}")
    by = W.partitionBy("condition")
    ranked = table.withColumn("_rn", F.row_number().over(by.orderBy(x, "model"))).withColumn("_n", F.count(F.lit(1)).over(by))
    weak = F.col("_rn") <= F.floor(F.col("_n") / 2)
    moments = ranked.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.covar_pop(x, y).alias("_cov"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"),
        F.avg(F.when(weak, y)).alias("weak_mean"),
        F.avg(F.when(~weak, y)).alias("strong_mean"),
        F.array_sort(F.collect_list(y)).alias("_ys"),
        F.array_sort(F.collect_list(a)).alias("_as"),
        F.max(y).alias("max_gain"), F.min(y).alias("min_gain"),
        F.avg(a).alias("mean_auto_gain"), F.avg(y).alias("mean_gain"),
        F.array_sort(F.collect_list(F.when(weak, F.struct("_rn", "model")))).alias("_weak"),
        F.array_sort(F.collect_list(F.when(~weak, F.struct("_rn", "model")))).alias("_strong"),
        F.count_if((y >= 0.05) & (y <= 0.15)).alias("small_gain_count"),
        F.count_if(y <= 0).alias("nonpositive_gain_count"),
    )
    middle = (F.floor(F.col("n") / 2) + 1).cast("int")
    spread = F.sqrt("_vx") * F.sqrt("_vy")
    varies = (F.col("n") >= 2) & (spread > 0)
    slope = F.when(F.col("_vx") > 0, F.try_divide("_cov", "_vx")).otherwise(F.lit(0.0))
    out = moments.select(
        "*",
        F.when(varies, F.try_divide(F.col("_cov"), spread)).otherwise(F.lit(float("nan"))).alias("pearson"),
        slope.alias("slope"),
        F.element_at("_ys", middle).alias("median_gain"),
        F.element_at("_as", middle).alias("median_auto_gain"),
        F.transform("_weak", lambda e: e["model"]).alias("weak_models"),
        F.transform("_strong", lambda e: e["model"]).alias("strong_models"),
    )
    return out.select(
        "condition", "n", "pearson", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"),
        "weak_mean", "strong_mean", "median_gain", "max_gain", "min_gain", "mean_gain", "median_auto_gain", "mean_auto_gain",
        "small_gain_count", "nonpositive_gain_count", "weak_models", "strong_models",
        (F.col("pearson") < 0).alias("supports_weak_gain"),
        (F.col("weak_mean") > F.col("strong_mean")).alias("stronger_gap"),
        ((F.col("median_auto_gain") >= 10) & (F.col("median_gain") <= 0.15)).alias("supported_typically"),
    )


def observations(summary: DataFrame) -> DataFrame:
    """condition, line_no, line: the fixed sentences about a summary, with two or three digits."""

    def form(pattern: str, *columns: str):
        return F.format_string(pattern, *[F.col(c) for c in columns])

    lines = [
        form("%s Pearson correlation between Base Overall and gain is %.3f.", "condition", "pearson"),
        form("%s weak-half mean gain is %.2f, versus %.2f for the strong half.", "condition", "weak_mean", "strong_mean"),
        form("%s median CIDEr gain is %.2f, while median Overall gain is %.2f.", "condition", "median_auto_gain", "median_gain"),
        form("%s small Overall gains (0.05 to 0.15) occur in %d/%d models.", "condition", "small_gain_count", "n"),
    ]
    return summary.select("condition", F.posexplode(F.array(*lines)).alias("line_no", "line"))
