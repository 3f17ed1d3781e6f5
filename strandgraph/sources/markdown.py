"""Metric tables in markdown files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandgraph.functions import text as t
from strandgraph.operators.ordinal import latest_by


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of every file."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return whole.select("path", F.posexplode(F.split("value", "\r\n|\n")).alias("line_no", "line"))


def read_markdown_table(lines: DataFrame, section: str, metrics: Sequence[str], conditions: Sequence[str], within: int = 30) -> DataFrame:
    """lines(path, line_no, line) -> path, model, condition, metric, value.

    The section is a line of its own; its table starts with ``| Model`` less than
    ``within`` lines below and ends at the next ``## `` line. A blank model cell repeats the last model
    of a row with a wanted condition; ``*`` is dropped and of ``x/5`` the x counts.
    """
    # One group per file, which is a small document.
    by = W.partitionBy("path")
    line = t.strip("line")
    marked = lines.withColumn("_l", line).withColumn("_s", F.min(F.when(line == section, F.col("line_no"))).over(by))
    header = F.col("_l").startswith("| Model") & (F.col("line_no") > F.col("_s")) & (F.col("line_no") < F.col("_s") + within)
    headed = marked.withColumn("_h", F.min(F.when(header, F.col("line_no"))).over(by))
    body = headed.where(F.col("line_no") >= F.col("_h") + 2)
    stop = F.min(F.when(F.col("_l").startswith("## "), F.col("line_no"))).over(by)
    inside = body.withColumn("_e", stop).where(F.col("_e").isNull() | (F.col("line_no") < F.col("_e")))
    cells = F.split("_l", r"\|")
    rows = (
        inside.where(F.col("_l").startswith("|"))
        .withColumn("_c", F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 2, F.lit(0))), t.strip))
        .where(F.size("_c") >= 2)
        .withColumn("condition", F.element_at("_c", 2))
        .where(F.col("condition").isin(list(conditions)))
    )
    named = F.when(F.element_at("_c", 1) != "", t.strip(F.replace(F.element_at("_c", 1), F.lit("*"), F.lit(""))))
    down = by.orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    filled = rows.withColumn("model", F.last(named, ignorenulls=True).over(down)).where(~t.is_blank("model"))
    known = F.array(*[F.lit(m) for m in metrics])
    values = F.slice("_c", 3, len(metrics))
    each = filled.select("path", "line_no", "model", "condition", F.posexplode(values).alias("_i", "_v")).select(
        "path", "line_no", "model", "condition", known[F.col("_i")].alias("metric"), "_v"
    )
    cleaned = F.substring_index(F.replace("_v", F.lit("*"), F.lit("")), "/", 1)
    number = F.regexp_extract(cleaned, r"-?\d+(?:\.\d+)?", 0)
    checked = F.when(number == "", F.raise_error(t.concat("no number in cell ", F.col("_v"))).cast("double")).otherwise(number.try_cast("double"))
    parsed = each.select("path", "line_no", "model", "condition", "metric", checked.alias("value"))
    return latest_by(parsed, ["path", "model", "condition", "metric"], "line_no").drop("line_no")
