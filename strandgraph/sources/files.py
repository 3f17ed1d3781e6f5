"""Report trees and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_FILE = r"/p\d\d/(p[^/]+)/(s[^/]+)\.txt$"


def read_reports(spark: SparkSession, root: str, patients: DataFrame | list[str] | None = None) -> DataFrame:
    """root/pNN/pPATIENT/sREPORT.txt -> patient_id, report_id, text; other files are ignored.

    ``patients`` is a list of ids or a table with patient_id.
    """
    files = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="s*.txt")
        .select("value", F.col("_metadata.file_path").alias("_path"))
    )
    found = files.where(F.col("_path").rlike(REPORT_FILE)).select(
        F.regexp_extract("_path", REPORT_FILE, 1).alias("patient_id"),
        F.regexp_extract("_path", REPORT_FILE, 2).alias("report_id"),
        F.col("value").alias("text"),
    )
    if patients is None:
        return found
    if isinstance(patients, list):
        return found.where(F.col("patient_id").isin(patients))
    return found.join(patients.select("patient_id").distinct(), "patient_id", "left_semi")


def list_paths(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """rel_path of every file below ``root``; the bytes are not read."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    at = F.instr(F.col("path"), base)
    return files.select(F.expr("path").alias("_p"), at.alias("_at")).select(
        F.substring("_p", F.col("_at") + len(base), F.length("_p")).alias("rel_path")
    )
