"""Session defaults, the shared folder, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

# Adaptive execution picks partition counts, broadcast sides and skew splits from
# measured sizes, so nothing below depends on the cluster or on the input.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_SHIPPED = "strandgraph.shipped"


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the library's defaults, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandgraph")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors see.

    Where a local session leaves it unset, a fresh temporary folder is set as the
    checkpoint folder; on a cluster a missing setting is an error, because a
    machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/strandgraph/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back without its lineage.

    Parquet keeps column pruning and filter pushdown for what reads it. The files
    stay until the folder of the application is cleaned.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, keys: dict[str, Column], name: str = "table") -> DataFrame:
    """As ``materialize``, with the columns ``keys`` added and the rows of equal ones in one bucket.

    Joins and groups by the keys, and groups by them and more columns, then read their
    buckets and move nothing, however often the table is used. Only a table of the session's
    catalog keeps its buckets, so it gets a name of its own there; the files are in the shared folder.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(parts, *keys.values()).withColumns(keys)  # the keys are made after the rows have moved
    placed.write.format("parquet").option("compression", "zstd").bucketBy(parts, *keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Worker functions are pickled by module name, so workers that start in another
    folder need the package itself.
    """
    context = spark.sparkContext
    if context.getLocalProperty(_SHIPPED):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"  # addPyFile copies it to the executors
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context.setLocalProperty(_SHIPPED, "yes")


def column(value: Column | str) -> Column:
    """A column given by name or as an expression."""
    from pyspark.sql import functions as F

    return F.col(value) if isinstance(value, str) else value
