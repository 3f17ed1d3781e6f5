"""JSON and CSV records: readers with explicit schemas, writers, submissions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.functions import text as t

CORRUPT = "_corrupt"


def read_records(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    layout: str = "jsonl",
    tolerant: bool = False,
    field: str | None = None,
) -> DataFrame:
    """Records with an explicit schema; a path may be a folder, a glob of shards or a list.

    jsonl: one object per line, blank lines skipped. A bad line is an error, or with
    ``tolerant`` a row with its text in ``_corrupt``.
    array: one top-level array per file, read as a stream, or with ``field`` the array under that name.
    map: one object per file, keyed by id -> key, value (``schema`` is the value's type).
    """
    paths = path if isinstance(path, str) else list(path)
    if layout == "jsonl":
        kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if tolerant:
            wide = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
            options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
            lines = spark.read.text(paths).where(t.strip("value") != "")
            return lines.select(F.from_json("value", wide, options).alias("_r")).select("_r.*")
        return spark.read.schema(kind).option("mode", "FAILFAST").json(paths)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    if layout == "array":
        kind = f"STRUCT<{schema}>" if isinstance(schema, str) else ddl
        reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
        if field is None:
            return reader.schema(schema).json(paths)
        return reader.schema(f"`{field}` ARRAY<{kind}>").json(paths).select(F.explode(field).alias("_r")).select("_r.*")
    if layout == "map":
        whole = spark.read.text(paths, wholetext=True)
        return whole.select(F.explode(F.from_json("value", f"MAP<STRING, {ddl}>", {"mode": "FAILFAST"})).alias("key", "value"))
    raise ValueError(f"unknown layout: {layout}")


def count_corrupt(df: DataFrame) -> DataFrame:
    """One row: rows, corrupt, for a tolerantly read table."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("corrupt"))


def good_records(df: DataFrame) -> DataFrame:
    """The rows that could be parsed."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_strings(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header, every column text; ``NA`` and empty cells stay text.

    ``columns`` selects by name. A compressed file is one task to read; its rows are
    spread again for the work that follows.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    df = reader.option("emptyValue", "").option("nullValue", "\u0000").option("quote", '"').option("escape", '"').csv(paths)
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in (columns or df.columns)])
    if any(p.endswith(".gz") for p in paths):
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df


def write_records(
    df: DataFrame,
    path: str,
    order_by: Sequence[Column | str] | None = None,
    by: Sequence[str] | None = None,
    single: bool = False,
    mode: str = "error",
) -> None:
    """JSON lines; sorted over the whole table when asked, one folder per ``by`` value.

    ``single`` makes one file, which passes the table through one task: only for small results.
    """
    out = df.orderBy(*order_by) if order_by else df
    writer = (out.coalesce(1) if single else out).write.mode(mode)
    (writer.partitionBy(*by) if by else writer).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False, sep: str = ",", mode: str = "error", compression: str = "none") -> None:
    writer = df.write.mode(mode).option("header", True).option("sep", sep).option("quoteAll", quote_all).option("escape", '"')
    writer.option("emptyValue", "").option("compression", compression).csv(path)


def write_enclosed(members: DataFrame, path: str, opening: str, closing: str, mode: str = "error") -> None:
    """Files that hold one array or object each: ``members``, a single text column, between brackets and separated by commas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = opening
        for batch in batches:
            if len(batch):
                lines = batch["value"].to_list()
                yield pd.DataFrame({"value": [lead + lines[0], *("," + line for line in lines[1:])]})
                lead = ","
        yield pd.DataFrame({"value": [closing if lead == "," else opening + closing]})

    members.toDF("value").mapInPandas(run, "value string").write.mode(mode).text(path)


def write_array(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON array of records per file."""
    write_enclosed(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), path, "[", "]", mode)


def write_map(df: DataFrame, path: str, key: str = "key", value: str = "text", mode: str = "error") -> None:
    """One JSON object of key and text per file."""
    write_enclosed(as_json_map(df, key, value), path, "{", "}", mode)


def write_split_outputs(rows: DataFrame, path: str, mode: str = "error") -> None:
    """rows(split, sentence_id, triplets, ...): ``rows`` per split, and the ``triplets_by_id`` map per split."""
    rows.write.mode(mode).partitionBy("split").option("ignoreNullFields", False).json(f"{path}/rows")
    rows.select("split", "sentence_id", "triplets").write.mode(mode).partitionBy("split").json(f"{path}/triplets_by_id")


def as_json_map(df: DataFrame, key: str = "key", value: str = "text") -> DataFrame:
    """Lines of ``"key": value`` members, for a submission that wants one object."""

    def quoted(name: str) -> Column:
        text = F.to_json(F.array(name))
        return F.substring(text, F.lit(2), F.length(text) - 2)  # without the brackets of the array

    return df.select(t.concat(quoted(key), ": ", quoted(value)).alias("value"))
