"""Registered queries: records written to the shared folder in each form and read back, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.functions import text as t
from strandgraph.operators import benchmarks as B
from strandgraph.plans import fixtures as fx
from strandgraph.plans.fixtures import with_views
from strandgraph.session import shared_path
from strandgraph.sources import files, records

TURNS = "conv_id long, turn long, role string, text string"


def source_jsonl(spark, d):
    path = shared_path(spark, "jsonl")
    records.write_records(fx.table(spark, d, "conversations"), path)
    return records.read_records(spark, path, TURNS)


def _broken(spark, d):
    """Documents as lines; every third line is cut off in the middle."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text", "lang")).alias("value"))
    path = shared_path(spark, "lines")
    cut = F.when(F.col("doc_id") % 3 == 0, F.expr("left(value, length(value) div 2)")).otherwise(F.col("value"))
    docs.select(cut.alias("value")).write.text(path)
    return records.read_records(spark, path, "doc_id long, text string, lang string", tolerant=True)


def source_tolerant(spark, d):
    return records.good_records(_broken(spark, d))


def source_corrupt(spark, d):
    return records.count_corrupt(_broken(spark, d))


def source_array(spark, d):
    path = shared_path(spark, "array")
    records.write_array(fx.table(spark, d, "conversations"), path)
    return records.read_records(spark, path, TURNS, layout="array")


def source_map(spark, d):
    path = shared_path(spark, "map")
    turns = fx.table(spark, d, "conversations")
    records.write_map(turns.select(t.concat(F.col("conv_id").cast("string"), "]: ", F.col("turn").cast("string")).alias("key"), "text"), path)
    return records.read_records(spark, path, "string", layout="map")


def source_csv(spark, d):
    """Parts as quoted, compressed comma-separated text; NA and empty cells stay text."""
    path = shared_path(spark, "csv")
    size = F.when(F.col("p_size") % 5 == 0, "NA").when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_size").cast("string"))
    parts = fx.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), t.concat("p, ", '"', F.col("p_name"), '"').alias("name"), size.alias("size"))
    records.write_csv(parts, path, quote_all=True, compression="gzip")
    return records.read_strings(spark, path)


def source_tsv(spark, d):
    path = shared_path(spark, "tsv")
    orders = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), "o_orderstatus", "o_orderpriority")
    records.write_csv(orders, path, sep="\t")
    return records.read_strings(spark, path, ["key", "o_orderpriority"], sep="\t")


def _split_rows(spark, d):
    path = shared_path(spark, "split")
    rows = fx.rows_nle(spark, d).select("sentence_id", "ord", F.array("triplet").alias("triplets"), F.when(F.pmod("ord", F.lit(5)) == 0, "dev").otherwise("train").alias("split"))
    records.write_split_outputs(rows, path)
    return path


def source_split(spark, d):
    """The rows of both splits, gathered from their folders."""
    path = _split_rows(spark, d)
    shards = records.read_records(spark, [f"{path}/rows/split=dev", f"{path}/rows/split=train"], "sentence_id string, ord long, triplets array<string>")
    return shards.select("sentence_id", "ord", F.array_join("triplets", "|").alias("triplets"))


def source_listing(spark, d):
    """The folders of the files that were written."""
    path = _split_rows(spark, d)
    listed = files.list_paths(spark, path.removeprefix("file:").replace("///", "/") if path.startswith("file:") else path, "*.json")
    return listed.select(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()


def model_names(spark, d):
    return fx.table(spark, d, "pages").select("page_id", t.model_name_from_path(F.concat("url", F.lit("/checkpoint-"), F.col("page_id") % 2, F.lit("/"))).alias("name"))


def submission_mmvet(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), "text")
    return B.to_submission(docs, "mmvet")


def submission_vizwiz(spark, d):
    turns = fx.table(spark, d, "conversations")
    return B.to_submission(turns.select(t.concat(F.col("conv_id").cast("string"), "-", F.col("turn").cast("string")).alias("image"), "text"), "vizwiz")


def submission_mmbench(spark, d):
    docs = fx.table(spark, d, "documents")
    return B.to_submission(docs.select(F.col("doc_id").alias("index"), F.col("lang").alias("category"), "source", F.lit("x").alias("hint"), "text"), "mmbench")


QUERIES = {
    f.__name__: f
    for f in (
        source_jsonl, source_tolerant, source_corrupt, source_array, source_map, source_csv, source_tsv, source_split, source_listing,
        model_names, submission_mmvet, submission_vizwiz, submission_mmbench,
    )
}

_TURNS = "SELECT conv_id, turn, role, text FROM conversations"
ORACLE = {
    "source_jsonl": _TURNS,
    "source_tolerant": "SELECT doc_id, text, lang FROM documents WHERE doc_id % 3 <> 0",
    "source_corrupt": "SELECT count(*) AS rows, count(*) FILTER (WHERE doc_id % 3 = 0) AS corrupt FROM documents",
    "source_array": _TURNS,
    "source_map": "SELECT conv_id || ']: ' || turn AS key, text AS value FROM conversations",
    "source_csv": """
        SELECT CAST(p_partkey AS VARCHAR) AS id, 'p, "' || p_name || '"' AS name,
               CASE WHEN p_size % 5 = 0 THEN 'NA' WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size FROM part""",
    "source_tsv": "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority FROM orders",
    "source_split": with_views("SELECT sentence_id, CAST(ord AS BIGINT) AS ord, triplet AS triplets FROM fx_nle", "fx_nle"),
    "source_listing": with_views(
        """
        SELECT kind || '/split=' || split AS folder
        FROM (SELECT DISTINCT CASE WHEN ord % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM fx_nle), (VALUES ('rows'), ('triplets_by_id')) k(kind)""",
        "fx_nle",
    ),
    "model_names": """
        SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || '_checkpoint-' || (page_id % 2) AS name FROM pages""",
    "submission_mmvet": "SELECT 'v1_' || doc_id AS key, text FROM documents",
    "submission_vizwiz": with_views("SELECT conv_id || '-' || turn AS image, norm AS answer FROM conversations c JOIN conv_norm n ON n.text = c.text", "conv_norm"),
    "submission_mmbench": "SELECT doc_id AS index, text AS prediction FROM documents",
}
