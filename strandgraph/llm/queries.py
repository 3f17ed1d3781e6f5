"""The thin registered queries of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import audit, bpe, hilbert, hyperlang, merkle, minhash, mixing, pieces, sharding, simhash, spotsigs, tokencounts, toxicity, warc
from strandgraph.llm.common import table, word_count
from strandgraph.session import materialize, shared_path

SHARDS = 8
WEIGHTS = [5, 2, 1]


def op1_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op2_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = spotsigs.with_next(spotsigs.with_fingerprint(docs, "text", "fingerprint"), "doc_id", "text")
    n = F.length("text")
    edited = pairs.withColumn("edited", F.expr("concat(left(text, length(text) - length(text) div 4), left(head, cast(length(text) div 4 as int)))"))
    edited = edited.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "edited", "fingerprint", "next_fingerprint")
    both = spotsigs.with_fingerprint(edited, "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        spotsigs.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        spotsigs.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.predict(docs, "text", model).select("doc_id", "severity", "grade", (F.col("toxic_chance") >= 0.5).alias("toxic"))


def op4_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("key"), "source", word_count(F.col("text")).alias("size")), "sizes"
    )
    mixed = mixing.balance(rows, WEIGHTS)
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = hyperlang.train(docs.where(~hyperlang.held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    found = hyperlang.predict(docs.select("doc_id", "text"), "text", profiles)
    return found.select("doc_id", hyperlang.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def piece_model() -> pieces.Pieces:
    import public_tokenizers

    return pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.with_tokens(table(spark, folder, "documents").select("doc_id", "text"), "text", piece_model())


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencounts.with_counts(table(spark, folder, "documents").select("doc_id", "text"), "text", piece_model())


def op8_shard(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(sharding.text_sizes(table(spark, folder, "documents")), "sizes")
    return sharding.shard_by_bytes(rows, "doc_id", "size", "digest", SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_components(table(spark, folder, "documents"), "doc_id", "text")
    return found.select("doc_id", simhash.hexadecimal("print").alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    warc.register(spark)
    path = shared_path(spark, "archive")
    warc.as_records(table(spark, folder, "pages"), "page_id", "url", "html").write.format("warc").mode("append").save(path)
    read = spark.read.format("warc")
    full = read.load(path).where("record_type = 'response'")
    slim = read.schema(warc.SCHEMA.removesuffix(", payload binary")).load(path).where("record_type = 'revisit'")
    named = [warc.key_of("record_id").alias("page_id")]
    responses = full.select(*named, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", warc.key_of("refers_to").alias("refers_to"))
    revisits = slim.select(*named, F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", warc.key_of("refers_to").alias("refers_to"))
    return responses.union(revisits)


def op11_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_copies(table(spark, folder, "documents"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_digest([*fields, F.col("text")])
    tampered = merkle.leaf_digest([*fields, F.replace("text", F.lit("\n"), F.lit(""))])
    picked = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(picked, tampered).otherwise(leaf).alias("claimed"))
    made = merkle.manifest(rows, "source", ["doc_id"], "leaf")
    return merkle.prove(made, "claimed").drop("claimed")
