"""The thin queries over the operators of this package: one for each, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import conversations, hmm, licenses, minhash, mixing, quality
from sparkloom.llm.alignment import Alignment
from sparkloom.llm.decontaminate import Leaks
from sparkloom.llm.fingerprints import edited_fingerprints
from sparkloom.llm.pii import personal_data
from sparkloom.llm.sharding import assign_shards
from sparkloom.llm.simhash import near_duplicates
from sparkloom.llm.suffix_dedup import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir).select("doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(documents(spark, sf_dir).select("doc_id", "text"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    found = quality.scores(docs, quality.fit(docs, labels))
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir).select("doc_id", "text"), masked=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Leaks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")).hits(documents(spark, sf_dir).select("doc_id", "text"))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = hmm.held_out()
    found = hmm.score(documents(spark, sf_dir).select("doc_id", "text"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir).select("doc_id", "text"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(documents(spark, sf_dir).select("doc_id", "text")).documents().drop("groups")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_fingerprints, op3_sharding, op4_simhash, op5_quality, op6_pii, op7_mixing, op8_decontaminate, op9_hmm, op10_licenses, op11_alignment, op12_conversations, op13_minhash)}


def oracle_sql() -> dict[str, str]:
    return {"op10_licenses": licenses.oracle(), "op12_conversations": conversations.oracle()}
