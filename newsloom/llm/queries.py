"""The queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bags, balls, bpe, leaks, licences, passages, periods, quality, sharding, spots, suffixes, tongues, toxicity
from newsloom.llm.sampling import split

SHARD_BYTES = 1 << 20
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicate(table(spark, sf_dir, "documents"), texts_too=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.compared(table(spark, sf_dir, "documents"))


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.classes(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, "toxic", split(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(split(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(docs, model, ["doc_id"], name="score").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=False)


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, "quality", split(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(split(F.col("doc_id"), 4) == 2, F.lit(False))
    return quality.score(docs, model, ["doc_id"], name="score").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.cluster(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.found(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = tongues.train(docs, "lang", split(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(split(F.col("doc_id"), 4) == 2, F.lit(False))
    return tongues.predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_license_scan, op3_spot_signatures, op4_bag_minhash, op5_toxicity, op6_byte_bpe, op7_compact_windows, op8_quality, op9_sharding, op10_decontamination, op11_ball_kmeans, op12_periodic_runs, op13_language_id)}
ORACLE_SQL: dict[str, str] = {"op2_license_scan": licences.oracle(), "op9_sharding": sharding.oracle(SHARD_BYTES)}
