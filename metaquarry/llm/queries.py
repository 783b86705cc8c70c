"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.llm import fingerprints, idfiles, langid, linededup, mixing, neardup, neighbours, packing, sharding, toxicity
from metaquarry.llm.common import table

SHARDS = 40
QUERY_EVERY, BEST = 50, 5


#: Domains by the sources' names, and the weights of domains, languages and sources; others weigh 1.
MIX_DOMAIN = "concat('d', coalesce(length(source) % 2, 2))"
MIX_WEIGHTS = {
    "domain": "CASE domain WHEN 'd0' THEN 2 ELSE 3 END",
    "lang": "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END",
    "source": "CASE source WHEN 'src0' THEN 3 ELSE 2 END",
}


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), F.expr(MIX_DOMAIN), MIX_WEIGHTS)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~langid.held_out(F.col("doc_id"), 4, 2))
    rows = toxicity.scored(docs, model)
    return rows.select("doc_id", langid.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= toxicity.TOXIC_FROM, 1).otherwise(0).alias("predicted"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.beside_next(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % QUERY_EVERY == 0, BEST)


def op6_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word", 1)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.line_counts(table(spark, sf_dir, "documents"))
    return rows.withColumn("removed", F.array_join("removed", ","))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.joined(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


QUERIES = {"op1_langid": op1_langid, "op2_mixing": op2_mixing, "op3_toxicity": op3_toxicity, "op4_fingerprints": op4_fingerprints, "op5_neighbours": op5_neighbours, "op6_idfiles": op6_idfiles, "op7_sharding": op7_sharding, "op8_linededup": op8_linededup, "op9_neardup": op9_neardup, "op10_packing": op10_packing}
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.oracle(MIX_DOMAIN, MIX_WEIGHTS, mixing.PERCENT, mixing.MAX_EPOCHS, mixing.SEED),
    "op5_neighbours": neighbours.oracle(QUERY_EVERY, BEST),
    "op9_neardup": neardup.oracle(),
}
