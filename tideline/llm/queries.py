"""The registered queries opN_<name>: each applies an operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, licenses, mpeg, pieces, quality, suffix_tree, token_shards, toxicity, url_rules
from .common import shared_dir, table


#: (verdict, host, path)
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.store(table(spark, sf_dir, "documents"), "text", "doc_id")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.evaluate(table(spark, sf_dir, "documents"))


#: The vocabulary's file; another can be named in the session as tideline.llm.pieces.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def piece_vocabulary(spark: SparkSession) -> pieces.Vocabulary:
    return pieces.load(spark.conf.get("tideline.llm.pieces", PIECES))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), piece_vocabulary(spark))
    return encoded.withColumn("ids_sha256", F.sha2("ids", 256))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(table(spark, sf_dir, "documents"))


#: The rank file; another can be named in the session as tideline.llm.ranks.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = token_shards.load(spark.conf.get("tideline.llm.ranks", RANKS))
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return token_shards.materialise(table(spark, sf_dir, "documents"), folder, vocab)
