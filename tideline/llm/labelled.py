"""Bounded samples of labelled documents, the only rows that models of labels learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def held_out(mod: int, remainder: int):
    """Whether a document is kept from training: crc32 of its id as text, modulo mod."""
    return F.coalesce(crc_mod("doc_id", mod) == remainder, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """((label, text) of at most 2 * per_class labelled ids, training labels by class).

    The ids of each class with the smallest hashes are taken, so the sample does not depend on the
    order of rows. Only the ids are broadcast: their number is the bound. Null labels and ids,
    held-out ids and contradicting labels of one id (the largest is used) do no harm."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(mod, remainder))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    parts = [own.filter(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).join(chosen, "doc_id").select("doc_id", "label", "text"), counts
