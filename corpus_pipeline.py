"""From raw documents to sampled piece sequences: toxic and low-quality texts go, one document of each
group of near copies stays, benchmark passages are cut, and the rest is encoded.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all that its predecessor kept;
between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, jaccard_join, pieces, quality, toxicity
from tideline.llm.common import table, written
from tideline.llm.queries import piece_vocabulary
from tideline.runtime import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.3 or more go."""
    ship(spark)
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores below 0.3 go."""
    ship(spark)
    return quality.reject(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the smallest id stays."""
    ship(spark)
    return jaccard_join.one_of_each(docs, percent=80, size=5)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that hold a benchmark window are cut; documents of mostly such passages go."""
    ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text."""
    ship(spark)
    return pieces.encode(docs, piece_vocabulary(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", cut_benchmark),
    ("pieces", sample_pieces),
]

#: Trained models, components and seeded samples are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
