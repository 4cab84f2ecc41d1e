"""A trained stand-in for the virality formula: gradient-boosted trees on a synthetic corpus."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.story import LINEAR, virality

NAMES = list(LINEAR)


def corpus(spark: SparkSession, rows: int = 20_000, seed: int = 42, noise: float = 0.015) -> DataFrame:
    """Uniform features with the formula's value and noise as label, cut to 0..1."""
    x = spark.range(rows).select("id", *[F.rand(seed + i).alias(f"f_{n}") for i, n in enumerate(NAMES)])
    label = virality({n: F.col(f"f_{n}") for n in NAMES}) + noise * F.randn(seed + 99)
    return x.withColumn("label", F.greatest(F.lit(0.0), F.least(F.lit(1.0), label)))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{n}" for n in NAMES], outputCol="features").transform(rows)


def train(rows: DataFrame, trees: int = 20, depth: int = 4) -> GBTRegressionModel:
    return GBTRegressor(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=7).fit(_vectors(rows))


def predict(model: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    """rows (with the f_ columns) with virality_ml in 0..1."""
    out = model.transform(_vectors(rows)).withColumn("virality_ml", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))))
    return out.drop("features", "prediction")
