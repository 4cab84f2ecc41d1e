"""Spectral features of evenly spaced samples, by frames. A frame is a group of its own, so a long media
item spreads over tasks; only the transform itself is numpy, the rest are expressions on its bins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.signals import moving_average, scaled

# --- fixed values: the shares of centroid, contrast and roll-off, and the roll-off's level ---
CENTROID, CONTRAST, ROLLOFF, LEVEL = 0.40, 0.35, 0.25, 0.85
# --- end of the fixed values ---
BANDS = 3


def spectra(samples: DataFrame, size: int) -> DataFrame:
    """(media_id, t, mags): magnitudes of each whole frame of ``size`` samples (media_id, t, v); t is the frame's number."""
    frames = samples.groupBy("media_id", F.floor(F.col("t") / size).cast("long").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"), F.count("*").alias("n"))
    frames = frames.filter(F.col("n") == size).select("media_id", "frame", F.transform("s", lambda x: x["v"]).alias("v"))
    kind = samples.schema["media_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            mags = np.abs(np.fft.rfft(x, axis=1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * mags.shape[1]), pa.array(mags.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["media_id", "t", "mags"])

    return frames.mapInArrow(run, f"media_id {kind}, t bigint, mags array<double>")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def features(spectra_: DataFrame) -> DataFrame:
    """(media_id, t, centroid, contrast, rolloff, flux): the constant part is left out. contrast: the
    mean over bands of the log ratio of a band's strongest to its weakest bin. flux: rises since the
    frame before."""
    m = F.slice("mags", 2, F.size("mags") - 1)
    rows = spectra_.withColumn("m", m).withColumn("total", _sum(F.col("m")))
    k = F.sequence(F.lit(1), F.size("m"))
    centroid = F.when(F.col("total") > 0, _sum(F.zip_with("m", k, lambda v, i: v * i)) / F.col("total")).otherwise(0.0)
    cum = F.aggregate("m", F.array().cast("array<double>"), lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + v)))
    rolloff = F.size(F.filter(cum, lambda c: c < LEVEL * F.col("total"))) + F.when(F.col("total") > 0, 1).otherwise(0)
    width = F.ceil(F.size("m") / F.lit(BANDS)).cast("int")
    bands = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.slice(F.col("m"), b * width + 1, width)), lambda b: F.size(b) > 0)
    contrast = _sum(F.transform(bands, lambda b: F.log10((F.array_max(b) + 1) / (F.array_min(b) + 1)))) / F.size(bands)
    before = F.lag("m").over(Window.partitionBy("media_id").orderBy("t"))
    flux = F.coalesce(_sum(F.zip_with("m", before, lambda a, b: F.greatest(F.lit(0.0), a - b))), F.lit(0.0))
    return rows.select("media_id", "t", centroid.alias("centroid"), contrast.alias("contrast"), rolloff.cast("double").alias("rolloff"), flux.alias("flux"))


def excitement(features_: DataFrame, length: int = 4) -> DataFrame:
    """(media_id, t, spectral, beat): scaled mixes of the features, smoothed and scaled again."""
    parts = features_.withColumns({n: scaled(F.col(n)) for n in ("centroid", "contrast", "rolloff", "flux")})
    mixed = parts.withColumn("s", CENTROID * F.col("centroid") + CONTRAST * F.col("contrast") + ROLLOFF * F.col("rolloff"))
    smooth = mixed.select("media_id", "t", moving_average(F.col("s"), length).alias("s"), moving_average(F.col("flux"), 2).alias("b"))
    return smooth.select("media_id", "t", scaled(F.col("s")).alias("spectral"), scaled(F.col("b")).alias("beat"))
