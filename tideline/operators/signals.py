"""Time-series operators: windows over (media_id ordered by t), never a self-join of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-8


def ordered(*keys: str):
    return Window.partitionBy(*keys or ("media_id",)).orderBy("t")


def whole(*keys: str):
    return Window.partitionBy(*keys or ("media_id",))


def framed_rms(signal: DataFrame, hop: int) -> DataFrame:
    """(media_id, frame, rms) by hop samples; a silent series is all zeros."""
    frames = signal.groupBy("media_id", F.floor(F.col("t") / hop).cast("long").alias("frame")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    loudest = F.max("rms").over(whole())
    return frames.select("media_id", "frame", F.when(loudest < 1e-7, 0.0).otherwise(F.col("rms")).alias("rms"))


def moving_average(v: Column, length: int) -> Column:
    """Centred; places outside the series count as zeros, and the divisor is always the length."""
    return F.sum(v).over(ordered().rowsBetween(-(length // 2), (length - 1) // 2)) / length


def scaled(v: Column, over=None) -> Column:
    """Min-max to 0..1; a flat series is 0."""
    w = over or whole()
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high - low < FLAT, 0.0).otherwise((v - low) / (high - low))


def scaled_flat_one(v: Column) -> Column:
    """Min-max to 0..1; a flat series is 1 where it is positive, else 0."""
    low, high = F.min(v).over(whole()), F.max(v).over(whole())
    return F.when(high - low >= FLAT, (v - low) / (high - low)).when(high > FLAT, 1.0).otherwise(0.0)


def share_of_max(v: Column, least: float = FLAT) -> Column:
    """v over its maximum, in 0..1; 0 where the maximum is not above least."""
    high = F.max(v).over(whole())
    return F.when(high > least, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / high))).otherwise(0.0)


def gradient(v: Column) -> Column:
    """Half the difference of the neighbours; one-sided at the ends, 0 for a single sample."""
    before, after = F.lag(v).over(ordered()), F.lead(v).over(ordered())
    both = F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2)
    return F.coalesce(both, after - v, v - before, F.lit(0.0))


def energy_change(signal: DataFrame, length: int = 10) -> DataFrame:
    """(media_id, t, change): rises of the smoothed series, as a share of the largest."""
    n = F.count("*").over(whole())
    smooth = signal.withColumn("s", F.when(n >= length, moving_average(F.col("v"), length)).otherwise(F.col("v")))
    rise = smooth.withColumn("g", F.greatest(F.lit(0.0), gradient(F.col("s"))))
    return rise.select("media_id", "t", share_of_max(F.col("g")).alias("change"))


def silences(signal: DataFrame, below: float = 0.05, least: float = 0.5) -> DataFrame:
    """(media_id, s_start, s_end): runs of samples below a level, first to last, that last least."""
    quiet = F.col("v") < below
    fresh = F.when(quiet & ~F.coalesce(F.lag(quiet).over(ordered()), F.lit(False)), 1).otherwise(0)
    runs = signal.withColumn("run", F.sum(fresh).over(ordered())).filter(quiet).groupBy("media_id", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return runs.filter(F.col("b") - F.col("a") >= least).select("media_id", F.round(F.col("a").cast("double"), 3).alias("s_start"), F.round(F.col("b").cast("double"), 3).alias("s_end"))


def silence_contrast(signal: DataFrame, silence: DataFrame, span: int = 2) -> DataFrame:
    """(media_id, t, contrast): what follows a silence weighs most, falling to nothing after span.

    Samples may stand at any times. Each silence is exploded to the span + 1 whole seconds it reaches and
    meets the samples of a second by equality; of one second's samples and silences, the ends that reach
    a sample are tested then. There is no range join over a media item."""
    reach = silence.select("media_id", "s_end", F.explode(F.sequence(F.floor("s_end").cast("long"), F.floor(F.col("s_end") + span).cast("long"))).alias("_s"))
    met = signal.select("media_id", "t", F.floor("t").cast("long").alias("_s")).join(reach, ["media_id", "_s"])
    met = met.filter((F.col("t") >= F.col("s_end")) & (F.col("t") <= F.col("s_end") + span))
    weight = met.groupBy("media_id", "t").agg(F.max(1 - (F.col("t") - F.col("s_end")) / span).alias("w"))
    raw = signal.join(weight, ["media_id", "t"], "left").withColumn("c", F.greatest(F.lit(0.0), F.coalesce(F.col("v") * F.col("w"), F.lit(0.0))))
    return raw.select("media_id", "t", share_of_max(F.col("c")).alias("contrast"))


def resample(signal: DataFrame, step: float) -> DataFrame:
    """(media_id, t, v) on the grid 0, step, 2 * step, ... below the last sample's time, by linear
    interpolation; outside the samples the nearest one holds."""
    ends = signal.groupBy("media_id").agg(F.max("t").alias("last"))
    grid = ends.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("last") / step) - 1).cast("long"))).alias("k")).select("media_id", (F.col("k") * F.lit(step)).alias("t"))
    both = grid.withColumn("v", F.lit(None).cast("double")).withColumn("g", F.lit(True)).unionByName(signal.select("media_id", F.col("t").cast("double").alias("t"), "v").withColumn("g", F.lit(False)))
    own = F.when(~F.col("g"), F.struct("t", "v"))
    w = Window.partitionBy("media_id").orderBy("t", F.col("g").cast("int"))
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    met = both.withColumn("a", before).withColumn("b", after).filter("g")
    a, b = F.col("a"), F.col("b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("t") - a["t"]) / (b["t"] - a["t"])
    value = F.when(a.isNull(), b["v"]).when(b.isNull() | (b["t"] == a["t"]), a["v"]).otherwise(between)
    return met.select("media_id", "t", value.alias("v"))


def mean_in_windows(windows: DataFrame, signal: DataFrame, default: float = 0.5) -> DataFrame:
    """windows (media_id, w_start, w_end) with energy: the mean of the samples from start to end, both
    included, in 0..1; default without samples. Running sums stand in for a range join."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    sums = signal.select("media_id", "t", F.sum("v").over(w).alias("s"), F.count("*").over(w).alias("n"))
    last = sums.select("media_id", F.col("t").cast("double").alias("at"), "s", "n")
    marks = windows.select("media_id", F.explode(F.array(F.struct(F.col("w_start").alias("at"), F.lit(0).alias("side"), "w_start", "w_end"), F.struct(F.col("w_end").alias("at"), F.lit(2).alias("side"), "w_start", "w_end"))).alias("m"))
    marks = marks.select("media_id", "m.*").distinct()
    both = marks.unionByName(last.select("media_id", "at", F.lit(1).alias("side"), "s", "n"), allowMissingColumns=True)
    # A start (0) sees the sums before it, an end (2) those up to it.
    seen = Window.partitionBy("media_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.select("media_id", "side", "w_start", "w_end", F.coalesce(F.last("s", True).over(seen), F.lit(0.0)).alias("s"), F.coalesce(F.last("n", True).over(seen), F.lit(0)).alias("n")).filter("side != 1")
    ends = got.groupBy("media_id", "w_start", "w_end").agg(*[F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 2) for c in ("s", "n")])
    mean = (F.col("s2") - F.col("s0")) / (F.col("n2") - F.col("n0"))
    energy = F.when(F.col("n2") > F.col("n0"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).otherwise(F.lit(default))
    return ends.select("media_id", "w_start", "w_end", energy.alias("energy"))
