"""Boundary refinement, the virality formula and the fused score of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: lead-in, lead-out, and the coefficients of the formula ---
LEAD_IN, LEAD_OUT = 0.15, 0.20
LINEAR = {
    "energy_mean": 0.08, "energy_max": 0.04, "change": 0.04, "silence": 0.04, "spectral_mean": 0.06, "spectral_max": 0.04, "beat": 0.04, "density": 0.14, "pace": 0.10,
    "hook_count": 0.22, "hook_density": 0.12, "emotion": 0.08, "exclaims": 0.04, "asks": 0.04, "cliffhanger": 0.08,
}
CROSSED = {("hook_count", "density"): 0.08, ("hook_count", "spectral_mean"): 0.06, ("energy_mean", "density"): 0.04}
FUSED = {"score": 0.40, "virality": 0.30, "boundary": 0.15, "genre": 0.15}
# --- end of the fixed values ---


def virality(features: dict[str, Column]) -> Column:
    """The formula over features in 0..1, scaled by the sum of its coefficients so that it stays there.
    Absent features are 0; larger ones count as 1."""
    x = {n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), features[n])) if n in features else F.lit(0.0) for n in LINEAR}
    raw = sum((w * x[n] for n, w in LINEAR.items()), F.lit(0.0)) + sum((w * x[a] * x[b] for (a, b), w in CROSSED.items()), F.lit(0.0))
    return raw / (sum(LINEAR.values()) + sum(CROSSED.values()))


def feature_vector(rows: DataFrame, features: dict[str, Column]) -> DataFrame:
    """rows with a column for each feature, 0 where absent, and how energy and density go together."""
    cols = {f"f_{n}": F.coalesce(features.get(n, F.lit(0.0)), F.lit(0.0)) for n in LINEAR}
    out = rows.withColumns(cols)
    return out.withColumn("f_synergy", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f_energy_mean") * F.col("f_density") * 2)))


def refine(windows: DataFrame, segments: DataFrame, openers: tuple, trailers: tuple, resolutions: tuple, least: float = 15.0, most: float = 60.0) -> DataFrame:
    """windows (media_id, w_start, w_end, ...) with adj_start, adj_end, hook, resolution, boundary_score
    and complete: snapped to whole segments, longer by one segment where the last ends in mid-sentence."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-zऀ-ॿ]+"), F.lit(0))
    order = Window.partitionBy("media_id").orderBy("seg_idx")
    own = segments.withColumn("words", words).withColumn("total", F.max("seg_end").over(Window.partitionBy("media_id")))
    own = own.withColumns({"next_end": F.lead("seg_end").over(order), "next_words": F.lead("words").over(order)}).select("media_id", "seg_idx", "seg_start", "seg_end", "words", "total", "next_end", "next_words")
    names = windows.columns
    met = windows.join(own, "media_id").filter((F.col("seg_end") > F.col("w_start")) & (F.col("seg_start") < F.col("w_end")))
    row = F.struct("seg_idx", "seg_start", "seg_end", "words", "total", "next_end", "next_words")
    ends = met.groupBy(*names).agg(F.min(row).alias("a"), F.max(row).alias("z"))
    a, z = F.col("a"), F.col("z")
    last_of = lambda w: F.try_element_at(w, F.lit(-1))
    trails = lambda w: F.coalesce(last_of(w).isin(*trailers), F.lit(False))
    start = F.greatest(F.lit(0.0), a["seg_start"] - LEAD_IN)
    plain = F.least(z["total"], z["seg_end"] + LEAD_OUT)
    goes_on = trails(z["words"]) & z["next_end"].isNotNull() & (z["next_end"] + LEAD_OUT - start <= most)
    ends = ends.withColumns({"s": start, "e": F.when(goes_on, z["next_end"] + LEAD_OUT).otherwise(plain), "w": F.when(goes_on, z["next_words"]).otherwise(z["words"])})
    first = F.slice(a["words"], 1, 3)
    among = lambda words, some: F.arrays_overlap(words, F.array(*[F.lit(x) for x in some]))
    hook = F.when(among(first, openers), 0.95).when(F.size(a["words"]) >= 2, 0.75).otherwise(0.5)
    tail = F.when(F.size("w") >= 3, F.slice("w", -3, 3)).otherwise(F.col("w"))
    resolution = F.when(among(tail, resolutions), 0.95).when((F.size("w") > 0) & ~trails(F.col("w")), 0.80).otherwise(0.35)
    long = F.col("e") - F.col("s")
    end = F.when(long < least, F.least(a["total"], F.col("s") + least)).when(long > most, F.col("s") + most).otherwise(F.col("e"))
    out = ends.withColumns({"hook": hook, "resolution": resolution, "adj_start": F.round("s", 2), "adj_end": F.round(end, 2)})
    out = out.withColumns({"boundary_score": F.round(0.5 * F.col("hook") + 0.5 * F.col("resolution"), 3), "complete": (F.col("resolution") >= 0.70) & (F.col("hook") >= 0.60)})
    return out.select(*names, "adj_start", "adj_end", "hook", "resolution", "boundary_score", "complete")


def story_features() -> dict[str, Column]:
    """The formula's features of a scored story window."""
    c = F.col
    return {
        "energy_mean": c("audio"), "energy_max": c("audio"), "change": c("reaction") * 0.5, "silence": F.lit(0.3), "spectral_mean": c("reaction") * 0.6, "spectral_max": F.lit(0.8), "beat": F.lit(0.5),
        "density": F.least(F.lit(1.0), c("density") / 30), "pace": F.lit(0.7), "hook_count": c("content") * 2, "hook_density": F.least(F.lit(1.0), c("content") / 2), "emotion": c("reaction"), "exclaims": F.lit(0.1), "asks": F.lit(0.1),
    }


def fuse(score: Column, ml: Column, boundary: Column, genre: Column, fit: Column) -> Column:
    return FUSED["score"] * score + FUSED["virality"] * ml + FUSED["boundary"] * boundary + FUSED["genre"] * genre * fit
