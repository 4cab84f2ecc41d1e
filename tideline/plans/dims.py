"""Small literal tables: vocabularies, weights and platforms. They are parameters of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOOKS = ("the on", "that is", "que la", "und die", "les ", "for the", "with", "not", "in the", "por que")
EMOTIONS = ("this", "die ", "pour", "eau", "tion", "heit")

#: group, phrase, weight: words that the input tables hold, so that results are not empty.
LEXICON = (
    ("payoff", "the", 0.15), ("payoff", "die", 0.2), ("payoff", "of the", 0.6), ("payoff", "la", 0.2), ("clutch", "that", 0.5), ("clutch", "que", 0.25),
    ("clutch", "und", 0.3), ("tactic", "with", 0.6), ("tactic", "mit", 0.6), ("tactic", "pour", 0.6), ("instruction", "this", 0.5), ("instruction", "para", 0.5),
    ("error", "was", 0.4), ("error", "nicht", 0.6), ("error", "pas", 0.4), ("setup", "from", 0.5), ("setup", "von", 0.4), ("setup", "dans", 0.4), ("setup", "por", 0.3),
    ("reaction", "and", 0.1), ("reaction", "et", 0.1), ("reaction", "y", 0.1), ("hype", "les", 0.2), ("hype", "los", 0.2), ("hype", "in the", 0.4),
    ("analysis", "for", 0.3), ("analysis", "der", 0.1), ("stake", "not", 0.3), ("filler", "in", -0.1), ("filler", "it", -0.1), ("filler", "en", -0.1), ("filler", "un", -0.1),
)
#: genre, keyword, weight, in order of precedence.
GENRES = (
    ("story", "that", 1.0), ("story", "was", 0.8), ("story", "dans", 0.8), ("story", "con", 0.5), ("guide", "with", 1.2), ("guide", "this", 0.9), ("guide", "mit", 1.0), ("guide", "pour", 1.0),
    ("news", "from", 1.1), ("news", "von", 1.0), ("news", "sur", 0.7), ("news", "por", 0.9), ("talk", "and", 0.4), ("talk", "und", 0.5), ("talk", "que", 0.5), ("music", "les", 0.6), ("music", "los", 0.6),
)
OPENERS = ("the", "that", "this", "die", "le", "la", "que", "from")
TRAILERS = ("and", "und", "et", "y", "that", "que", "mit", "for", "with", "de")
RESOLUTIONS = ("was", "is", "on", "ist", "en", "tion", "ing")

# --- fixed values: factor weights by category, in the order of FACTORS; the five-factor weights; platforms ---
FACTORS = ("audio_energy", "speech_density", "energy_change", "speech_pace", "silence_contrast", "spectral_excitement", "beat_strength", "hook_keywords", "emotion_markers")
PROFILES = {
    "default": (0.20, 0.15, 0.12, 0.10, 0.08, 0.10, 0.08, 0.10, 0.07),
    "gaming": (0.14, 0.10, 0.10, 0.09, 0.05, 0.08, 0.06, 0.26, 0.12),
    "podcast": (0.10, 0.22, 0.08, 0.12, 0.08, 0.05, 0.05, 0.20, 0.10),
    "comedy": (0.16, 0.12, 0.15, 0.08, 0.07, 0.18, 0.06, 0.10, 0.08),
    "motivation": (0.18, 0.16, 0.10, 0.18, 0.06, 0.06, 0.06, 0.14, 0.06),
    "tech": (0.10, 0.20, 0.08, 0.14, 0.06, 0.06, 0.06, 0.22, 0.08),
}
FIVE = (0.30, 0.25, 0.20, 0.15, 0.10)
#: name, width, height, least and most seconds
PLATFORMS = (("reel", 1080, 1920, 5, 90), ("short", 1080, 1920, 5, 180), ("wide", 1920, 1080, 10, 3600))
# --- end of the fixed values ---

PRESETS = (("vivid", "eq=contrast=1.10:saturation=1.30", "colorbalance=rm=0.03", "unsharp=5:5:0.8"), ("plain", "null", "null", "null"), ("warm", "eq=saturation=1.10", "colorbalance=rm=0.06:bm=-0.04", "null"))
CATEGORY_PRESET = (("gaming", "vivid"), ("podcast", "warm"), ("tech", "plain"))


def rows(spark: SparkSession, values, schema: str) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def lexicon(spark: SparkSession) -> DataFrame:
    return rows(spark, LEXICON, "grp string, phrase string, weight double")


def profiles(spark: SparkSession) -> DataFrame:
    return rows(spark, [(c, f, w) for c, ws in PROFILES.items() for f, w in zip(FACTORS, ws, strict=True)], "category string, factor string, weight double")


def checked(weights: DataFrame) -> DataFrame:
    """weights by category with their sum; an error where it is not 1 within 0.01."""
    total = weights.groupBy("category").agg(F.count("*").alias("factors"), F.round(F.sum("weight"), 6).alias("total"))
    fault: Column = F.assert_true(F.abs(F.col("total") - 1.0) <= 0.01, F.concat(F.lit("weights do not sum to 1: "), F.col("category")))
    return total.select("category", "factors", "total", fault.alias("fault")).filter("fault is null").drop("fault")


def platform(name: str) -> tuple:
    for row in PLATFORMS:
        if row[0] == name:
            return row
    raise ValueError(f"unknown platform {name}; known: {', '.join(p[0] for p in PLATFORMS)}")


def sql_values(values) -> str:
    """A VALUES list for the SQL twins."""
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in values)
