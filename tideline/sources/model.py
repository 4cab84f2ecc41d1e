"""The engine's model tables, read from the input tables.

segment(media_id, seg_idx, seg_start, seg_end, text, word_count, duration, wpm): transcript lines.
signal(media_id, t, v): time series. Times are seconds (hours for the event series) as doubles.
Everything is keyed by media_id, so every operator partitions by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.text import tokens

#: Words a second at 150 words a minute.
RATE = 2.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wpm(words: Column, seconds: Column) -> Column:
    """Words a minute, 0 for no time."""
    return F.when(seconds > 0, F.round(words / seconds * 60, 2)).otherwise(F.lit(0.0))


def timed(lines: DataFrame) -> DataFrame:
    """Segments of lines (media_id, seg_idx, text), spoken one after another at RATE."""
    order = Window.partitionBy("media_id").orderBy("seg_idx")
    counted = lines.withColumn("word_count", F.size(tokens(F.col("text"))).cast("long"))
    # The start is a running sum of integers, so it does not depend on the order of float additions.
    before = F.coalesce(F.sum("word_count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = counted.withColumn("seg_start", before / RATE).withColumn("seg_end", (before + F.col("word_count")) / RATE).withColumn("duration", F.col("word_count") / RATE)
    return out.withColumn("wpm", wpm(F.col("word_count"), F.col("duration")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the conversations: a turn is a line."""
    turns = table(spark, sf_dir, "conversations")
    return timed(turns.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_idx"), "text"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the documents: a sentence is a line."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", r"[.!?\n]+")).alias("seg_idx", "text"))
    return timed(docs.withColumn("text", F.trim("text")).filter(F.col("text") != ""))


def signal(spark: SparkSession, sf_dir: str, filled: bool = True) -> DataFrame:
    """The hourly activity of each event type, (media_id, t, v): t counts hours since 2024. filled:
    hours without events are there as zeros; else the series has gaps."""
    events = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3600000000)).cast("long")
    sums = events.groupBy(F.col("event_type").alias("media_id"), hour.alias("t")).agg(F.round(F.sum("value"), 4).alias("v"))
    if not filled:
        return sums
    last = sums.groupBy("media_id").agg(F.max("t").alias("last"))
    grid = last.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("t"))
    return grid.join(sums, ["media_id", "t"], "left").select("media_id", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings kept as JSON lines, (user, key, value)."""
    return spark.read.schema("user string, key string, value string").json(path)


def write_settings(settings: DataFrame, path: str) -> None:
    settings.write.mode("overwrite").json(path)


def settings_of(settings: DataFrame, users: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """(user, settings map) for every user of users: what is stored, as it is, and the defaults only for
    users without any. A user's settings are one object, so they are one row."""
    own = settings.groupBy("user").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("stored"))
    default = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return users.select("user").distinct().join(own, "user", "left").select("user", F.coalesce("stored", default).alias("settings"))


def media_duration(*found: Column) -> Column:
    """The first duration that a reader gave, of readers in order of trust; null if none did."""
    return F.coalesce(*found)
