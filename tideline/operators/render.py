"""Edit decisions, reports and chapters: what would be cut, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: the background's filters ---
BACKGROUND = "boxblur=25:5,eq=brightness=-0.12:contrast=0.90"
FIT, PAD = "scale={size}:force_original_aspect_ratio=decrease", "pad={size}:(ow-iw)/2:(oh-ih)/2:black"
LOUDNESS = "loudnorm=I=-16.0:TP=-1.5:LRA=11"
# --- end of the fixed values ---


def edit_decisions(clips: DataFrame, platforms: tuple) -> DataFrame:
    """Every clip for every platform: cut to the platform's longest, left out below its shortest. clips:
    (media_id, clip, w_start, w_end, score). The platforms are a literal array, so there is no join."""
    specs = F.array(*[F.struct(F.lit(n).alias("platform"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(float(a)).alias("least"), F.lit(float(b)).alias("most")) for n, w, h, a, b in platforms])
    each = clips.withColumn("p", F.explode(specs)).withColumn("duration", F.col("w_end") - F.col("w_start")).filter(F.col("duration") >= F.col("p.least"))
    end = F.when(F.col("duration") > F.col("p.most"), F.col("w_start") + F.col("p.most")).otherwise(F.col("w_end"))
    return each.select("media_id", "clip", "p.platform", "p.width", "p.height", "w_start", end.alias("cut_end"), F.round(end - F.col("w_start"), 2).alias("seconds"), "score")


def generation_report(decisions: DataFrame) -> DataFrame:
    """(platform, clips, media, seconds)."""
    return decisions.groupBy("platform").agg(F.count("*").alias("clips"), F.countDistinct("media_id").alias("media"), F.round(F.sum("seconds"), 2).alias("seconds"))


def chapters(clips: DataFrame, by_time: bool = True, whole: bool = False) -> DataFrame:
    """clips with chapter (from 1) and offset, the sum of the earlier durations: for each media item, or
    over all sources in order (whole). by_time: in order of start, else by falling score."""
    inner = [F.col("w_start"), F.col("w_end")] if by_time else [F.col("score").desc(), F.col("w_start"), F.col("w_end")]
    rows = clips.withColumn("duration", F.round(F.col("w_end") - F.col("w_start"), 2))
    order = Window.partitionBy("media_id").orderBy(*inner)
    inside = F.coalesce(F.sum("duration").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumns({"chapter": F.row_number().over(order), "offset": inside})
    if whole:
        # One row for each source meets in the global order; the chapters themselves stay where they are.
        total = rows.groupBy("media_id").agg(F.sum("duration").alias("_d"), F.count("*").alias("_n"))
        before = Window.orderBy("media_id").rowsBetween(Window.unboundedPreceding, -1)
        total = total.select("media_id", F.coalesce(F.sum("_d").over(before), F.lit(0.0)).alias("_o"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
        rows = rows.join(total, "media_id").withColumns({"chapter": F.col("chapter") + F.col("_c"), "offset": F.col("offset") + F.col("_o")}).drop("_o", "_c")
    return rows.withColumn("offset", F.round("offset", 2)).withColumn("chapter", F.col("chapter").cast("long"))


def filtergraph(width: Column, height: Column, parts: list[Column]) -> Column:
    """A two-layer layout: a blurred, darkened background and the picture with its corrections; parts
    that are 'null' or null are left out."""
    size = F.concat_ws(":", width.cast("string"), height.cast("string"))
    front = F.concat_ws(",", F.concat(F.lit("[0:v]scale="), width.cast("string"), F.lit(":-2")), *[F.when(p != "null", p) for p in parts])
    back = F.concat(F.lit("[0:v]scale="), size, F.lit(":force_original_aspect_ratio=increase,crop="), size, F.lit(f",{BACKGROUND}[bg]"))
    return F.concat_ws(";", back, F.concat(front, F.lit("[fg]")), F.lit("[bg][fg]overlay=(W-w)/2:(H-h)/2[outv]"))


def landscape(width: Column, height: Column, parts: list[Column] = ()) -> Column:
    """The picture scaled to fit and padded with black, with corrections; parts 'null' or null are left out."""
    size = F.concat_ws(":", width.cast("string"), height.cast("string"))
    fit, pad = (F.replace(F.lit(t), F.lit("{size}"), size) for t in (FIT, PAD))
    return F.concat_ws(",", fit, pad, *[F.when(p != "null", p) for p in parts])


def segment_specs(clips: DataFrame, width: int, height: int, parts: list[Column] = ()) -> DataFrame:
    """(media_id, clip, seek, length, video): how each clip is cut to a segment that others can follow."""
    time = lambda c: F.format_string("%.3f", c.cast("double"))
    return clips.select("media_id", "clip", time(F.col("w_start")).alias("seek"), time(F.col("w_end") - F.col("w_start")).alias("length"), landscape(F.lit(width), F.lit(height), list(parts)).alias("video"))


def concat_specs(files: DataFrame, loud: bool = True) -> DataFrame:
    """(media_id, files, list, audio) of (media_id, clip, file): one file is copied, so it has no list; of
    more the list names each in order of clip, quotes escaped. The list is a file's text, so it is one row
    for each output."""
    name = F.replace(F.replace("file", F.lit("\\"), F.lit("/")), F.lit("'"), F.lit("'\\''"))
    line = F.concat(F.lit("file '"), name, F.lit("'\n"))
    rows = files.groupBy("media_id").agg(F.count("*").alias("files"), F.array_sort(F.collect_list(F.struct("clip", line.alias("line")))).alias("l"))
    many = F.col("files") > 1
    audio = F.when(many & F.lit(loud), F.lit(LOUDNESS)).otherwise(F.lit("copy"))
    return rows.select("media_id", "files", F.when(many, F.array_join(F.transform("l", lambda x: x["line"]), "")).alias("list"), audio.alias("audio"))
