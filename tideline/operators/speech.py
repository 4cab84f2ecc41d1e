"""Speech operators over segments and words. Windows start every second and last SPAN seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import count_of
from tideline.operators.signals import scaled_flat_one, share_of_max

SPAN = 5


def word_times(segments: DataFrame) -> DataFrame:
    """(media_id, seg_idx, nth, t): words spread evenly over their segment."""
    some = segments.filter("word_count > 0")
    each = some.select("media_id", "seg_idx", "seg_start", "duration", "word_count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("word_count") - 1)).alias("nth"))
    return each.select("media_id", "seg_idx", "nth", (F.col("seg_start") + (F.col("nth") + 0.5) * F.col("duration") / F.col("word_count")).alias("t"))


def grid(segments: DataFrame) -> DataFrame:
    """(media_id, t): whole seconds from 0 to below the end of the last segment."""
    ends = segments.groupBy("media_id").agg(F.max("seg_end").alias("last")).filter("last > 0")
    return ends.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil("last") - 1).cast("long"))).alias("t"))


def reached(start: Column, end: Column) -> Column:
    """The whole seconds t whose window [t, t + SPAN] overlaps (start, end) strictly."""
    first = F.greatest(F.lit(0).cast("long"), F.floor(start - SPAN).cast("long") + 1)
    last = F.ceil(end).cast("long") - 1
    return F.when(last >= first, F.sequence(first, last))


def over_grid(segments: DataFrame, held: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(media_id, t, sums...): aggregates of held (media_id, t, ...) for each second of the grid, over no rows
    where held has none. Both sides go by key to the same task; a join could take an exploded side for as
    small as its input and broadcast it."""
    seconds = grid(segments).withColumn("_on", F.lit(True))
    both = held.filter("media_id is not null").unionByName(seconds, allowMissingColumns=True)
    return both.groupBy("media_id", "t").agg(F.max("_on").alias("_on"), *[c.alias(k) for k, c in sums.items()]).filter("_on").drop("_on")


def speech_density(segments: DataFrame) -> DataFrame:
    """(media_id, t, words, density): words with t <= time < t + SPAN, and their scaled number. A word
    is exploded to the SPAN windows that hold it, and these are counted with the grid."""
    words = word_times(segments)
    first = F.greatest(F.lit(0).cast("long"), F.floor(F.col("t") - SPAN).cast("long") + 1)
    held = words.select("media_id", F.explode(F.sequence(first, F.floor("t").cast("long"))).alias("t")).withColumn("_w", F.lit(True))
    all_ = over_grid(segments, held, {"words": F.count("_w")})
    return all_.select("media_id", "t", "words", scaled_flat_one(F.col("words").cast("double")).alias("density"))


def speech_pace(segments: DataFrame) -> DataFrame:
    """(media_id, t, pace): words a minute in the window, weighed by how long each segment is in it."""
    spoken = segments.select("media_id", "seg_start", "seg_end", "wpm", F.explode(reached(F.col("seg_start"), F.col("seg_end"))).alias("t"))
    overlap = F.least("seg_end", F.col("t") + F.lit(float(SPAN))) - F.greatest("seg_start", F.col("t").cast("double"))
    held = spoken.select("media_id", "t", "wpm", F.greatest(F.lit(0.0), overlap).alias("o"))
    all_ = over_grid(segments, held, {"p": F.sum(F.col("o") * F.col("wpm")), "o": F.sum("o")})
    all_ = all_.select("media_id", "t", F.round(F.when(F.col("o") > 0, F.col("p") / F.col("o")).otherwise(0.0), 6).alias("raw"))
    return all_.select("media_id", "t", "raw", scaled_flat_one(F.col("raw")).alias("pace"))


def speech_summary(segments: DataFrame) -> DataFrame:
    """(media_id, n_segments, words, transcript, avg_wpm)."""
    lines = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    sums = segments.groupBy("media_id").agg(F.count("*").alias("n_segments"), F.sum("word_count").alias("words"), F.max("seg_end").alias("total"), F.array_join(F.transform(lines, lambda s: s["text"]), " ").alias("transcript"))
    rate = F.when(F.col("total") > 0, F.round(F.col("words") / F.col("total") * 60, 2)).otherwise(0.0)
    return sums.select("media_id", "n_segments", "words", "transcript", rate.alias("avg_wpm"))


def phrase_hits(segments: DataFrame, phrases: tuple[str, ...], parts: dict[str, Column], weights: tuple[float, ...] = ()) -> DataFrame:
    """(media_id, t, hits, parts...): distinct phrases (or their weights, summed) in the lower-case text of
    each window, its segments joined by spaces in order, and sums over its segments; 0 without any.

    A segment's text is read once and never copied to its windows: phrases in it are bits. A phrase that
    spans segments has a space and reaches no further into a long one than its own length less one, so
    only that much of both ends travels, with a mark between that is in no phrase."""
    low = F.lower(F.coalesce("text", F.lit("")))
    bits = {f"_b{i}": F.lit(0).cast("long") for i in range(0, len(phrases), 60)}
    for i, p in enumerate(phrases):
        bits[f"_b{i // 60 * 60}"] += F.when(F.contains(low, F.lit(p)), F.lit(1 << i % 60).cast("long")).otherwise(F.lit(0).cast("long"))
    spanning = [p for p in phrases if not p or " " in p]
    most = max((len(p) for p in spanning), default=1) - 1
    mark = next(c for c in map(chr, range(1, 0xD800)) if not any(c in p for p in phrases))
    ends = F.when(F.length(low) > 2 * most, F.concat(F.substring(low, 1, most), F.lit(mark), F.substring(low, -most, most) if most > 0 else F.lit(""))).otherwise(low)
    own = {"_e": F.when(F.col("text").isNotNull(), ends)} if spanning else {}
    each = segments.withColumns(bits | own | parts | {"_t": reached(F.col("seg_start"), F.col("seg_end"))})
    held = each.select("media_id", "seg_idx", *bits, *own, *parts, F.explode("_t").alias("t"))
    lines = {"_e": F.array_sort(F.collect_list(F.when(F.col("seg_idx").isNotNull(), F.struct("seg_idx", "_e"))))} if spanning else {}
    sums = {k: F.coalesce(F.bit_or(k), F.lit(0).cast("long")) for k in bits} | {k: F.coalesce(F.sum(k), F.lit(0.0)) for k in parts} | lines
    met = over_grid(segments, held, sums)
    if spanning:
        met = met.withColumn("_e", F.array_join(F.transform("_e", lambda s: s["_e"]), " "))
    hit = lambda i, p: (F.shiftright(f"_b{i // 60 * 60}", i % 60).bitwiseAND(F.lit(1)) == 1) | (F.contains("_e", F.lit(p)) if p in spanning else F.lit(False))
    hits = sum((hit(i, p).cast("long") * (weights[i] if weights else 1) for i, p in enumerate(phrases)), F.lit(0).cast("long"))
    return met.select("media_id", "t", hits.alias("hits"), *parts)


def hook_scores(segments: DataFrame, hooks: tuple[str, ...]) -> DataFrame:
    """(media_id, t, hooks, score): distinct hook phrases in the window's text, over the most of any
    window."""
    found = phrase_hits(segments, hooks, {}).withColumnRenamed("hits", "hooks")
    return found.select("media_id", "t", "hooks", share_of_max(F.col("hooks").cast("double"), 0.0).alias("score"))


def emotion_scores(segments: DataFrame, emotions: tuple[str, ...]) -> DataFrame:
    """(media_id, t, raw, score): marks, emotional words, words in capitals and fast lines. Marks, capitals
    and lines are counted once for each segment, as a space never joins two words or marks; all of them
    weigh multiples of a half, so their sums are exact in any order."""
    said = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(said, r"\s+"), lambda w: (F.length(w) >= 3) & (F.upper(w) == w) & w.rlike(r"\p{Lu}"))
    fast = F.when(F.col("wpm") > 180, 3.0).when(F.col("wpm") > 150, 1.5).otherwise(0.0)
    own = 2.0 * count_of(said, "!") + 1.5 * count_of(said, "?") + 2.0 * F.size(words) + fast
    found = phrase_hits(segments, ("!!", "??", *emotions), {"_own": own}, (3.0, 2.0, *[1.5] * len(emotions)))
    return found.select("media_id", "t", (F.col("hits") + F.col("_own")).alias("raw")).select("media_id", "t", "raw", share_of_max(F.col("raw"), 0.0).alias("score"))


def window_snippet(segments: DataFrame, windows: DataFrame, most: int = 150) -> DataFrame:
    """(media_id, w_start, w_end, snippet, exclaims, asks): the text of the overlapping segments, cut,
    with the densities of its marks."""
    from tideline.functions.text import snippet

    met = windows.join(segments, (windows["media_id"] == segments["media_id"]) & (segments["seg_end"] > windows["w_start"]) & (segments["seg_start"] < windows["w_end"]), "left").select(
        windows["media_id"], "w_start", "w_end", "seg_idx", "text"
    )
    lines = F.array_sort(F.collect_list(F.when(F.col("seg_idx").isNotNull(), F.struct("seg_idx", "text"))))
    joined = met.groupBy("media_id", "w_start", "w_end").agg(F.trim(F.array_join(F.transform(lines, lambda s: s["text"]), " ")).alias("said"))
    cut = joined.withColumn("snippet", snippet(F.col("said"), most))
    n = F.greatest(F.lit(1), F.size(F.filter(F.split("snippet", r"\s+"), lambda w: w != "")))
    return cut.select("media_id", "w_start", "w_end", "snippet", F.round(count_of(F.col("snippet"), "!") / n, 6).alias("exclaims"), F.round(count_of(F.col("snippet"), "?") / n, 6).alias("asks"))


