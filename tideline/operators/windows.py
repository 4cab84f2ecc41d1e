"""Window enumeration and scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import is_question, numbers


def saturated(v: Column, ceiling: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / ceiling)) if ceiling > 0 else F.lit(0.0)


def hopping(grid: DataFrame, factors: list[str], weights: tuple[float, ...], length: int, step: int, extra: dict | None = None) -> DataFrame:
    """Windows of ``length`` samples, every ``step``, over an evenly spaced grid (media_id, t, factors):
    (media_id, w_start, w_end, one mean per factor, total). A frame over the ordered samples gives each
    window's means, so nothing is exploded. A shorter series is one window."""
    order = Window.partitionBy("media_id").orderBy("t")
    frame = order.rowsBetween(0, length - 1)
    n = F.count("*").over(Window.partitionBy("media_id"))
    means = {f"{f}_mean": F.avg(f).over(frame) for f in factors}
    more = {k: make(frame) for k, make in (extra or {}).items()}
    end = F.coalesce(F.lead("t", length).over(order), F.max("t").over(Window.partitionBy("media_id")))
    rows = grid.withColumns({"idx": F.row_number().over(order) - 1, "n": n, "w_end": end, **means, **more})
    kept = rows.filter((F.col("idx") % step == 0) & ((F.col("idx") <= F.col("n") - length) | (F.col("idx") == 0)))
    total = sum((F.lit(w) * F.col(f"{f}_mean") for f, w in zip(factors, weights, strict=True)), F.lit(0.0))
    return kept.withColumn("total", total).select("media_id", F.col("t").alias("w_start"), "w_end", *means, *more, "total")


def sizes(least: int, most: int, default: int = 30) -> list[int]:
    """The window sizes that are tried: the default or least, the middle and the largest."""
    return sorted({max(default, least), (least + most) // 2, most})


@dataclass(frozen=True)
class Story:
    """Knobs of the story windows; the defaults are fixed values."""

    least: float = 12.0
    most: float = 65.0
    content_required: float = 1.0
    gate_payoff: float = 0.9
    gate_info: float = 0.9
    ceilings: dict = field(default_factory=lambda: {"content": 6.0, "info": 7.0, "reaction": 3.0, "arc": 2.0, "filler": 3.0, "density": 3.0})
    weights: dict = field(default_factory=lambda: {"content": 0.42, "arc": 0.18, "reaction": 0.12, "info": 0.18, "filler": 1.0, "audio": 0.1})
    density_part: float = 0.45
    strong: tuple = ("payoff", "clutch", "tactic", "trading", "analysis", "podcast_story", "instruction", "error", "stake")
    info: tuple = ("tactic", "trading", "analysis", "podcast_story", "instruction", "payoff", "error")


GROUPS = ("payoff", "clutch", "tactic", "trading", "analysis", "podcast_story", "instruction", "error", "stake", "setup", "reaction", "hype", "filler")


def segment_values(segments: DataFrame, scores: DataFrame) -> DataFrame:
    """segments with one column for each group's score, and the counts of numbers and questions."""
    wide = scores.groupBy("media_id", "seg_idx").agg(*[F.sum(F.when(F.col("grp") == g, F.col("score"))).alias(f"g_{g}") for g in GROUPS])
    own = segments.join(wide, ["media_id", "seg_idx"], "left").withColumns({f"g_{g}": F.coalesce(f"g_{g}", F.lit(0.0)) for g in GROUPS})
    return own.withColumn("numbers", F.size(numbers(F.col("text")))).withColumn("asks", is_question(F.col("text")).cast("int"))


def story_windows(values: DataFrame, knobs: Story | None = None, audio: Column | None = None, bin_seconds: float | None = None) -> DataFrame:
    """All runs of segments within the duration limits that pass the gates, with their scores.

    Sums over a run are differences of running sums. A run's end is met to its start by media and by
    the time bin of the end, so a long media item never meets itself in one block."""
    k = knobs or Story()
    wide = bin_seconds or k.most
    order = Window.partitionBy("media_id").orderBy("seg_idx")
    names = [f"g_{g}" for g in GROUPS] + ["numbers", "asks"]
    sums = values.withColumns({f"c_{n}": F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) for n in names})
    total = F.max("seg_end").over(Window.partitionBy("media_id"))
    sums = sums.withColumn("media_end", total)
    starts = sums.filter(F.col("seg_start") < F.col("media_end")).select(
        "media_id", F.col("seg_idx").alias("first_seg"), F.col("seg_start").alias("a"), F.col("text").alias("first_text"), *[(F.col(f"c_{n}") - F.col(n)).alias(f"b_{n}") for n in names],
        F.explode(F.sequence(F.floor((F.col("seg_start") + k.least) / wide).cast("long"), F.floor((F.col("seg_start") + k.most) / wide).cast("long"))).alias("bin"),
    )
    ends = sums.select("media_id", F.col("seg_idx").alias("last_seg"), F.col("seg_end").alias("z"), F.col("text").alias("last_text"), *[f"c_{n}" for n in names], F.floor(F.col("seg_end") / wide).cast("long").alias("bin"))
    runs = starts.join(ends, ["media_id", "bin"]).filter((F.col("last_seg") >= F.col("first_seg")) & (F.col("z") - F.col("a") >= k.least) & (F.col("z") - F.col("a") <= k.most))
    v = {n.removeprefix("g_"): F.round(F.col(f"c_{n}") - F.col(f"b_{n}"), 9) for n in names}
    runs = runs.withColumns({f"s_{g}": e for g, e in v.items()})
    s = lambda g: F.col(f"s_{g}")
    content = sum((s(g) for g in k.strong), F.lit(0.0))
    gate = (s("payoff") >= k.gate_payoff) | (s("clutch") >= k.gate_payoff) | (s("tactic") >= k.gate_info) | (s("instruction") >= k.gate_info) | (s("error") >= k.gate_payoff)
    runs = runs.withColumn("content_raw", F.round(content, 9)).filter(gate & (F.col("content_raw") >= k.content_required))
    arc = sum((F.when((s(g) > 0) & (s("setup") > 0), F.least(s(g), s("setup") * 0.8)).otherwise(0.0) for g in ("payoff", "clutch", "error")), F.lit(0.0))
    info = sum((s(g) for g in k.info), F.lit(0.0)) + 0.35 * F.least(s("numbers"), F.lit(4)) + 0.20 * F.least(s("asks"), F.lit(2))
    edge = F.lit(1.0) - F.when(F.trim("first_text").rlike(r"^\p{Ll}"), 0.25).otherwise(0.0) - F.when((F.trim("last_text") != "") & ~F.trim("last_text").rlike("[.!?।]$"), 0.25).otherwise(0.0)
    c = k.ceilings
    runs = runs.withColumns({"arc_raw": F.round(arc, 9), "duration": F.col("z") - F.col("a"), "boundary": F.greatest(F.lit(0.0), edge), "audio": audio if audio is not None else F.lit(0.5)})
    runs = runs.withColumns({
        "content": saturated(F.col("content_raw"), c["content"]), "arc": saturated(F.col("arc_raw"), c["arc"]), "reaction": saturated(s("reaction") + 0.5 * s("hype"), c["reaction"]),
        "info": saturated(info, c["info"]), "filler": -saturated(-s("filler"), c["filler"]),
    })
    w = k.weights
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    runs = runs.withColumn("base", clamp(sum((w[n] * F.col(n) for n in ("content", "arc", "reaction", "info", "filler")), F.lit(0.0))))
    runs = runs.withColumn("score", clamp((1 - w["audio"]) * F.col("base") + w["audio"] * F.col("audio")) * (0.9 + 0.1 * F.col("boundary")))
    runs = runs.withColumn("density", F.when(F.col("duration") > 0, F.col("base") / F.col("duration") * 60).otherwise(0.0))
    # Rounded twice, so that the last bits of a sum don't decide a tie.
    out = runs.select(
        "media_id", "first_seg", "last_seg", F.round("a", 2).alias("w_start"), F.round("z", 2).alias("w_end"), F.round("duration", 2).alias("duration"),
        *[F.round(F.round(n, 9), 4).alias(n) for n in ("score", "content", "arc", "reaction", "info", "filler", "audio", "boundary", "density")], *[f"s_{g}" for g in ("payoff", "clutch", "tactic", "instruction", "error", "stake", "filler", "numbers")], "arc_raw",
    )
    return out.withColumn("rank", F.round(F.round(k.density_part * saturated(F.col("density"), c["density"]) + (1 - k.density_part) * F.col("score"), 9), 4))


def reason(windows: DataFrame) -> DataFrame:
    """windows with a line that says what speaks for them."""
    labels = (("payoff", "result"), ("clutch", "turning point"), ("tactic", "method"), ("instruction", "advice"), ("error", "mistake"), ("stake", "stakes"))
    parts = [F.when(F.col(f"s_{g}") >= 0.8, F.lit(name)) for g, name in labels]
    parts.append(F.when(F.col("arc_raw") > 0.5, F.lit("whole story")))
    parts.append(F.when(F.col("s_numbers") > 0, F.concat(F.col("s_numbers").cast("int").cast("string"), F.lit(" numbers"))))
    parts.append(F.when(F.col("s_filler") < -0.5, F.lit("some filler")))
    line = F.concat_ws(" + ", *parts)
    return windows.withColumn("reason", F.when(line == "", "generic moment").otherwise(line))


def dispatch(five: DataFrame, nine: DataFrame, semantic: DataFrame) -> DataFrame:
    """(media_id, w_start, w_end, score, strategy): each media item's candidates by one strategy. Without
    the nine factors (nine has no rows of it) the five-factor windows count; with them the semantic
    windows, where there are any, else the nine-factor ones. Each argument has (media_id, w_start, w_end,
    score); the choice meets the rows by media_id only."""
    columns = ("media_id", "w_start", "w_end", "score")
    every = nine.select("media_id").distinct()
    told = semantic.select("media_id").distinct()
    parts = (
        (five.join(every, "media_id", "left_anti"), "five"),
        (nine.join(told, "media_id", "left_anti"), "nine"),
        (semantic.join(every, "media_id", "left_semi"), "semantic"),
    )
    out = [df.select(*columns).withColumn("strategy", F.lit(name)) for df, name in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
