"""Queries on the hourly activity series, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import signals as ops
from tideline.sources import model

GAPPY = """g AS (SELECT event_type AS media_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS BIGINT) AS t, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"""
SIG = GAPPY + """,
sig AS (SELECT l.media_id, l.t, coalesce(g.v, 0.0) AS v FROM (SELECT media_id, unnest(range(0, last + 1)) AS t FROM (SELECT media_id, max(t) AS last FROM g GROUP BY 1)) l LEFT JOIN g ON l.media_id = g.media_id AND l.t = g.t)"""
NORM = SIG + """,
norm AS (SELECT media_id, t, CASE WHEN max(v) OVER m - min(v) OVER m < 1e-8 THEN 0 ELSE (v - min(v) OVER m) / (max(v) OVER m - min(v) OVER m) END AS v FROM sig WINDOW m AS (PARTITION BY media_id))"""
SMOOTH = """sm AS (SELECT media_id, t, sum(v) OVER (PARTITION BY media_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS s, count(*) OVER (PARTITION BY media_id) AS n, v FROM sig)"""
CHANGE = SMOOTH + """,
sm2 AS (SELECT media_id, t, CASE WHEN n >= 10 THEN s ELSE v END AS s FROM sm),
gr AS (SELECT media_id, t, greatest(0.0, CASE WHEN lag(s) OVER o IS NOT NULL AND lead(s) OVER o IS NOT NULL THEN (lead(s) OVER o - lag(s) OVER o) / 2 ELSE coalesce(lead(s) OVER o - s, s - lag(s) OVER o, 0.0) END) AS c FROM sm2 WINDOW o AS (PARTITION BY media_id ORDER BY t)),
chg AS (SELECT media_id, t, CASE WHEN max(c) OVER (PARTITION BY media_id) > 1e-8 THEN c / max(c) OVER (PARTITION BY media_id) ELSE 0 END AS change FROM gr)"""
QUIET = 0.15
SILENCE = f"""q AS (SELECT media_id, t, v, v < {QUIET} AS quiet, coalesce(lag(v < {QUIET}) OVER (PARTITION BY media_id ORDER BY t), false) AS was FROM norm),
r AS (SELECT media_id, t, quiet, sum(CASE WHEN quiet AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t) AS run FROM q),
sil AS (SELECT media_id, CAST(min(t) AS DOUBLE) AS s_start, CAST(max(t) AS DOUBLE) AS s_end FROM r WHERE quiet GROUP BY media_id, run HAVING max(t) - min(t) >= 0.5)"""
CONTRAST = """w AS (SELECT media_id, t, max(1 - (t - s_end) / 6) AS w FROM (SELECT media_id, s_end, unnest(range(CAST(s_end AS BIGINT), CAST(s_end AS BIGINT) + 7)) AS t FROM sil) GROUP BY 1, 2),
c0 AS (SELECT n.media_id, n.t, greatest(0.0, coalesce(n.v * w.w, 0.0)) AS c FROM norm n LEFT JOIN w ON n.media_id = w.media_id AND n.t = w.t),
con AS (SELECT media_id, t, CASE WHEN max(c) OVER (PARTITION BY media_id) > 1e-8 THEN least(1.0, c / max(c) OVER (PARTITION BY media_id)) ELSE 0 END AS contrast FROM c0)"""


def normal(spark, sf):
    return model.signal(spark, sf).select("media_id", "t", ops.scaled(F.col("v")).alias("v"))


def silence(spark, sf):
    return ops.silences(normal(spark, sf), QUIET)


def contrast(spark, sf):
    return ops.silence_contrast(normal(spark, sf), silence(spark, sf), 6)


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def windows(spark, sf):
    """Windows of 24 hours, every 12."""
    ends = model.signal(spark, sf, filled=False).groupBy("media_id").agg(F.max("t").alias("last")).filter("last >= 24")
    each = ends.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 24, F.lit(12).cast("long"))).alias("a"))
    return each.select("media_id", F.col("a").cast("double").alias("w_start"), (F.col("a") + 24).cast("double").alias("w_end"))


WINDOWS = """win AS (SELECT media_id, CAST(a AS DOUBLE) AS w_start, CAST(a + 24 AS DOUBLE) AS w_end FROM (SELECT media_id, unnest(range(0, max(t) - 23, 12)) AS a FROM g GROUP BY media_id HAVING max(t) >= 24))"""

QUERIES = {
    "signal_filled": (lambda s, sf: model.signal(s, sf), f"WITH {SIG} SELECT media_id, t, v FROM sig"),
    "rms_frames": (
        lambda s, sf: rounded(ops.framed_rms(model.signal(s, sf), 24), "rms"),
        f"WITH {SIG} SELECT media_id, CAST(floor(t / 24) AS BIGINT) AS frame, round(sqrt(avg(v * v)), 6) AS rms FROM sig GROUP BY 1, 2",
    ),
    "moving_average": (
        lambda s, sf: model.signal(s, sf).select("media_id", "t", F.round(ops.moving_average(F.col("v"), 10), 6).alias("smooth")),
        f"WITH {SIG}, {SMOOTH} SELECT media_id, t, round(s, 6) AS smooth FROM sm",
    ),
    "minmax_norm": (lambda s, sf: rounded(normal(s, sf), "v"), f"WITH {NORM} SELECT media_id, t, round(v, 6) AS v FROM norm"),
    "flat_one_norm": (
        lambda s, sf: model.signal(s, sf).withColumn("v", F.when(F.col("media_id") == "click", 1.0).otherwise(F.col("v"))).select("media_id", "t", F.round(ops.scaled_flat_one(F.col("v")), 6).alias("v")),
        f"""WITH {SIG}, x AS (SELECT media_id, t, CASE WHEN media_id = 'click' THEN 1.0 ELSE v END AS v FROM sig)
SELECT media_id, t, round(CASE WHEN max(v) OVER m - min(v) OVER m >= 1e-8 THEN (v - min(v) OVER m) / (max(v) OVER m - min(v) OVER m) WHEN max(v) OVER m > 1e-8 THEN 1.0 ELSE 0.0 END, 6) AS v FROM x WINDOW m AS (PARTITION BY media_id)""",
    ),
    "max_norm": (
        lambda s, sf: model.signal(s, sf).select("media_id", "t", F.round(ops.share_of_max(F.col("v")), 6).alias("v")),
        f"WITH {SIG} SELECT media_id, t, round(CASE WHEN max(v) OVER m > 1e-8 THEN least(1.0, greatest(0.0, v / max(v) OVER m)) ELSE 0 END, 6) AS v FROM sig WINDOW m AS (PARTITION BY media_id)",
    ),
    "energy_change": (lambda s, sf: rounded(ops.energy_change(model.signal(s, sf)), "change"), f"WITH {SIG}, {CHANGE} SELECT media_id, t, round(change, 6) AS change FROM chg"),
    "silence_regions": (silence, f"WITH {NORM}, {SILENCE} SELECT media_id, s_start, s_end FROM sil"),
    "silence_contrast": (lambda s, sf: rounded(contrast(s, sf), "contrast"), f"WITH {NORM}, {SILENCE}, {CONTRAST} SELECT media_id, t, round(contrast, 6) AS contrast FROM con"),
    "resample_linear": (
        lambda s, sf: rounded(ops.resample(model.signal(s, sf, filled=False), 0.5), "v"),
        f"""WITH {GAPPY}, gr AS (SELECT media_id, k * 0.5::DOUBLE AS t FROM (SELECT media_id, unnest(range(0, max(t) * 2)) AS k FROM g GROUP BY media_id)),
a AS (SELECT gr.media_id, gr.t, g.t AS a_t, g.v AS a_v FROM gr ASOF LEFT JOIN g ON gr.media_id = g.media_id AND gr.t >= g.t),
b AS (SELECT a.*, g.t AS b_t, g.v AS b_v FROM a ASOF LEFT JOIN g ON a.media_id = g.media_id AND a.t <= g.t)
SELECT media_id, t, round(CASE WHEN a_t IS NULL THEN b_v WHEN b_t IS NULL OR a_t = b_t THEN a_v ELSE a_v + (b_v - a_v) * (t - a_t) / (b_t - a_t) END, 6) AS v FROM b""",
    ),
    "audio_in_window": (
        lambda s, sf: rounded(ops.mean_in_windows(windows(s, sf), normal(s, sf)), "energy"),
        f"""WITH {NORM}, {WINDOWS} SELECT w.media_id, w_start, w_end, round(coalesce(least(1.0, greatest(0.0, avg(v))), 0.5), 6) AS energy
FROM win w LEFT JOIN norm n ON n.media_id = w.media_id AND n.t >= w_start AND n.t <= w_end GROUP BY 1, 2, 3""",
    ),
}
