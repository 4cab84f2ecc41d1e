"""Queries on cut lists, captions, settings and lexicon loading, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as fn
from tideline.operators import lexicon, render, select, windows
from tideline.plans import dims
from tideline.plans.speech import SEG
from tideline.plans.windows import CLIPS_SQL, GAP_CLASH, OVER_CLASH, STORY_SQL, UNION_SQL, clips, greedy_sql, stories, union
from tideline.sources import model

DEFAULTS = {"platform": "reel", "clips": "5"}


def files(spark, sf):
    """A file for each clip; names with quotes and backslashes among them."""
    name = F.concat(F.lit("out\\it's "), F.col("media_id").cast("string"), F.lit("_"), F.col("clip").cast("string"), F.lit(".mp4"))
    return clips(spark, sf).withColumn("file", name)


def durations(spark, sf):
    """Three readers of a conversation's length: one for every third, one for even ids, one for all."""
    ends = model.segments(spark, sf).groupBy("media_id").agg(F.max("seg_end").alias("last"), F.sum("word_count").alias("words"))
    first, second = F.when(F.col("media_id") % 3 == 0, F.round("last", 3)), F.when(F.col("media_id") % 2 == 0, F.round(F.col("last"), 1))
    return ends.select("media_id", model.media_duration(first, second, F.col("words").cast("double")).alias("seconds"))


def settings(spark, sf):
    turns = model.table(spark, sf, "conversations")
    stored = turns.filter("conv_id % 4 = 0").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    stored = stored.select(F.col("conv_id").cast("string").alias("user"), F.col("role").alias("key"), F.col("n").cast("string").alias("value"))
    found = model.settings_of(stored, turns.select(F.col("conv_id").cast("string").alias("user")), DEFAULTS)
    return found.select("user", F.array_join(F.array_sort(F.transform(F.map_entries("settings"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("settings"))


def strategies(spark, sf):
    """Series without clicks have nine factors; the longest windows of two of them stand for semantic ones."""
    rows = union(spark, sf)
    nine = rows.filter("size <= 36 AND media_id != 'click'")
    semantic = rows.filter("size = 60 AND media_id IN ('view', 'click')")
    return windows.dispatch(rows, nine, semantic)


QUERIES = {
    "select_surplus": (
        lambda s, sf: select.surplus(stories(s, sf)),
        f"""WITH {STORY_SQL}, {greedy_sql('sr', ['rank', 'score'], 10, OVER_CLASH)},
pool AS (SELECT media_id, x.a AS w_start, x.b AS w_end, -x.k1 AS score FROM ch), {greedy_sql('pool', ['score'], 5, GAP_CLASH).replace('ch AS', 'ch2 AS', 1)}
SELECT media_id, x.a AS w_start, x.b AS w_end, -x.k0 AS score FROM ch2""",
    ),
    "strategy_dispatch": (
        strategies,
        f"""WITH {UNION_SQL} SELECT media_id, w_start, w_end, score, 'five' AS strategy FROM un WHERE media_id = 'click'
UNION ALL SELECT media_id, w_start, w_end, score, 'nine' FROM un WHERE size <= 36 AND media_id NOT IN ('click', 'view')
UNION ALL SELECT media_id, w_start, w_end, score, 'semantic' FROM un WHERE size = 60 AND media_id = 'view'""",
    ),
    "segment_specs": (
        lambda s, sf: render.segment_specs(clips(s, sf), 1920, 1080, [F.lit("eq=contrast=1.10"), F.lit("null")]),
        f"""WITH {CLIPS_SQL} SELECT media_id, clip, format('{{:.3f}}', w_start::DOUBLE) AS seek, format('{{:.3f}}', (w_end - w_start)::DOUBLE) AS length,
'scale=1920:1080:force_original_aspect_ratio=decrease,pad=1920:1080:(ow-iw)/2:(oh-ih)/2:black,eq=contrast=1.10' AS video FROM clips""",
    ),
    "landscape_specs": (
        lambda s, sf: dims.rows(s, dims.PLATFORMS, "platform string, width int, height int, least int, most int").select("platform", render.landscape(F.col("width"), F.col("height")).alias("video")),
        f"""SELECT platform, format('scale={{}}:{{}}:force_original_aspect_ratio=decrease,pad={{}}:{{}}:(ow-iw)/2:(oh-ih)/2:black', width, height, width, height) AS video
FROM (VALUES {dims.sql_values(dims.PLATFORMS)}) t(platform, width, height, least, most)""",
    ),
    "concat_specs": (
        lambda s, sf: render.concat_specs(files(s, sf)),
        f"""WITH {CLIPS_SQL}, f AS (SELECT media_id, clip, 'out/it''\\''''s ' || media_id || '_' || clip || '.mp4' AS file FROM clips)
SELECT media_id, count(*) AS files, CASE WHEN count(*) > 1 THEN string_agg('file ''' || file || '''' || chr(10), '' ORDER BY clip) END AS list,
CASE WHEN count(*) > 1 THEN 'loudnorm=I=-16.0:TP=-1.5:LRA=11' ELSE 'copy' END AS audio FROM f GROUP BY 1""",
    ),
    "captions": (
        lambda s, sf: model.table(s, sf, "pages").select("page_id", F.sha2(fn.plain_caption(F.col("html")), 256).alias("plain"), F.sha2(fn.escaped(F.col("html")), 256).alias("escaped")),
        """SELECT page_id, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain,
sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""",
    ),
    "lexicon_load": (
        lambda s, sf: lexicon.loaded(model.table(s, sf, "conversations").select(F.concat(F.lit("  "), F.upper("role"), F.lit(" ")).alias("phrase")).unionByName(dims.rows(s, [(h,) for h in (*dims.HOOKS, "", "WITH ")], "phrase string"))),
        f"""SELECT DISTINCT phrase FROM (SELECT trim(lower('  ' || upper(role) || ' ')) AS phrase FROM conversations
UNION ALL SELECT trim(lower(h)) FROM (VALUES {dims.sql_values([(h,) for h in (*dims.HOOKS, 'WITH ')])}) t(h)) WHERE phrase <> ''""",
    ),
    "media_duration": (
        durations,
        f"""WITH {SEG} SELECT media_id, coalesce(CASE WHEN media_id % 3 = 0 THEN round(max(seg_end), 3) END,
CASE WHEN media_id % 2 = 0 THEN round(max(seg_end), 1) END, sum(word_count)::DOUBLE) AS seconds FROM seg GROUP BY media_id""",
    ),
    "settings_objects": (
        settings,
        """WITH st AS (SELECT conv_id, string_agg(role || '=' || n, ',' ORDER BY role || '=' || n) AS s
FROM (SELECT conv_id, role, count(*) AS n FROM conversations WHERE conv_id % 4 = 0 GROUP BY 1, 2) GROUP BY 1)
SELECT DISTINCT CAST(c.conv_id AS VARCHAR) AS user, coalesce(s, 'clips=5,platform=reel') AS settings FROM conversations c LEFT JOIN st ON c.conv_id = st.conv_id""",
    ),
}
