"""Queries that enumerate, score, select and cut windows, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.text import QUESTION_WORDS
from tideline.operators import lexicon, render, select, signals, story, windows
from tideline.plans import dims
from tideline.plans.signals import CHANGE, CONTRAST, NORM, SILENCE, SMOOTH, contrast, normal
from tideline.plans.speech import QUOTED, SEG, SENT
from tideline.plans.text import GENRE_SQL, GROUPS, HITS, LEX, TOKENS, hits
from tideline.sources import model

FIVE = ["energy", "density", "change", "contrast", "pace"]
NINE = [*FIVE, "spectral", "beat", "hook", "emotion"]


def factors(spark, sf):
    """(media_id, t, the nine factors): the hourly activity seen in nine ways, one for each factor."""
    base = model.signal(spark, sf)
    norm = normal(spark, sf).withColumnRenamed("v", "energy")
    change = signals.energy_change(base)
    smooth = base.select("media_id", "t", signals.moving_average(F.col("v"), 10).alias("s"))
    smooth = smooth.select("media_id", "t", signals.scaled(F.col("s")).alias("density"))
    out = norm.join(change, ["media_id", "t"]).join(contrast(spark, sf), ["media_id", "t"]).join(smooth, ["media_id", "t"])
    return out.withColumns({"pace": 1 - F.col("density"), "spectral": F.col("energy") * F.col("density"), "beat": F.col("change") * F.col("energy"), "hook": F.col("contrast") * 0.5, "emotion": (F.col("energy") + F.col("change")) / 2})


FACTORS_SQL = f"""{NORM}, {CHANGE}, {SILENCE}, {CONTRAST},
dn AS (SELECT media_id, t, CASE WHEN max(s) OVER m - min(s) OVER m < 1e-8 THEN 0 ELSE (s - min(s) OVER m) / (max(s) OVER m - min(s) OVER m) END AS density FROM sm WINDOW m AS (PARTITION BY media_id)),
fac AS (SELECT n.media_id, n.t, n.v AS energy, density, change, contrast, 1 - density AS pace, n.v * density AS spectral, change * n.v AS beat, contrast * 0.5 AS hook, (n.v + change) / 2 AS emotion
  FROM norm n JOIN chg USING (media_id, t) JOIN con USING (media_id, t) JOIN dn USING (media_id, t))"""


def hop_sql(names, weights, length, step, extra=""):
    means = ", ".join(f"avg({f}) OVER f AS {f}_mean" for f in names)
    total = " + ".join(f"{w} * {f}_mean" for f, w in zip(names, weights, strict=True))
    return f"""(SELECT media_id, t AS w_start, w_end, {', '.join(f'{f}_mean' for f in names)}{', ' + ', '.join(x.split(' AS ')[1] for x in extra.split('; ')) if extra else ''}, {total} AS total FROM
(SELECT *, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY media_id) AS n, coalesce(lead(t, {length}) OVER o, max(t) OVER (PARTITION BY media_id)) AS w_end, {means}{', ' + extra.replace('; ', ', ') if extra else ''} FROM fac
 WINDOW o AS (PARTITION BY media_id ORDER BY t), f AS (PARTITION BY media_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING))
WHERE idx % {step} = 0 AND (idx <= n - {length} OR idx = 0))"""


def five(spark, sf, length=30, step=10):
    return windows.hopping(factors(spark, sf), FIVE, dims.FIVE, length, step).withColumn("total", F.round("total", 4))


EXTRA = {"energy_max": lambda f: F.max("energy").over(f), "energy_std": lambda f: F.stddev_pop("energy").over(f), "spectral_max": lambda f: F.max("spectral").over(f)}
EXTRA_SQL = "max(energy) OVER f AS energy_max; stddev_pop(energy) OVER f AS energy_std; max(spectral) OVER f AS spectral_max"


def nine_features():
    c = lambda n: F.col(f"{n}_mean")
    return {
        "energy_mean": c("energy"), "energy_max": F.col("energy_max"), "change": c("change"), "silence": c("contrast"), "spectral_mean": c("spectral"), "spectral_max": F.col("spectral_max"), "beat": c("beat"),
        "density": c("density"), "pace": c("pace"), "hook_count": c("hook") * 10, "hook_density": c("hook"), "emotion": c("emotion"),
    }


def nine(spark, sf, category="default"):
    rows = windows.hopping(factors(spark, sf), NINE, _nine_weights(category), 30, 10, EXTRA)
    return rows.withColumn("virality", story.virality(nine_features()))


def _nine_weights(category):
    by = dict(zip(dims.FACTORS, dims.PROFILES.get(category, dims.PROFILES["default"]), strict=True))
    return tuple(by[n] for n in ("audio_energy", "speech_density", "energy_change", "silence_contrast", "speech_pace", "spectral_excitement", "beat_strength", "hook_keywords", "emotion_markers"))


def virality_sql(f: dict[str, str]) -> str:
    x = {n: f"least(1.0, greatest(0.0, {f[n]}))" for n in f}
    raw = " + ".join(f"{w}::DOUBLE * {x[n]}" for n, w in story.LINEAR.items() if n in x) + " + " + " + ".join(f"{w}::DOUBLE * {x[a]} * {x[b]}" for (a, b), w in story.CROSSED.items())
    return f"(({raw}) / {sum(story.LINEAR.values()) + sum(story.CROSSED.values())}::DOUBLE)"


NINE_F = {
    "energy_mean": "energy_mean", "energy_max": "energy_max", "change": "change_mean", "silence": "contrast_mean", "spectral_mean": "spectral_mean", "spectral_max": "spectral_max", "beat": "beat_mean",
    "density": "density_mean", "pace": "pace_mean", "hook_count": "hook_mean * 10", "hook_density": "hook_mean", "emotion": "emotion_mean",
}
NINE_SQL = f"WITH {FACTORS_SQL}, w9 AS {hop_sql(NINE, _nine_weights('default'), 30, 10, EXTRA_SQL)}"


def union(spark, sf):
    """The five-factor windows of all sizes from 24 to 60 hours."""
    grid = factors(spark, sf)
    parts = [windows.hopping(grid, FIVE, dims.FIVE, n, 10).select("media_id", F.lit(n).alias("size"), "w_start", "w_end", F.round("total", 4).alias("score")) for n in windows.sizes(24, 60)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


UNION_SQL = f"""{FACTORS_SQL}, un AS ({' UNION ALL '.join(f"SELECT media_id, {n} AS size, w_start, w_end, round(total, 4) AS score FROM {hop_sql(FIVE, dims.FIVE, n, 10)}" for n in windows.sizes(24, 60))})"""


def stories(spark, sf):
    segs = model.segments(spark, sf)
    values = windows.segment_values(segs, lexicon.group_scores(hits(spark, sf)))
    return windows.story_windows(values)


def _document_stories(spark, sf):
    """The same over the documents' sentences, of which there are many more."""
    sents = model.sentences(spark, sf)
    found = lexicon.exact_hits(lexicon.folded_tokens(sents), lexicon.compiled(dims.lexicon(spark)))
    return windows.story_windows(windows.segment_values(sents, lexicon.group_scores(found)))


def chosen(spark, sf, k=5):
    return select.with_overlap(stories(spark, sf), k)


K = windows.Story()
_SUMS = [f"g_{g}" for g in windows.GROUPS] + ["numbers", "asks"]
_S = ", ".join(f"round(z.c_{n} - a.c_{n} + a.{n}, 9) AS s_{n.removeprefix('g_')}" for n in _SUMS)
sat = lambda e, c: f"least(1.0, greatest(0.0, ({e}) / {c}::DOUBLE))"
_PIVOT = ", ".join(f"coalesce(sum(CASE WHEN grp = '{g}' THEN score END), 0.0) AS g_{g}" for g in windows.GROUPS)
_CUM = ", ".join(f"sum({n}) OVER (PARTITION BY media_id ORDER BY seg_idx) AS c_{n}" for n in _SUMS)
_ARC = " + ".join(f"CASE WHEN s_{g} > 0 AND s_setup > 0 THEN least(s_{g}, s_setup * 0.8) ELSE 0.0 END" for g in ("payoff", "clutch", "error"))
_INFO = " + ".join(f"s_{g}" for g in K.info) + " + 0.35 * least(s_numbers, 4) + 0.20 * least(s_asks, 2)"
C = K.ceilings
STORY_SQL = f"""{SEG}, {LEX}, {TOKENS}, {HITS}, {GROUPS},
pv AS (SELECT media_id, seg_idx, {_PIVOT} FROM gs GROUP BY 1, 2),
val AS (SELECT seg.*, {', '.join(f'coalesce(g_{g}, 0.0) AS g_{g}' for g in windows.GROUPS)}, len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS numbers,
  CAST(contains(text, '?') OR list_has_any(list_transform(regexp_extract_all(text, '[A-Za-zऀ-ॿ0-9]+'), lambda w: lower(w)), [{', '.join(map(QUOTED, QUESTION_WORDS))}]) AS INT) AS asks,
  max(seg_end) OVER (PARTITION BY seg.media_id) AS media_end FROM seg LEFT JOIN pv USING (media_id, seg_idx)),
cum AS (SELECT *, {_CUM} FROM val),
run AS (SELECT a.media_id, a.seg_idx AS first_seg, z.seg_idx AS last_seg, a.seg_start AS a, z.seg_end AS z, a.text AS first_text, z.text AS last_text, {_S} FROM cum a JOIN cum z ON a.media_id = z.media_id AND z.seg_idx >= a.seg_idx
  WHERE a.seg_start < a.media_end AND z.seg_end - a.seg_start >= {K.least} AND z.seg_end - a.seg_start <= {K.most}),
r2 AS (SELECT *, round({' + '.join(f's_{g}' for g in K.strong)}, 9) AS content_raw, round({_ARC}, 9) AS arc_raw, z - a AS dur,
  1.0 - CASE WHEN regexp_matches(trim(first_text), '^\\p{{Ll}}') THEN 0.25 ELSE 0 END - CASE WHEN trim(last_text) <> '' AND NOT regexp_matches(trim(last_text), '[.!?।]$') THEN 0.25 ELSE 0 END AS boundary FROM run
  WHERE s_payoff >= 0.9 OR s_clutch >= 0.9 OR s_tactic >= 0.9 OR s_instruction >= 0.9 OR s_error >= 0.9),
r3 AS (SELECT *, {sat('content_raw', C['content'])} AS content, {sat('arc_raw', C['arc'])} AS arc, {sat('s_reaction + 0.5 * s_hype', C['reaction'])} AS reaction, {sat(_INFO, C['info'])} AS info, -{sat('-s_filler', C['filler'])} AS filler FROM r2 WHERE content_raw >= 1.0),
r4 AS (SELECT *, greatest(0.0, least(1.0, 0.42::DOUBLE * content + 0.18::DOUBLE * arc + 0.12::DOUBLE * reaction + 0.18::DOUBLE * info + 1.0::DOUBLE * filler)) AS base FROM r3),
st AS (SELECT media_id, first_seg, last_seg, round(a, 2) AS w_start, round(z, 2) AS w_end, round(dur, 2) AS duration, CAST(round(CAST(greatest(0.0, least(1.0, 0.9::DOUBLE * base + 0.05::DOUBLE)) * (0.9::DOUBLE + 0.1::DOUBLE * boundary) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS score,
  CAST(round(CAST(content AS DECIMAL(18, 9)), 4) AS DOUBLE) AS content, CAST(round(CAST(arc AS DECIMAL(18, 9)), 4) AS DOUBLE) AS arc, CAST(round(CAST(reaction AS DECIMAL(18, 9)), 4) AS DOUBLE) AS reaction, CAST(round(CAST(info AS DECIMAL(18, 9)), 4) AS DOUBLE) AS info, CAST(round(CAST(filler AS DECIMAL(18, 9)), 4) AS DOUBLE) AS filler, 0.5::DOUBLE AS audio, round(boundary, 4)::DOUBLE AS boundary, CAST(round(CAST(base / dur * 60 AS DECIMAL(18, 9)), 4) AS DOUBLE) AS density,
  s_payoff, s_clutch, s_tactic, s_instruction, s_error, s_stake, s_filler, s_numbers, arc_raw FROM r4),
sr AS (SELECT *, CAST(round(CAST(0.45::DOUBLE * {sat('density', C['density'])} + 0.55::DOUBLE * score AS DECIMAL(18, 9)), 4) AS DOUBLE) AS rank FROM st)"""

DOC_STORY_SQL = STORY_SQL.replace(SEG, SENT)
_OUT = ["media_id", "first_seg", "last_seg", "w_start", "w_end", "duration", "score", "content", "arc", "reaction", "info", "filler", "boundary", "density", "rank"]


def greedy_sql(source: str, keys: list[str], k: int, clash: str) -> str:
    row = ", ".join(f"'k{i}': -{c}" for i, c in enumerate(keys))
    return f"""ch AS (SELECT media_id, unnest(list_reduce(list(x ORDER BY x), lambda acc, x: CASE WHEN len(acc) < {k} AND len(list_filter(acc, lambda s: {clash})) = 0 THEN list_append(acc, x[1]) ELSE acc END, [])) AS x
FROM (SELECT media_id, [{{{row}, 'a': w_start::DOUBLE, 'b': w_end::DOUBLE}}] AS x FROM {source}) GROUP BY media_id)"""


GAP_CLASH = "x[1].a < s.b + 10 AND x[1].b > s.a - 10"
OVER_CLASH = "least(x[1].b - x[1].a, s.b - s.a) > 0 AND greatest(0.0, least(x[1].b, s.b) - greatest(x[1].a, s.a)) / least(x[1].b - x[1].a, s.b - s.a) > 0.25"
CHOSEN_SQL = f"{STORY_SQL}, {greedy_sql('sr', ['rank', 'score'], 5, OVER_CLASH)}, sel AS (SELECT media_id, x.a AS w_start, x.b AS w_end, -x.k0 AS rank, -x.k1 AS score FROM ch)"


def refined(spark, sf):
    return story.refine(chosen(spark, sf), model.segments(spark, sf), dims.OPENERS, dims.TRAILERS, dims.RESOLUTIONS)


IN = lambda words: "[" + ", ".join(map(QUOTED, words)) + "]"
REFINE_SQL = f"""bw AS (SELECT *, regexp_extract_all(lower(text), '[A-Za-zऀ-ॿ]+') AS words, max(seg_end) OVER (PARTITION BY media_id) AS total FROM seg),
bx AS (SELECT *, lead(seg_end) OVER o AS next_end, lead(words) OVER o AS next_words FROM bw WINDOW o AS (PARTITION BY media_id ORDER BY seg_idx)),
bm AS (SELECT s.*, x.seg_idx, seg_start, seg_end, words, total, next_end, next_words FROM sel s JOIN bx x ON x.media_id = s.media_id AND seg_end > w_start AND seg_start < w_end),
be AS (SELECT media_id, w_start, w_end, rank, score, min(seg_start) AS s0, min_by(words, seg_idx) AS fw, max_by(seg_end, seg_idx) AS le, max_by(words, seg_idx) AS lw, any_value(total) AS total, max_by(struct_pack(e := next_end, w := next_words), seg_idx) AS nx FROM bm GROUP BY ALL),
bf AS (SELECT *, greatest(0.0, s0 - 0.15::DOUBLE) AS s, coalesce(list_contains({IN(dims.TRAILERS)}, lw[-1]), false) AND nx.e IS NOT NULL AND nx.e + 0.2::DOUBLE - greatest(0.0, s0 - 0.15::DOUBLE) <= 60 AS goes FROM be),
bg AS (SELECT *, CASE WHEN goes THEN nx.e + 0.2::DOUBLE ELSE least(total, le + 0.2::DOUBLE) END AS e, CASE WHEN goes THEN nx.w ELSE lw END AS w FROM bf),
bh AS (SELECT *, CASE WHEN list_has_any(fw[1:3], {IN(dims.OPENERS)}) THEN 0.95 WHEN len(fw) >= 2 THEN 0.75 ELSE 0.5 END::DOUBLE AS hook,
  CASE WHEN list_has_any(w[-3:], {IN(dims.RESOLUTIONS)}) THEN 0.95 WHEN len(w) > 0 AND NOT coalesce(list_contains({IN(dims.TRAILERS)}, w[-1]), false) THEN 0.80 ELSE 0.35 END::DOUBLE AS resolution FROM bg),
ref AS (SELECT media_id, w_start, w_end, rank, score, round(s, 2) AS adj_start, round(CASE WHEN e - s < 15 THEN least(total, s + 15) WHEN e - s > 60 THEN s + 60 ELSE e END, 2) AS adj_end, hook, resolution, round(0.5::DOUBLE * hook + 0.5::DOUBLE * resolution, 3) AS boundary_score, resolution >= 0.7 AND hook >= 0.6 AS complete FROM bh)"""

STORY_F = {
    "energy_mean": "audio", "energy_max": "audio", "change": "reaction * 0.5", "silence": "0.3", "spectral_mean": "reaction * 0.6", "spectral_max": "0.8", "beat": "0.5", "density": "density / 30", "pace": "0.7",
    "hook_count": "content * 2", "hook_density": "content / 2", "emotion": "reaction", "exclaims": "0.1", "asks": "0.1",
}


def fused(spark, sf):
    rows = chosen(spark, sf).join(stories(spark, sf), ["media_id", "w_start", "w_end", "rank", "score"])
    segs = model.segments(spark, sf)
    lines = segs.select("media_id", "seg_idx", "text")
    ends = rows.join(lines, "media_id").filter((F.col("seg_idx") >= F.col("first_seg")) & (F.col("seg_idx") <= F.col("last_seg")))
    text = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), " "), 1, 300)
    quoted = ends.groupBy("media_id", "first_seg", "last_seg").agg(F.trim(text).alias("text"))
    rows = rows.join(quoted, ["media_id", "first_seg", "last_seg"])
    rows = lexicon.genre_intent(rows, dims.GENRES, F.lit("guide"))
    rows = story.refine(rows, segs, dims.OPENERS, dims.TRAILERS, dims.RESOLUTIONS).withColumn("virality", story.virality(story.story_features()))
    total = story.fuse(F.col("score"), F.col("virality"), F.col("boundary_score"), F.col("genre_score"), F.col("fit"))
    return rows.select("media_id", "first_seg", "last_seg", "adj_start", "adj_end", F.round("virality", 4).alias("virality"), "primary_genre", "genre_score", F.round(total, 4).alias("fused"))


FUSED_SQL = f"""WITH {CHOSEN_SQL}, {REFINE_SQL}, fw0 AS (SELECT sr.*, adj_start, adj_end, boundary_score FROM sr JOIN ref USING (media_id, w_start, w_end, rank, score)),
fq AS (SELECT w.media_id, first_seg, last_seg, trim(substring(string_agg(seg.text, ' ' ORDER BY seg.seg_idx), 1, 300)) AS text FROM fw0 w JOIN seg ON seg.media_id = w.media_id AND seg.seg_idx BETWEEN first_seg AND last_seg GROUP BY 1, 2, 3),
{GENRE_SQL.replace('FROM seg)', 'FROM (SELECT media_id, first_seg * 100000 + last_seg AS seg_idx, text FROM fq))')}
SELECT w.media_id, first_seg, last_seg, adj_start, adj_end, round({virality_sql(STORY_F)}, 4) AS virality, CASE WHEN gb.score > 0 THEN genre ELSE 'general' END AS primary_genre, round(least(1.0, gb.score / 3.5), 3) AS genre_score,
round(0.40::DOUBLE * w.score + 0.30::DOUBLE * {virality_sql(STORY_F)} + 0.15::DOUBLE * boundary_score + 0.15::DOUBLE * round(least(1.0, gb.score / 3.5), 3) * CASE WHEN contains('guide', genre) OR contains(genre, 'guide') THEN 1.25 ELSE 1.0 END::DOUBLE, 4) AS fused
FROM fw0 w JOIN gb ON gb.media_id = w.media_id AND gb.seg_idx = first_seg * 100000 + last_seg"""


def clips(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("media_id").orderBy("w_start", "w_end")
    return chosen(spark, sf).select("media_id", F.row_number().over(order).cast("long").alias("clip"), "w_start", "w_end", "score")


CLIPS_SQL = f"{CHOSEN_SQL}, clips AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY w_start, w_end) AS clip, w_start, w_end, score FROM sel)"
EDIT_SQL = f"""{CLIPS_SQL}, pf(platform, width, height, least, most) AS (VALUES {dims.sql_values(dims.PLATFORMS)}),
ed AS (SELECT media_id, clip, platform, width, height, w_start, CASE WHEN w_end - w_start > most THEN w_start + most ELSE w_end END AS cut_end, round(least(w_end - w_start, most), 2) AS seconds, score FROM clips CROSS JOIN pf WHERE w_end - w_start >= pf.least)"""
# The multi-source order sums over sources before chapters, as the query does.
CHAPTER = "round(w_end - w_start, 2) AS duration"


def rounded_five(spark, sf):
    return five(spark, sf).withColumns({f"{f}_mean": F.round(f"{f}_mean", 6) for f in FIVE})


QUERIES = {
    "window_score_5f": (rounded_five, f"WITH {FACTORS_SQL} SELECT media_id, w_start, w_end, {', '.join(f'round({f}_mean, 6) AS {f}_mean' for f in FIVE)}, round(total, 4) AS total FROM {hop_sql(FIVE, dims.FIVE, 30, 10)}"),
    "window_score_9f": (
        lambda s, sf: nine(s, sf).select("media_id", "w_start", "w_end", F.round("energy_std", 6).alias("energy_std"), F.round("virality", 6).alias("virality"), F.round(0.5 * F.col("total") + 0.5 * F.col("virality"), 4).alias("total")),
        f"{NINE_SQL} SELECT media_id, w_start, w_end, round(energy_std, 6) AS energy_std, round({virality_sql(NINE_F)}, 6) AS virality, round(0.5 * total + 0.5 * {virality_sql(NINE_F)}, 4) AS total FROM w9",
    ),
    "window_union": (union, f"WITH {UNION_SQL} SELECT media_id, size, w_start, w_end, score FROM un"),
    "select_gap": (lambda s, sf: select.with_gap(union(s, sf)), f"WITH {UNION_SQL}, {greedy_sql('un', ['score'], 5, GAP_CLASH)} SELECT media_id, x.a AS w_start, x.b AS w_end, -x.k0 AS score FROM ch"),
    "semantic_windows": (lambda s, sf: stories(s, sf).select(*_OUT), f"WITH {STORY_SQL} SELECT {', '.join(_OUT)} FROM sr"),
    "reason_text": (
        lambda s, sf: windows.reason(stories(s, sf)).select("media_id", "first_seg", "last_seg", "reason"),
        f"""WITH {STORY_SQL} SELECT media_id, first_seg, last_seg, CASE WHEN r = '' THEN 'generic moment' ELSE r END AS reason FROM (SELECT *, concat_ws(' + ', {', '.join(f"CASE WHEN s_{g} >= 0.8 THEN '{n}' END" for g, n in (("payoff", "result"), ("clutch", "turning point"), ("tactic", "method"), ("instruction", "advice"), ("error", "mistake"), ("stake", "stakes")))},
CASE WHEN arc_raw > 0.5 THEN 'whole story' END, CASE WHEN s_numbers > 0 THEN CAST(CAST(s_numbers AS INT) AS VARCHAR) || ' numbers' END, CASE WHEN s_filler < -0.5 THEN 'some filler' END) AS r FROM sr)""",
    ),
    "select_overlap_ratio": (
        lambda s, sf: select.with_overlap(union(s, sf), score=("score",)),
        f"WITH {UNION_SQL}, {greedy_sql('un', ['score'], 5, OVER_CLASH)} SELECT media_id, x.a AS w_start, x.b AS w_end, -x.k0 AS score FROM ch",
    ),
    "story_documents": (
        lambda s, sf: _document_stories(s, sf).groupBy("media_id").agg(F.count("*").alias("windows"), F.max("rank").alias("best"), F.round(F.round(F.avg("score"), 9), 4).alias("mean_score")),
        f"WITH {DOC_STORY_SQL} SELECT media_id, count(*) AS windows, max(rank) AS best, CAST(round(CAST(avg(score) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS mean_score FROM sr GROUP BY 1",
    ),
    "semantic_select": (chosen, f"WITH {CHOSEN_SQL} SELECT media_id, w_start, w_end, rank, score FROM sel"),
    "boundary_refine": (refined, f"WITH {CHOSEN_SQL}, {REFINE_SQL} SELECT * FROM ref"),
    "feature_vector": (
        lambda s, sf: story.feature_vector(nine(s, sf), nine_features()).select("media_id", "w_start", *[F.round(f"f_{n}", 6).alias(f"f_{n}") for n in [*story.LINEAR, "synergy"]]),
        f"{NINE_SQL} SELECT media_id, w_start, {', '.join(f'round({NINE_F.get(n, 0.0)}, 6)::DOUBLE AS f_{n}' for n in story.LINEAR)}, round(greatest(0.0, least(1.0, energy_mean * density_mean * 2)), 6) AS f_synergy FROM w9",
    ),
    "virality_formula": (
        lambda s, sf: stories(s, sf).select("media_id", "first_seg", "last_seg", F.round(story.virality(story.story_features()), 6).alias("virality")),
        f"WITH {STORY_SQL} SELECT media_id, first_seg, last_seg, round({virality_sql(STORY_F)}, 6) AS virality FROM sr",
    ),
    "fused_candidates": (fused, FUSED_SQL),
    "edit_decisions": (lambda s, sf: render.edit_decisions(clips(s, sf), dims.PLATFORMS), f"WITH {EDIT_SQL} SELECT * FROM ed"),
    "generation_report": (
        lambda s, sf: render.generation_report(render.edit_decisions(clips(s, sf), dims.PLATFORMS)),
        f"WITH {EDIT_SQL} SELECT platform, count(*) AS clips, count(DISTINCT media_id) AS media, round(sum(seconds), 2) AS seconds FROM ed GROUP BY 1",
    ),
    "chapters_single": (
        lambda s, sf: render.chapters(clips(s, sf), by_time=False).select("media_id", "chapter", "w_start", "duration", "offset"),
        f"WITH {CLIPS_SQL}, d AS (SELECT *, {CHAPTER} FROM clips) SELECT media_id, row_number() OVER o AS chapter, w_start, duration, round(coalesce(sum(duration) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS \"offset\" FROM d WINDOW o AS (PARTITION BY media_id ORDER BY score DESC, w_start, w_end)",
    ),
    "chapters_multi": (
        lambda s, sf: render.chapters(clips(s, sf), whole=True).select("media_id", "chapter", "w_start", "duration", "offset"),
        f"WITH {CLIPS_SQL}, d AS (SELECT *, {CHAPTER} FROM clips) SELECT media_id, row_number() OVER o AS chapter, w_start, duration, round(coalesce(sum(duration) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS \"offset\" FROM d WINDOW o AS (ORDER BY media_id, w_start, w_end)",
    ),
    "weight_profiles": (
        lambda s, sf: dims.checked(dims.profiles(s)),
        f"SELECT category, count(*) AS factors, round(sum(weight), 6) AS total FROM (VALUES {dims.sql_values([(c, w) for c, ws in dims.PROFILES.items() for w in ws])}) t(category, weight) GROUP BY 1",
    ),
    "filtergraphs": (
        lambda s, sf: dims.rows(s, [(c, w, h, *next(x[1:] for x in dims.PRESETS if x[0] == p)) for c, p in dims.CATEGORY_PRESET for _, w, h, _, _ in dims.PLATFORMS[:1]], "category string, width int, height int, eq string, balance string, sharp string").select(
            "category", render.filtergraph(F.col("width"), F.col("height"), [F.col("eq"), F.col("balance"), F.col("sharp")]).alias("graph")
        ),
        f"""SELECT category, '[0:v]scale=1080:1920:force_original_aspect_ratio=increase,crop=1080:1920,boxblur=25:5,eq=brightness=-0.12:contrast=0.90[bg];' || concat_ws(',', '[0:v]scale=1080:-2', nullif(eq, 'null'), nullif(balance, 'null'), nullif(sharp, 'null')) || '[fg];[bg][fg]overlay=(W-w)/2:(H-h)/2[outv]' AS graph
FROM (VALUES {dims.sql_values([(c, *next(x[1:] for x in dims.PRESETS if x[0] == p)) for c, p in dims.CATEGORY_PRESET])}) t(category, eq, balance, sharp)""",
    ),
}
