"""Small fixtures with answers worked out by hand, and properties of the selections."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as fn
from tideline.operators import lexicon, render, select, signals, speech, story, windows
from tideline.plans import dims
from tideline.runtime import ship


def series(spark, values, media="m"):
    return spark.createDataFrame([(media, i, float(v)) for i, v in enumerate(values)], "media_id string, t long, v double")


def column(df, name="x", order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_moving_average_pads_with_zeros(spark):
    df = series(spark, [3, 3, 3, 3]).withColumn("x", signals.moving_average(F.col("v"), 3))
    assert column(df) == [2.0, 3.0, 3.0, 2.0]
    even = series(spark, [4, 4, 4, 4]).withColumn("x", signals.moving_average(F.col("v"), 4))
    assert column(even) == [2.0 + 0.0, 3.0, 4.0, 3.0]


@pytest.mark.parametrize(("values", "zero", "one", "top"), [([0, 5, 10], [0, 0.5, 1], [0, 0.5, 1], [0, 0.5, 1]), ([2, 2], [0, 0], [1, 1], [1, 1]), ([0, 0], [0, 0], [0, 0], [0, 0]), ([7], [0], [1], [1])])
def test_scalings_of_flat_series(spark, values, zero, one, top):
    df = series(spark, values)
    assert column(df.withColumn("x", signals.scaled(F.col("v")))) == zero
    assert column(df.withColumn("x", signals.scaled_flat_one(F.col("v")))) == one
    assert column(df.withColumn("x", signals.share_of_max(F.col("v")))) == top


def test_gradient_and_change(spark):
    df = series(spark, [1, 2, 4, 4]).withColumn("x", signals.gradient(F.col("v")))
    assert column(df) == [1.0, 1.5, 1.0, 0.0]
    assert column(series(spark, [5]).withColumn("x", signals.gradient(F.col("v")))) == [0.0]
    assert column(signals.energy_change(series(spark, [1, 2, 4, 4])), "change") == [pytest.approx(2 / 3), 1.0, pytest.approx(2 / 3), 0.0]


def test_silences_at_the_edges_and_exact_limits(spark):
    quiet = series(spark, [0, 0, 1, 0.05, 0, 0, 1, 0])
    assert [(r.s_start, r.s_end) for r in signals.silences(quiet).orderBy("s_start").collect()] == [(0.0, 1.0), (4.0, 5.0)]
    assert signals.silences(quiet, least=1.5).count() == 0


def test_contrast_takes_the_strongest_silence(spark):
    df = series(spark, [1, 1, 1, 1, 1])
    gaps = spark.createDataFrame([("m", 0.0, 0.0), ("m", 0.0, 1.0)], "media_id string, s_start double, s_end double")
    assert column(signals.silence_contrast(df, gaps), "contrast") == [1.0, 1.0, 0.5, 0.0, 0.0]


def test_resample_clamps_and_interpolates(spark):
    df = spark.createDataFrame([("m", 1, 10.0), ("m", 3, 30.0)], "media_id string, t long, v double")
    assert column(signals.resample(df, 0.5), "v") == [10, 10, 10, 15, 20, 25]


def test_mean_in_windows_includes_both_ends(spark):
    df = series(spark, [0.0, 0.5, 1.0, 1.0])
    w = spark.createDataFrame([("m", 0.0, 1.0), ("m", 1.0, 2.0), ("m", 8.0, 9.0), ("n", 0.0, 1.0)], "media_id string, w_start double, w_end double")
    got = {(r.media_id, r.w_start): r.energy for r in signals.mean_in_windows(w, df).collect()}
    assert got == {("m", 0.0): 0.25, ("m", 1.0): 0.75, ("m", 8.0): 0.5, ("n", 0.0): 0.5}


def test_framed_rms(spark):
    got = signals.framed_rms(series(spark, [3, 4, 0, 0]), 2).orderBy("frame").collect()
    assert [r.rms for r in got] == [pytest.approx(math.sqrt(12.5)), 0.0]
    assert [r.rms for r in signals.framed_rms(series(spark, [0, 0]), 2).collect()] == [0.0]


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "key"), [("bhaai", "bai"), ("chhota", "kota"), ("phone", "pone"), ("zindagi", "jindagi"), ("Paysa!", "paisa"), ("", ""), ("a  b1c", "a b k")])
def test_fold_is_one_pass(spark, word, key):
    got = one(spark, fn.fold(F.col("t")), word)
    assert got == {"chhota": "cota", "a  b1c": "a b k"}.get(word, key)


@pytest.mark.parametrize(("word", "roman"), [("भाई", "bhai"), ("मारा", "mara"), ("बवाल", "bavaal".replace("aa", "a")), ("कम", "kam"), ("क्या", "kya"), ("हूँ", "hun"), ("\u091c\u093c\u092e\u0940\u0928", "jamin"), ("\u095b\u092e\u0940\u0928", "zamin"), ("plain", "plain"), ("कल clutch", "kal clutch")])
def test_romanize(spark, word, roman):
    assert one(spark, fn.romanize(F.col("t")), word) == roman


def test_text_functions(spark):
    assert one(spark, fn.skeleton(F.col("t")), "bai ja") == "bj"
    assert one(spark, fn.is_subsequence(F.lit("ace"), F.col("t")), "abcde") is True
    assert one(spark, fn.is_subsequence(F.lit("aec"), F.col("t")), "abcde") is False
    assert one(spark, fn.numbers(F.col("t")), "1.5 and 20, v3") == ["1.5", "20", "3"]
    assert [one(spark, fn.is_question(F.col("t")), t) for t in ("really?", "Kab aaye", "kabhi", "")] == [True, True, False, False]
    assert one(spark, fn.snippet(F.col("t")), "x" * 151) == "x" * 147 + "..."
    assert one(spark, fn.safe_name(F.col("t")), ' a:b/c?. ') == "a_b_c_" and one(spark, fn.safe_name(F.col("t")), "...") == "untitled"
    assert one(spark, fn.first_url(F.col("t"), r"ex\.org"), "go to www.ex.org/a b") == "https://www.ex.org/a"
    assert one(spark, fn.clock(F.lit(125.9)), "") == "02:05"


def test_similarity_rules():
    assert lexicon.similarity("bai", "bai") == 1.0
    assert lexicon.similarity("bai", "baiia") == 0.85
    assert lexicon.similarity("", "x") == 0.0
    assert lexicon.similarity("kat", "dog") == 0.0
    assert lexicon.similarity("jindagi", "jindegi") >= 0.82


def segments(spark, lines, media=1):
    from tideline.sources.model import timed

    return timed(spark.createDataFrame([(media, i, t) for i, t in enumerate(lines)], "media_id long, seg_idx long, text string"))


def test_phrase_hits_need_all_words_in_order(spark):
    lex = spark.createDataFrame([("g", "of the", 1.0), ("g", "the", 0.5), ("h", "the", 2.0), ("z", "360", 1.0)], "grp string, phrase string, weight double")
    segs = segments(spark, ["one of the best of a the", "the of"])
    got = {(r.seg_idx, r.grp, r.phrase): r.n for r in lexicon.exact_hits(lexicon.folded_tokens(segs), lexicon.compiled(lex)).collect()}
    assert got == {(0, "g", "of the"): 1, (0, "g", "the"): 2, (0, "h", "the"): 2, (1, "g", "the"): 1, (1, "h", "the"): 1}


def test_tokens_that_fold_to_nothing_keep_their_places(spark):
    lex = spark.createDataFrame([("g", "of the", 1.0), ("g", "def", 0.5)], "grp string, phrase string, weight double")
    segs = segments(spark, ["top of 5 the hill", "abc1def", "of the, def", ""])
    got = {(r.seg_idx, r.phrase): r.n for r in lexicon.exact_hits(lexicon.folded_tokens(segs), lexicon.compiled(lex)).collect()}
    assert got == {(2, "of the"): 1, (2, "def"): 1}


def fuzzy_by_hand(folded, phrases):
    """Hits of one text: exact entries first, then entries like the token; all words of longer phrases alike."""
    out = {}
    single = [(g, p, w[0]) for g, p, w in phrases if len(w) == 1]
    for key in filter(None, folded):
        found = [(g, p) for g, p, w in single if w == key] or [(g, p) for g, p, w in single if w[0] == key[0] and abs(len(w) - len(key)) <= 3 and lexicon.similarity(key, w) >= 0.8]
        for hit in found:
            out[hit] = out.get(hit, 0) + 1
    for g, p, w in phrases:
        if len(w) > 1:
            n = sum(all(lexicon.similarity(a, b) >= 0.8 for a, b in zip(folded[i : i + len(w)], w, strict=True)) for i in range(len(folded) - len(w) + 1))
            if n:
                out[g, p] = out.get((g, p), 0) + n
    return out


def test_fuzzy_hits_against_brute_force(spark):
    import random

    ship(spark)
    rng = random.Random(3)
    lex = [("g", "zindagi", 1.0), ("h", "jindagee", 2.0), ("g", "of the", 1.0), ("k", "clutch moment", 1.5), ("k", "fantastic finish today", 0.5), ("z", "360", 1.0), ("y", "360 noscope", 1.0)]
    words = "zindagi jindegi of the clutch klutch moment momment fantastic fantastik finish fnish today 5 abc1def noscope no hill x".split()
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(80)] + ["top of 5 the hill", "clutch 5 moment", "", None, "भाई zindagi"]
    segs = segments(spark, lines)
    df = spark.createDataFrame(lex, "grp string, phrase string, weight double")
    got = {}
    for r in lexicon.fuzzy_hits(lexicon.folded_tokens(segs), lexicon.compiled(df)).collect():
        got.setdefault(r.seg_idx, {})[r.grp, r.phrase] = r.n
    folded = {r.seg_idx: r.w for r in segs.select("seg_idx", F.transform(fn.tokens(fn.romanize(F.col("text"))), fn.fold).alias("w")).collect()}
    phrases = [(r.grp, r.phrase, r.words) for r in lexicon.compiled(df).collect()]
    want = {i: h for i, w in folded.items() if (h := fuzzy_by_hand(w or [], phrases))}
    assert got == want and any(("k", "fantastic finish today") in h for h in want.values())


def test_fuzzy_pairs_leave_exact_tokens_out(spark):
    ship(spark)
    lex = spark.createDataFrame([("g", "zindagi", 1.0)], "grp string, phrase string, weight double")
    segs = segments(spark, ["jindagi jindegi jump"])
    got = lexicon.fuzzy_pairs(lexicon.folded_tokens(segs), lexicon.compiled(lex)).collect()
    assert [(r.token, r.entry) for r in got] == [("jindegi", "jindagi")]


def test_genre_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("b a",), ("",), ("zzz",)], "text string")
    got = {r.text: r for r in lexicon.genre_intent(df, (("x", "a", 1.0), ("y", "b", 1.0)), F.lit("x-ray")).collect()}
    assert (got["b a"].primary_genre, got["b a"].fit, got["b a"].confidence) == ("x", 1.25, 0.25)
    assert got[""].primary_genre == "default" and got["zzz"].primary_genre == "general"


def test_speech_windows(spark):
    segs = segments(spark, ["a b c d e", "f g"])  # 2 s and 0.8 s
    dens = speech.speech_density(segs).orderBy("t").collect()
    assert [r.words for r in dens] == [7, 5, 2] and [r.density for r in dens] == [1.0, pytest.approx(0.6), 0.0]
    assert [r.raw for r in speech.speech_pace(segs).orderBy("t").collect()] == [150.0] * 3
    assert segments(spark, [""]).first().wpm == 0.0


def test_emotion_marks(spark):
    segs = segments(spark, ["GO now!! why?? OK this", "calm"])
    first = speech.emotion_scores(segs, ("this",)).orderBy("t").first()
    assert first.raw == 2 * 2 + 1.5 * 2 + 3 + 2 + 1.5


def no_joins(df):
    """Spark takes what is exploded for as small as its input, and a join might broadcast it."""
    df.collect()
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_density_without_joins(spark):
    segs = segments(spark, ["a b c", "", "d " * 20, None, "e"]).unionByName(segments(spark, ["x y"]).withColumn("media_id", F.lit(None).cast("string")))
    got = speech.speech_density(segs).filter("media_id is not null").orderBy("t")
    at = [r.t for r in speech.word_times(segs).filter("media_id is not null").collect()]
    assert column(got, "words") == [sum(t <= w < t + 5 for w in at) for t in range(10)] and len(at) == 24
    assert column(speech.speech_density(segs).filter("media_id is null"), "words") == [0]  # as in SQL, no key meets it
    no_joins(speech.speech_density(segs))


def test_pace_without_joins(spark):
    segs = segments(spark, ["a b c", "", "d " * 20, "e"]).withColumn("wpm", F.lit(100.0) + 20 * F.col("seg_idx"))
    segs = segs.unionByName(segments(spark, ["x y"]).withColumn("media_id", F.lit(None).cast("string")))
    over = lambda t, r: max(0, min(r.seg_end, t + 5) - max(r.seg_start, t))
    rows = segs.filter("media_id is not null").collect()
    want = [sum(over(t, r) * r.wpm for r in rows) / sum(over(t, r) for r in rows) for t in range(10)]
    got = speech.speech_pace(segs).orderBy("media_id", "t")
    assert column(got.filter("media_id is not null"), "raw") == [pytest.approx(x, abs=1e-6) for x in want] and len(set(want)) > 3
    assert column(got.filter("media_id is null"), "raw") == [0.0]  # as in SQL, no key meets it
    no_joins(got)


def window_texts(segs):
    """The text of each window, by brute force."""
    rows = sorted(segs.collect(), key=lambda r: r.seg_idx)
    return [" ".join(r.text for r in rows if r.seg_end > t and r.seg_start < t + 5 and r.text is not None) for t in range(math.ceil(max(r.seg_end for r in rows)))]


def test_hooks_across_segments(spark):
    segs, hooks = segments(spark, ["we saw the", "on", None, "que", "", "la " + "x " * 30 + "the", "on", "the on"]), ("the on", "que  la", "on que", "x x")
    got = speech.hook_scores(segs, hooks).orderBy("t")
    want = [sum(h in said.lower() for h in hooks) for said in window_texts(segs)]
    assert column(got, "hooks") == want and set(want) == {1, 2, 4}
    no_joins(got)


def test_emotions_across_segments(spark):
    segs = segments(spark, ["GO! HOW", "THE", None, "on? WHY??", "", "LA" + " x!" * 30 + " the", "on"])
    got = speech.emotion_scores(segs, ("the  on", "the on", "x")).orderBy("t")
    caps = lambda w: len(w) >= 3 and w.upper() == w and any(c.isupper() for c in w)
    marks = lambda s: 2 * s.count("!") + 1.5 * s.count("?") + 3 * ("!!" in s) + 2 * ("??" in s)
    want = [marks(s) + 1.5 * sum(w in s.lower() for w in ("the  on", "the on", "x")) + 2 * sum(map(caps, s.split())) for s in window_texts(segs)]
    assert column(got, "raw") == want and len(set(want)) > 3
    no_joins(got)


def candidates(spark, rows):
    return spark.createDataFrame([("m", float(a), float(b), float(s)) for a, b, s in rows], "media_id string, w_start double, w_end double, score double")


def test_greedy_gap_is_strict(spark):
    rows = [(0, 10, 0.9), (20, 30, 0.8), (19, 29, 0.85), (45, 50, 0.1)]
    got = sorted((r.w_start, r.w_end) for r in select.with_gap(candidates(spark, rows), 5, 10).collect())
    assert got == [(0, 10), (20, 30), (45, 50)]
    assert select.with_gap(candidates(spark, rows), 1).first().score == 0.9
    assert select.with_gap(candidates(spark, rows).limit(0)).count() == 0


def test_greedy_overlap_at_the_limit(spark):
    rows = [(0, 20, 0.9), (15, 35, 0.8), (14, 34, 0.85)]
    got = sorted((r.w_start, r.w_end) for r in select.with_overlap(candidates(spark, rows), score=("score",)).collect())
    assert got == [(0, 20), (15, 35)]  # exactly a quarter is allowed


def test_hopping_windows(spark):
    df = series(spark, range(10)).withColumnRenamed("v", "a")
    got = windows.hopping(df, ["a"], (1.0,), 4, 3).orderBy("w_start").collect()
    assert [(r.w_start, r.w_end, r.total) for r in got] == [(0, 4, 1.5), (3, 7, 4.5), (6, 9, 7.5)]
    short = windows.hopping(series(spark, [2, 4]).withColumnRenamed("v", "a"), ["a"], (1.0,), 4, 3).collect()
    assert [(r.w_start, r.w_end, r.total) for r in short] == [(0, 1, 3.0)]


def test_story_windows_gate_and_arc(spark):
    segs = segments(spark, ["word " * 40, "word " * 40]).withColumn("text", F.trim("text"))
    scores = spark.createDataFrame([(1, 0, "setup", 1.0), (1, 1, "payoff", 2.0)], "media_id long, seg_idx long, grp string, score double")
    got = {(r.first_seg, r.last_seg): r for r in windows.story_windows(windows.segment_values(segs, scores)).collect()}
    assert set(got) == {(1, 1), (0, 1)}
    assert got[0, 1].arc_raw == 0.8 and got[1, 1].arc_raw == 0.0
    assert got[0, 1].content == pytest.approx(2 / 6, abs=1e-4) and got[0, 1].boundary == 0.5


def test_refine_goes_on_after_a_trailer(spark):
    segs = segments(spark, ["first things " * 20 + "and", "then it ends here"])
    w = spark.createDataFrame([(1, 0.0, 16.0)], "media_id long, w_start double, w_end double")
    r = story.refine(w, segs, ("first",), ("and",), ("here",)).first()
    assert (r.hook, r.resolution, r.complete) == (0.95, 0.95, True) and r.adj_end == pytest.approx(41 / 2.5 + 4 / 2.5 + 0.2, abs=0.01)


def test_edit_decisions_and_chapters(spark):
    clips = spark.createDataFrame([("b", 1, 0.0, 100.0, 0.5), ("a", 1, 5.0, 9.0, 0.9), ("a", 2, 1.0, 11.0, 0.1)], "media_id string, clip long, w_start double, w_end double, score double")
    got = {(r.media_id, r.clip, r.platform): r.seconds for r in render.edit_decisions(clips, dims.PLATFORMS).collect()}
    assert got["b", 1, "reel"] == 90.0 and got["b", 1, "wide"] == 100.0 and ("a", 1, "reel") not in got and ("a", 2, "reel") in got
    both = [(r.media_id, r.chapter, r.offset) for r in render.chapters(clips, whole=True).orderBy("chapter").collect()]
    assert both == [("a", 1, 0.0), ("a", 2, 10.0), ("b", 3, 14.0)]
    ranked = [(r.chapter, r.w_start) for r in render.chapters(clips, by_time=False).filter("media_id = 'a'").orderBy("chapter").collect()]
    assert ranked == [(1, 5.0), (2, 1.0)]


def test_weights_are_checked(spark):
    bad = spark.createDataFrame([("x", "f", 0.5)], "category string, factor string, weight double")
    with pytest.raises(Exception, match="do not sum to 1"):
        dims.checked(bad).collect()
    with pytest.raises(ValueError, match="known: reel"):
        dims.platform("none")


def test_stream_equals_batch(spark, tmp_path):
    """A finished stream gives the batch windows, apart from those still open at its end."""
    from tideline.streaming import density

    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "view", 1.0) for h in range(6) for m in (0, 30)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = density.hopping(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "2 hours", "1 hour", "10 minutes")
    q = stream.writeStream.format("memory").queryName("hops").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.w_start, r.w_end): r.total for r in spark.table("hops").collect()}
    want = {(r.w_start, r.w_end): r.total for r in density.hopping(df, "2 hours", "1 hour").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 3


def test_refine_without_words(spark):
    segs = segments(spark, ["!!!", "a b"]).withColumns({"seg_start": F.col("seg_idx") * 10.0, "seg_end": F.col("seg_idx") * 10.0 + 9})
    w = spark.createDataFrame([(1, 0.0, 8.0)], "media_id long, w_start double, w_end double")
    r = story.refine(w, segs, ("a",), ("and",), ("b",), least=5).first()
    assert (r.hook, r.resolution, r.complete) == (0.5, 0.35, False)


def test_wav_files_and_spectra(spark, tmp_path):
    import math
    import wave

    from tideline.operators import audio
    from tideline.sources import wav

    ship(spark)
    with wave.open(str(tmp_path / "tone.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(b"".join(int(16000 * math.sin(2 * math.pi * 4 * i / 64)).to_bytes(2, "little", signed=True) * 2 for i in range(300)))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    rows = wav.read(spark, str(tmp_path))
    assert rows.groupBy("media_id").count().collect() == [("tone", 300)]
    assert abs(rows.filter("i = 4").first().v - 16000 / 32768) < 1e-4
    got = audio.features(audio.spectra(rows.withColumnRenamed("i", "t"), 64)).orderBy("t").collect()
    assert len(got) == 4 and all(abs(r.centroid - 4) < 0.05 and r.rolloff == 4 for r in got) and got[1].flux < 1
    flat = spark.createDataFrame([("m", i, 0.0) for i in range(8)], "media_id string, t long, v double")
    assert [(r.centroid, r.rolloff, r.flux) for r in audio.features(audio.spectra(flat, 4)).collect()] == [(0.0, 0.0, 0.0)] * 2


def test_safe_path_names_whole_texts(spark, tmp_path):
    from tideline.plans.text import QUERIES

    texts = [". " * 15 + "a" * 70, "." * 90 + "title", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["safe_path"][0](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.file for r in rows] == ["a" * 60, "title", "plain"]


def test_contrast_between_whole_seconds(spark):
    signal = spark.createDataFrame([("m", k / 4, 1.0) for k in range(40)], "media_id string, t double, v double")
    quiet = spark.createDataFrame([("m", 1.0, 2.3), ("m", 2.0, 3.1)], "media_id string, s_start double, s_end double")
    got = {r.t: r.contrast for r in signals.silence_contrast(signal, quiet).collect()}
    raw = {k / 4: max([1 - (k / 4 - e) / 2 for e in (2.3, 3.1) if e <= k / 4 <= e + 2], default=0.0) for k in range(40)}
    assert got == pytest.approx({t: v / max(raw.values()) for t, v in raw.items()})


def test_lexicons_fall_back(spark):
    lines = spark.createDataFrame([(" A b ",), ("a B",), ("",), (None,)], "phrase string")
    assert [r.phrase for r in lexicon.loaded(lines).collect()] == ["a b"]
    assert [r.phrase for r in lexicon.loaded(lines.limit(0), ("y", "x")).collect()] == ["x", "y"]


def test_samples_of_three_bytes():
    from tideline.sources.wav import _values

    want = [-1.0, 0.5, 0.0, -1 / (1 << 23)]
    raw = b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in want)
    assert _values(raw, 3).tolist() == want and _values(b"\x00\x80\xff", 1).tolist() == [-1.0, 0.0, 127 / 128]
