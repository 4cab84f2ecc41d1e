"""The text operators against brute force, on small tables with nulls, empty, long and repeated texts."""

import base64
import binascii
import collections
import hashlib
import itertools
import math
import os
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import decontaminate, jaccard_join, licenses, mpeg, pieces, quality, suffix_tree, token_shards, toxicity, url_rules, vectext
from tideline.llm.common import written
from tideline.runtime import ship

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " ", "\n\t", "Ünï—cödé ÀÉ 漢字 word", "a", "the cat", "the cat", "x" * 5000, "l" + "o" * 40 + " ng " * 3000, "\u2581 mark", "A-Z 0-9 ~!", "MIT License mit license", "tab\tnew\nline \x1f end "]


@pytest.fixture(scope="module")
def sp(spark):
    return ship(spark)


def table(sp, texts, ids=None, extra=True):
    """documents with a column more than asked for, of a name that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "xx", "src", len(t or ""), "clash") for i, t in zip(ids, texts, strict=True)]
    df = sp.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, point string")
    return df if extra else df.drop("point")


def nothing(sp):
    return table(sp, []).limit(0)


# ---------------------------------------------------------------- words


@pytest.mark.parametrize(("kind", "pattern"), [(vectext.ALNUM, ALNUM), (vectext.SPACED, SPACED)])
def test_words_are_those_of_the_pattern(kind, pattern):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB1 é漢\n\t.-\x0b\x85\u2003") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [t or "" for t in ODD]
    for most in (1, 50, 1 << 20):
        for lo, hi, buf, offsets in vectext.text_blocks(pa.array(texts), most):
            w = vectext.find_words(buf, offsets, kind)
            for d in range(hi - lo):
                got = [w.word(i).decode() for i in range(w.first[d], w.first[d + 1])]
                assert got == pattern.findall(texts[lo + d].translate(LOW))
                assert [int(h) for h in w.hash[w.first[d] : w.first[d + 1]]] == [vectext.word_hash(x) for x in got]


def test_index_finds_what_is_there():
    keys = np.unique(vectext.mix(np.arange(5000, dtype=np.uint64)))
    index = vectext.Index(keys)
    asked = np.concatenate([keys, vectext.mix(np.arange(5000, 9000, dtype=np.uint64)), np.array([0], np.uint64)])
    assert (index.find(asked) == vectext.lookup(keys, asked)).all()


# ---------------------------------------------------------------- 1 toxicity


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *(0 for _ in b)] if False else _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_equals_edit_distance():
    entries = [(b"moron", False), (b"stupid", False), (b"worthless", False), (b"disgusting", False), (b"trash", False), (b"lowei", True), (b"bomente", True)]
    a = toxicity.Automaton(entries)
    rng = random.Random(3)
    words = []
    for word, _ in entries:
        for _ in range(300):
            w = bytearray(word + bytes(rng.choice(b"abcio") for _ in range(rng.randint(0, 3))))
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(w) + 1)
                how = rng.randrange(3)
                if how == 0:
                    w.insert(p, rng.choice(b"abcdlmost"))
                elif how == 1 and len(w) > 1:
                    del w[min(p, len(w) - 1)]
                else:
                    w[min(p, len(w) - 1)] = rng.choice(b"abcdlmost")
            words.append(bytes(w))
    raw = b" ".join(words)
    found = vectext.find_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    places, _, errors = a.match(found)
    got = dict(zip(places.tolist(), errors.tolist(), strict=True))
    for i, w in enumerate(words):
        # The first byte has to be right, so the rest is what is compared.
        want = []
        for e, stem in entries:
            if w[:1] != e[:1]:
                continue
            forms = [w[1:k] for k in range(1, len(w))] if stem else [w[1:]]
            best = min((distance(f, e[1:]) for f in forms), default=99)
            if best <= toxicity.edits(e, stem):
                want.append(best)
        assert (i in got) == bool(want), w
        if want:
            assert got[i] == min(want), w


def toxic_texts(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["moron", "stupid", "worthless", "disgusting"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_learns_and_weighs_context(sp):
    texts, labels = toxic_texts(600, 1)
    docs = table(sp, texts + ODD)
    marks = sp.createDataFrame([(i, None, x) for i, x in enumerate(labels)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.classify(docs, marks).collect()}
    assert len(out) == len(texts) + len(ODD)
    for i, x in enumerate(labels):
        assert out[i].held_out == (crc32(str(i).encode()) % 4 == 2)
        assert out[i].predicted == x
    assert all(0 <= r.score <= 1 for r in out.values()) and all(out[len(texts) + k].predicted == 0 for k in range(len(ODD)))
    model = toxicity.fit(docs, marks)
    rows = ["a stupid moron spoke", "a stuupid morron spoke", 'he said "stupid" and "moron" of it', "nothing of it"]
    score = [r.score for r in toxicity.score(table(sp, rows), model).orderBy("doc_id").collect()]
    assert score[0] > score[1] > score[3] and score[0] > score[2] >= score[3]
    kept = {r.doc_id for r in toxicity.reject(docs, model).collect()}
    assert kept == {i for i, r in out.items() if r.predicted == 0}
    assert toxicity.reject(docs, model).columns == docs.columns


def test_classifiers_without_labels_or_documents(sp):
    none = sp.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        assert module.classify(nothing(sp), none).count() == 0
        scores = [r.score for r in module.classify(table(sp, ODD), none).collect()]
        assert len(scores) == len(ODD) and len(set(scores)) == 1


# ---------------------------------------------------------------- 2 quality


def test_quality_learns(sp):
    rng = random.Random(2)
    good = [" ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(50)) for _ in range(200)]
    bad = ["### " * 40 + "$$$ x" if i % 2 else (g.split()[0] + " ") * 50 for i, g in enumerate(good)]
    texts = [x for pair in zip(good, bad, strict=True) for x in pair]
    docs = table(sp, texts + ODD)
    marks = sp.createDataFrame([(i, 1 - i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, marks).collect()}
    held = [i for i in range(len(texts)) if out[i].held_out]
    assert held and sum(out[i].predicted == 1 - i % 2 for i in held) >= 0.8 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.doc_id for r in quality.reject(docs, quality.fit(docs, marks)).collect()} == {i for i, r in out.items() if r.predicted == 1}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_accuracy(sp):
    d, marks = (sp.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(d, marks).join(marks, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    rows = toxicity.classify(d, marks).join(marks, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.8 * len(rows)


# ---------------------------------------------------------------- 3 media


def test_media_round_trip_and_digests(sp):
    rows = {r.doc_id: r for r in mpeg.store(table(sp, ODD), "text", "doc_id", keep_media=True).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == binascii.crc32(payload[-16:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert mpeg.unwrap(bytes(r.media)) == (payload, len(raw))
    assert rows[6].feature == rows[7].feature and rows[0].media_sha256 == rows[1].media_sha256
    assert mpeg.store(nothing(sp), "text", "doc_id").count() == 0


def test_media_resync_checksums_and_tags(sp):
    media = mpeg.wrap(b"x" * 5000)
    x = mpeg.parse(media)
    assert x["vbr"]["frames"] == len(x["offsets"]) == 7 and x["samples"] == 7 * 1152 and x["junk"] == 0 and x["crc_bad"] == 0
    assert x["vbr"]["bytes"] == len(media) - x["offsets"][0] + 192
    cut = x["offsets"][3]
    broken = media[:cut] + b"\xff\xfb\x00junk\xff\xff" + media[cut:] + b"TAG" + b"Song".ljust(125, b"\0")
    y = mpeg.parse(broken)
    assert len(y["offsets"]) == 7 and y["junk"] == 9 and y["resyncs"] == 1 and y["tags"]["ID3v1"] == "Song"
    flipped = bytearray(media)
    flipped[x["offsets"][2] + 10] ^= 1
    assert mpeg.parse(bytes(flipped))["crc_bad"] == 1
    assert mpeg.parse(media[:-1])["junk"] == x["lengths"][-1] - 1
    assert mpeg.parse(b"")["offsets"] == [] and mpeg.parse(b"\xff" * 999)["junk"] == 999
    df = sp.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"zz"))], "id long, m binary")
    got = {r.id: r for r in mpeg.frame_index(df, "m", "id").collect()}
    assert got[1].duration == 7 * 1152 / 48000 and got[1].seek_offsets == x["offsets"] and got[2].frames is None and got[3].junk_bytes == 2
    # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz: 417 bytes, 418 padded
    assert mpeg.header(0xFFFB9000)[0] == 417 and mpeg.header(0xFFFB9200)[0] == 418 and mpeg.header(0xFFFBF000) is None


# ---------------------------------------------------------------- 4 url rules


def judged(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_rules_against_brute_force(sp, monkeypatch):
    rng = random.Random(4)
    hosts = [".".join(rng.choices(["a", "b", "www", "ex", "com", "net"], k=rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/en", "/en/", "/en/x", "/fr/1", "/e"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in zip(rng.choices(hosts, k=40), rng.choices(paths[1:], k=40), strict=True)}.values())
    urls = [rng.choice(["http://", "https://", "x://y://"]) + rng.choice(["", "q.", "w.z."]) + rng.choice(hosts).upper() + rng.choice(paths) + rng.choice(["", "?a=/en/", "#://z"]) for _ in range(500)]
    urls += [None, "", "no scheme", "http://", "http:///en/", "http://com./x", "://com/"] + ["http://hot.com/en/"] * 200
    pages = sp.createDataFrame([(i, u, "<html>", "k") for i, u in enumerate(urls)], "page_id long, url string, html string, key string")
    for block in (7, 1000):  # one sweep, or several
        monkeypatch.setattr(url_rules, "BLOCK_RULES", block)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
        assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, []).collect()} == {"allow"}


# ---------------------------------------------------------------- 5 pieces


def tiny():
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "c", "ab", "▁a", "bc", "▁ab", "abc", "▁▁", "aa"]
    return pieces.vocabulary(names, [0.0] * 257 + [-float(i) for i in range(len(names) - 257)], ["control"] + ["byte"] * 256 + ["piece"] * (len(names) - 257))


def segmentations(v, text):
    """Every segmentation of a text of letters a, b, c and spaces, with its log probability."""
    names = {"▁": 257, "a": 258, "b": 259, "c": 260, "ab": 261, "▁a": 262, "bc": 263, "▁ab": 264, "abc": 265, "▁▁": 266, "aa": 267}
    marked, out = ("▁" + text).replace(" ", "▁"), {}

    def walk(i, ids, w):
        if i == len(marked):
            out[tuple(ids)] = w
        for j in range(i + 1, len(marked) + 1):
            if k := names.get(marked[i:j]):
                walk(j, [*ids, k], w + v.log_w[k])

    walk(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: w - z for k, w in out.items()}


def test_pieces_are_distinct_exact_samples(sp):
    v = tiny()
    text = "abc aab"
    want = segmentations(v, text)
    docs = table(sp, [text] * 6000)
    rows = collections.defaultdict(dict)
    for r in pieces.encode(docs, v, k=3).collect():
        ids = tuple(np.frombuffer(r.ids, np.uint16).tolist())
        assert r.round_trip and math.isclose(r.log_prob, want[ids], rel_tol=1e-9) and len(ids) == r.n_pieces
        rows[r.doc_id][r.sample] = (ids, r.inclusion)
    assert all(len({x[0] for x in s.values()}) == 3 for s in rows.values())
    first = collections.Counter(s[0][0] for s in rows.values())
    for ids, w in want.items():
        p = math.exp(w)
        assert abs(first[ids] / 6000 - p) < 5 * math.sqrt(p * (1 - p) / 6000) + 1e-3
        # Weighing by the inclusion scores estimates sums over all segmentations without bias.
        total = sum(p / x[1] for s in rows.values() for x in s.values() if x[0] == ids) / 6000
        assert abs(total - p) < 0.25 * p + 0.02
    seconds = collections.Counter(s[1][0] for s in rows.values())
    for ids, w in want.items():
        p = sum(math.exp(o) * math.exp(w) / (1 - math.exp(o)) for other, o in want.items() if other != ids)
        assert abs(seconds[ids] / 6000 - p) < 5 * math.sqrt(p * (1 - p) / 6000) + 1e-3


def test_pieces_give_all_there_is_and_do_not_depend_on_partitions(sp):
    v = tiny()
    texts = ["ab", *ODD]
    rows = pieces.encode(table(sp, texts), v, k=50).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    all_ = segmentations(v, "ab")
    assert len(by[0]) == len(all_) and all(r.inclusion == 1 for r in by[0])
    assert sum(math.exp(r.log_prob) for r in by[0]) == pytest.approx(1)
    for i, t in enumerate(texts):
        assert all(r.round_trip for r in by[i]) and by[i]
        if not t:
            assert [(r.n_pieces, r.log_prob, r.inclusion) for r in by[i]] == [(0, 0.0, 1.0)]
    again = pieces.encode(table(sp, texts).repartition(5), v, k=50).collect()
    key = lambda rs: sorted((r.doc_id, r.sample, bytes(r.ids), round(r.log_inclusion, 9)) for r in rs)
    assert key(rows) == key(again)
    back = {(r.doc_id, r.text) for r in pieces.decode(pieces.encode(table(sp, texts), v), v).collect()}
    assert back == {(i, t or "") for i, t in enumerate(texts)}
    assert pieces.encode(nothing(sp), v).count() == 0


# ---------------------------------------------------------------- 6 decontamination


def contaminated(texts, items, window=10):
    found = {}
    its = {str(i): ALNUM.findall((t or "").translate(LOW)) for i, t in items}
    wins = collections.defaultdict(set)
    for i, w in its.items():
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[p : p + n])].add(i)
    for d, t in enumerate(texts):
        w = ALNUM.findall((t or "").translate(LOW))
        hit, who = set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                if own := wins.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    who |= own
        found[d] = (len(w), len(hit), sorted(who))
    return found


@pytest.mark.parametrize("shortest", [1, 3, 12])
def test_contamination_against_brute_force(sp, monkeypatch, shortest):
    rng = random.Random(shortest)
    words = list("abcdefgh") + ["é", "zz", "Q"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(shortest, 25)))) for i in range(12)] + [(90, None), (91, " ,"), (3, "same id a b c d e f g h i j k l")]
    texts = list(ODD)
    for _ in range(80):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 30)))]
        if rng.random() < 0.6:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(w))
            parts.append(", ".join(w[a : a + rng.randint(5, 20)]).upper())
        parts.append(" ".join(rng.choices(words, k=rng.randint(0, 30))))
        texts.append(" ".join(parts))
    bench = sp.createDataFrame(items, "item_id long, text string")
    merged = [(i, t) for i, t in items]
    want = contaminated(texts, [x for x in merged if x[0] != 3])
    dup = contaminated(texts, [("3", t) for i, t in items if i == 3][:1])
    dup2 = contaminated(texts, [("3", t) for i, t in items if i == 3][1:])
    for block in (30, 10_000):  # several automata, or one
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = {r.doc_id: r for r in decontaminate.contamination(table(sp, texts), bench).collect()}
        for d, (n, _, who) in want.items():
            all_ = sorted({*who, *dup[d][2], *dup2[d][2]})
            assert (got[d].n_words, got[d].items) == (n, all_)
            assert got[d].items_sha256 == hashlib.sha256(",".join(all_).encode()).hexdigest()
            assert (got[d].n_hit > 0) == bool(all_) and got[d].n_hit >= max(want[d][1], dup[d][1], dup2[d][1])
            raw = (texts[d] or "").encode()
            assert sum(len(ALNUM.findall(raw[s.begin : s.end].decode().translate(LOW))) for s in got[d].spans) == got[d].n_hit


def test_contamination_edges(sp):
    empty = sp.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(table(sp, ODD), empty).collect()} == {0}
    assert decontaminate.contamination(nothing(sp), empty).count() == 0
    item = "one two three four five six seven eight nine ten eleven"
    bench = sp.createDataFrame([(1, item)], "item_id long, text string")
    texts = [f"keep this, {item.upper()}! and this " + "more words " * 20, item, "clean text", None]
    out = {r.doc_id: r for r in decontaminate.decontaminate(table(sp, texts), bench).collect()}
    assert out[0].text == "keep this, ! and this " + "more words " * 20 and 1 not in out and out[2].text == "clean text" and out[3].text is None
    assert out[0].point == "clash"


# ---------------------------------------------------------------- 7 licences


def test_license_base_against_brute_force(sp):
    rng = random.Random(7)
    words = ["mit", "license", "apache", "general", "public", "MIT", "License,", "x", "(gpl)"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(150)] + ODD
    got = {r.doc_id: r for r in licenses.scan(table(sp, texts)).collect()}
    for i, t in enumerate(texts):
        w = ALNUM.findall((t or "").translate(LOW))
        at, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            own = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += own
            labels |= {label} if own else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_templates(sp):
    index = licenses.RareTokenIndex()
    texts, names = [], []
    for name, (t, _) in licenses.TEMPLATES.items():
        texts.append("Some code here. " + t.upper() + " and then code")
        names.append(name)
    texts += ["Licensed under CC BY-NC 4.0.", "permission is not granted; free of charge to no person"]
    got = [r.labels.split(",") for r in licenses.scan(table(sp, texts)).orderBy("doc_id").collect()]
    for name, labels in zip(names, got, strict=False):
        assert name in labels
    assert got[-2] == ["cc-by-nc"] and got[-1] == [""]
    assert len(index.labels) == len(licenses.TEMPLATES) and licenses.scan(nothing(sp)).count() == 0


def test_license_templates_in_files_that_hold_many_rare_words(sp):
    english = "may not file at are following for above all person deal files form code subject into released library " * 20
    notice = "Licensed under the Apache License, Version 2.0"
    every = "\n".join(t for t, _ in licenses.TEMPLATES.values())
    names = set(licenses.TEMPLATES)
    rows = licenses.scan(table(sp, [english + notice + " " + english, every, english + every, english])).orderBy("doc_id").collect()
    got = [{f.label for f in r.found} for r in rows]
    assert got == [{"apache-2.0"}, names, names, set()]


def test_license_lookups_find_every_position_that_covers_a_template():
    rng = random.Random(3)
    index = licenses.RareTokenIndex()
    for _ in range(300):
        t = rng.randrange(len(index.labels))
        words = index.templates[t].copy()
        for k in rng.sample(range(len(words)), rng.randint(0, len(words) // 3)):
            words[k] = -1
        ids = np.concatenate([np.array(rng.choices(range(len(index.vocab)), k=30)), words, np.full(5, -1)])
        want = set()
        for u, template in enumerate(index.templates):
            mass = index.idf[template]
            for begin in range(-len(template), len(ids)):
                span = np.arange(begin, begin + len(template))
                inside = (span >= 0) & (span < len(ids))
                same = inside & (ids[np.clip(span, 0, len(ids) - 1)] == template)
                keys = all(len(licenses.places(ids[max(0, begin) : max(0, begin + len(template))], k)) for k in index.keys[u])
                if mass[same].sum() / mass.sum() >= licenses.COVERAGE and keys:
                    want.add(index.labels[u])
        assert set(index.found(ids)) == want


# ---------------------------------------------------------------- 8 shards


def byte_vocabulary():
    ranks = {bytes([b]): b for b in range(256)} | {b"th": 256, b"the": 257, b" the": 258, b"in": 259}
    return token_shards.Vocabulary(ranks, token_shards.PATTERN, len(ranks))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    slots = token_shards.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n)) and (token_shards.unfeistel(slots, n) == np.arange(n)).all()
    if n >= 1000:
        assert (slots != token_shards.feistel(np.arange(n), n, key=1)).mean() > 0.9


def test_shards_hold_every_token_in_order(sp, tmp_path):
    v = byte_vocabulary()
    docs = table(sp, ODD).coalesce(1)
    out = token_shards.materialise(docs, str(tmp_path), v, length=64, per_shard=50).collect()
    n = len(out)
    assert sorted(r.slot for r in out) == list(range(n))
    held = dict(token_shards.read(str(tmp_path), 0, 64, 50))
    assert len(held) == n and [s for s, _ in token_shards.read(str(tmp_path), 70, 64, 50)] == list(range(70, n))
    for r in out:
        assert (r.shard, r.offset, r.crc32) == (r.slot // 50, r.slot % 50 * 128, crc32(held[r.slot].tobytes()))
    stream = np.concatenate([held[s] for s in token_shards.feistel(np.arange(n), n).tolist()]).tolist()
    encode = v.encoding().encode_ordinary
    want = [t for text in ODD for t in [*encode(text or ""), v.end]]
    assert stream[: len(want)] == want and set(stream[len(want) :]) <= {v.end}
    by_index = {int(i): r for r, i in zip(out, token_shards.unfeistel(np.array([r.slot for r in out]), n), strict=True)}
    assert by_index[0].doc_ids[:4] == [0, 1, 2, 3]
    assert token_shards.materialise(nothing(sp), str(tmp_path / "none"), v).count() == 0


def test_rank_file(tmp_path):
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" " + str(b).encode() for b in range(256)))
    assert token_shards.load(str(path)).end == 256


# ---------------------------------------------------------------- 9 Jaccard join


def shingle_sets(texts, size=4):
    out = {}
    for i, t in texts:
        w = SPACED.findall((t or "").translate(LOW))
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def component_names(sets, percent):
    names = {i: i for i in sets}

    def find(x):
        while names[x] != x:
            x = names[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            names[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_copies(seed, groups=14, most=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 3, 4, 7, 9, 20, 60, 150, 400]))]
        if rng.random() < 0.4:
            base[rng.randint(0, len(base)) : 0] = passage
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = [word()] * rng.randint(0, 1) or w[p : p + 1]
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "percent", "size", "small"), [(1, 85, 4, 64), (2, 85, 4, 3), (3, 80, 5, 2), (4, 30, 4, 4), (5, 50, 3, 64), (6, 66, 4, 2), (7, 100, 4, 2)])
def test_components_are_exact(sp, seed, percent, size, small):
    texts = list(enumerate(near_copies(seed) + ODD + ["the cat sat", "THE cat sat"]))
    sets = shingle_sets(texts, size)
    want = component_names(sets, percent)
    df = table(sp, [t for _, t in texts]).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(df, percent=percent, size=size, small=small, held=7, passing=5).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize(("pivots", "large"), [(1, 1 << 14), (3, 1 << 14), (2, 10)])
def test_regions_split_and_join_exactly(sp, pivots, large):
    """A large group just around the limit, where every link is found by regions, and by regions of regions."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(90):
        w = list(base)
        for p in rng.sample(range(200), rng.randint(1, 6)):
            w[p] = f"x{rng.random()}"
        texts.append(" ".join(w))
    sets = shingle_sets(list(enumerate(texts)))
    want = component_names(sets, 85)
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_components(table(sp, texts).repartition(5), pivots=pivots, small=4, large=large, held=6, passing=9).collect()}
    assert got == want and 1 < len(set(want.values()))


def test_hot_passages_in_five_word_shingles(sp):
    """Texts of few passages that most others hold too, at the pipeline's limit."""
    rng = random.Random(4)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(8)]
    texts = []
    for _ in range(260):
        w = [x for k in rng.sample(range(8), rng.choice([2, 3, 5])) for x in passages[k]]
        texts.append(" ".join(w + [f"u{rng.random()}" for _ in range(rng.choice([0, 0, 1, 3, 12, 30]))]))
    sets = shingle_sets(list(enumerate(texts)), 5)
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_components(table(sp, texts).repartition(4), percent=80, size=5, small=8).collect()}
    assert got == component_names(sets, 80)


def test_prefixes_meet():
    for percent in (30, 66, 80, 85, 100):
        share = Fraction(percent, 100)
        for n in range(1, 300):
            assert jaccard_join.prefix_length(np.array([n]), share)[0] == n - math.ceil(share * n) + 1


def test_one_of_each_and_edges(sp):
    texts = ["a b c d e f g", "a b c d e f g", "x y z", None, "", "x y z"]
    ids = [5, 3, 8, 9, 10, 8]
    out = jaccard_join.one_of_each(table(sp, texts, ids), percent=80, size=5)
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(3, "a b c d e f g"), (8, "x y z")]
    assert {9, 10} <= {r.doc_id for r in out.collect()} and out.columns == table(sp, texts, ids).columns
    assert jaccard_join.similarity_components(nothing(sp)).count() == 0
    nulls = jaccard_join.similarity_components(table(sp, ["q r s t u"] * 2, [None, 4])).collect()
    assert {r.component_id for r in nulls} == {4}


def test_near_copies_without_ids_and_clashing_names(sp):
    w = [f"w{i}" for i in range(100)]
    near = w[:-1] + ["other"]
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_components(table(sp, [" ".join(w), " ".join(near), " ".join(near)], [7, None, None])).collect()}
    assert got == {7: 7, None: 7}
    df = table(sp, [" ".join(w), " ".join(near), "else"], [3, 2, 1]).withColumn("same", F.lit("s")).withColumn("row", F.lit("r")).withColumn("id", F.lit(5))
    out = jaccard_join.one_of_each(df, percent=80, size=5)
    assert out.columns == df.columns and sorted((r.doc_id, r.same, r.row, r.id, r.point) for r in out.collect()) == [(1, "s", "r", 5, "clash"), (2, "s", "r", 5, "clash")]


# ---------------------------------------------------------------- 10 suffix tree


def test_language_model_against_brute_force(sp, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HEAD", 40)  # most words are met in the join
    monkeypatch.setattr(suffix_tree, "LEAST", 20)
    rng = random.Random(10)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(300):
        t, w = [], rng.choice(words)
        for _ in range(rng.randint(0, 30)):
            t.append(w)
            w = words[(words.index(w) * 7 + rng.choice([1, 1, 1, 2, 5])) % 60]
        texts.append(" ".join(t) if rng.random() < 0.9 else " ".join(t).upper() + " rare" + str(rng.random()))
    texts += ODD
    rows = {r.doc_id: r for r in suffix_tree.evaluate(table(sp, texts).repartition(3)).collect()}
    tokens = {i: [*SPACED.findall((t or "").translate(LOW)), None] for i, t in enumerate(texts)}
    count = collections.Counter(t for i, ts in tokens.items() if crc32(str(i).encode()) % 10 for t in ts)
    n, v = sum(count.values()), len(count)
    for i, ts in tokens.items():
        r = rows[i]
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc32(str(i).encode()) % 10 == 0, len(ts), sum(count[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_state_is_a_distribution(sp):
    texts = ["a b a b a c"] * 200 + ["b a d e"] * 200 + [None, ""]
    docs = table(sp, texts).select("text")
    vocab = suffix_tree.vocabulary(docs)
    tree = suffix_tree.grow(vocab, suffix_tree.count_contexts(docs, vocab), least=10)
    assert len(tree.log_p) > 1 and (tree.two >= 0).any()
    p = 10**tree.log_p
    rest = 1 - p[0, : suffix_tree.CLASSES].sum()
    sums = p[:, : suffix_tree.CLASSES].sum(1) + p[:, suffix_tree.CLASSES] * rest
    assert np.allclose(sums, 1, atol=1e-6)


def suffix_tree_by_hand(tokens, train, least, prior=30.0):
    """Each document's log10 probability by all contexts of any length, without pruning."""
    count = collections.Counter(t for i in train for t in tokens[i])
    n, v = sum(count.values()), len(count)
    after = collections.defaultdict(collections.Counter)
    for i in train:
        ts = [None, *tokens[i]]
        for k in range(1, len(ts)):
            for lo in range(k):
                after[tuple(ts[lo:k])][ts[k]] += 1
    states = set()
    for ctx, c in after.items():
        up = after[ctx[1:]] if len(ctx) > 1 else count
        m, total = sum(c.values()), sum(up.values())
        kept = {t: x for t, x in c.items() if x >= suffix_tree.KEEP}
        gain = sum((x - 1) * math.log(x / m * total / up[t]) for t, x in kept.items())
        if m >= least and gain > 0 and gain >= 0.25 * max(1, len(kept)) * math.log(m):
            states.add(ctx)

    def p(ctx, t):
        if not ctx:
            return (count[t] + 0.1) / (n + 0.1 * (v + 1))
        below = p(ctx[1:], t)
        if ctx not in states:
            return below
        total, kept = sum(after[ctx].values()), {w: x for w, x in after[ctx].items() if x >= suffix_tree.KEEP}
        return (kept.get(t, 0) + (prior + total - sum(kept.values())) * below) / (total + prior)

    return [sum(math.log10(p(tuple([None, *ts][:k]), t)) for k, t in enumerate(ts, 1)) for ts in tokens], states


@pytest.mark.parametrize("head", [30, 1 << 19])
def test_suffix_tree_of_the_whole_vocabulary_at_any_depth(sp, monkeypatch, head):
    monkeypatch.setattr(suffix_tree, "HEAD", head)
    monkeypatch.setattr(suffix_tree, "LEAST", 15)
    rng = random.Random(11)
    filler = [f"f{i}" for i in range(1200)]
    texts = [" ".join(filler[k : k + 12]) for k in range(0, 1200, 12) for _ in range(3)]  # of higher rank than what follows
    for i in range(150):  # the word four words before tells the next one
        a = rng.choice("xy")
        texts.append(" ".join([rng.choice(filler), f"{a}1", "b", "c", "d", f"{a}2" if rng.random() < 0.9 else f"z{i}", rng.choice(filler)]))
    texts += [None, "", "x1 b c d y2", "unknown b c d unknown"]
    rows = {r.doc_id: r for r in suffix_tree.evaluate(table(sp, texts).repartition(3)).collect()}
    tokens = [[*(t or "").split(), None] for t in texts]
    train = [i for i in range(len(texts)) if crc32(str(i).encode()) % 10]
    want, states = suffix_tree_by_hand(tokens, train, 15)
    assert ("x1", "b", "c", "d") in states
    assert [rows[i].score for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_tokens_in_the_same_place_of_the_tree_ask_once(sp, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HEAD", 40)  # known counts are larger than the number of answers
    monkeypatch.setattr(suffix_tree, "LEAST", 15)
    tables = {}
    monkeypatch.setattr(suffix_tree, "written", lambda df, name, *more: tables.setdefault(name, written(df, name, *more)) if name == "scored" else written(df, name, *more))
    rng = random.Random(12)
    texts = [" ".join(x for _ in range(40) for x in (f"a{rng.randint(0, 9)}", f"b{rng.randint(0, 9)}", "the")) for _ in range(60)]
    rows = suffix_tree.evaluate(table(sp, texts).coalesce(1))
    assert "(key" not in rows._jdf.queryExecution().optimizedPlan().toString()  # no token is a row of a join
    asked = sum(len(r.raw) // 8 for r in tables["scored"].filter("part >= 0").collect())
    assert 0 < asked < 1000 < sum(len(t.split()) for t in texts)
    tokens = [[*t.split(), None] for t in texts]
    want, _ = suffix_tree_by_hand(tokens, [i for i in range(len(texts)) if crc32(str(i).encode()) % 10], 15)
    rows = {r.doc_id: r.score for r in rows.collect()}
    assert [rows[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_language_model_edges(sp):
    assert suffix_tree.evaluate(nothing(sp)).count() == 0
    held = [i for i in range(200) if crc32(str(i).encode()) % 10 == 0][:3]
    rows = suffix_tree.evaluate(table(sp, ["a b", None, ""], held)).collect()
    assert [(r.held_out, r.train_tokens, r.base_score, r.score) for r in rows] == [(True, 0, 0.0, 0.0)] * 3
