"""Toxicity: Levenshtein automata intersected with a lexicon trie, weighed by context windows.

The lexicon (whole words, and stems that any ending may follow) is learned from a bounded sample of
labelled documents: entries that toxic documents hold in many different surroundings and clean ones
hardly hold. All entries' Levenshtein automata are run together along the trie and made one
deterministic byte automaton, so a block's words are matched by one table look-up a byte. A hit
counts less when it is misspelled, when it stands in quotation marks or near words of reporting, and
more when it is addressed to someone. A logistic model over a document's hits gives the score.

Memory: the automaton (at most MAX_ENTRIES entries) and one block of texts on an executor; the sample
streams through the driver. Edge cases: null, empty and word-less texts have no hits and get the
score of a document without hits; without labels of both classes the lexicon is empty and the score
is the share of label 1 (0.1 if none).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through, trimmed
from .labelled import held_out, training_sample
from .vectext import ALNUM, Words, find_words, text_blocks

PER_CLASS = 2500
MAX_ENTRIES = 200
MAX_STATES = 60_000
STEMS = (3, 4, 5, 6, 7, 8)
#: An entry is seen in so many surroundings at least; its log odds less one standard error are at
#: least this; so large a share of the toxic texts hold it.
SURROUNDINGS, LEAST_ODDS, WORD_SHARE, STEM_SHARE = 3, 1.2, 0.05, 0.02
WINDOW = 6  # words before and after a hit
AGAIN = 0.1  # the weight of the same word once more
QUOTED, REPORTED, DIRECT = 0.4, 0.6, 1.2
MARKS = tuple(m.encode() for m in ('"', "“", "”", "„", "«", "»", "‘", "’"))
REPORTING = frozenset(w.encode() for w in "called calls cited citing phrase quote quoted quotes reported said says slur term word words wrote".split())
ADDRESS = frozenset(w.encode() for w in "are du eres es ist is sois tu vous you your".split())


def edits(entry: bytes, stem: bool) -> int:
    """How many misspellings an entry may have, by its length."""
    n = len(entry)
    return 0 if n < (6 if stem else 5) else 1 if n < 10 else 2


class Automaton:
    """A deterministic automaton over bytes for all entries with their misspellings. The first byte
    has to be right. table[state, class of byte]; state 0 is dead, 1 the start."""

    def __init__(self, entries: list[tuple[bytes, bool]]):
        self.entries = entries
        kids: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        most = [0]
        for k, (word, stem) in enumerate(entries):
            node, budget = 0, edits(word, stem)
            for c in word:
                most[node] = max(most[node], budget)
                if c not in kids[node]:
                    kids[node][c] = len(kids)
                    kids.append({})
                    ends.append([])
                    most.append(0)
                node = kids[node][c]
            most[node] = max(most[node], budget)
            ends[node].append(k)
        letters = sorted({c for word, _ in entries for c in word})
        self.classes = np.zeros(256, np.uint8)
        for i, c in enumerate(letters, 1):
            self.classes[c] = i

        def close(items: set) -> frozenset:
            todo, out = list(items), set(items)
            while todo:
                item = todo.pop()
                node, used = item
                if node < 0:
                    continue
                new = set()
                if node and used < most[node]:
                    new |= {(child, used + 1) for child in kids[node].values()}  # a byte is missing
                todo += new - out
                out |= new
            best = {}
            for node, used in out:
                best[node] = min(used, best.get(node, used))
            return frozenset(best.items())

        def step(state: frozenset, c: int | None) -> frozenset:
            new = set()
            for node, used in state:
                if node < 0:
                    new.add((node, used))
                    continue
                new |= {(-1 - k, used) for k in ends[node] if entries[k][1] and used <= edits(*entries[k])}  # a stem that goes on is found for good
                if c in kids[node]:
                    new.add((kids[node][c], used))
                if node and used < most[node]:
                    new.add((node, used + 1))  # a byte too many
                    new |= {(child, used + 1) for child in kids[node].values()}  # another byte
            return close(new)

        begin = frozenset({(0, 0)})
        index, order, rows = {frozenset(): 0, begin: 1}, [frozenset(), begin], []
        for state in order:
            row = []
            for c in (None, *letters):
                to = step(state, c) if state else frozenset()
                if to not in index:
                    if len(order) >= MAX_STATES:
                        raise ValueError("the lexicon makes too large an automaton; lower MAX_ENTRIES")
                    index[to] = len(order)
                    order.append(to)
                row.append(index[to])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.entry = np.full(len(order), -1, np.int32)
        self.errors = np.zeros(len(order), np.int8)
        for s, state in enumerate(order):
            found = [(used, -1 - node) for node, used in state if node < 0]
            found += [(used, k) for node, used in state if node >= 0 for k in ends[node] if not entries[k][1] and used <= edits(*entries[k])]
            if found:
                self.errors[s], self.entry[s] = min(found)

    def match(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of matched words, entries, errors)."""
        alive = np.arange(len(words.start))
        state = np.ones(len(alive), np.int32)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(alive):
            at = words.start[alive] + step
            done = at >= words.end[alive]
            if done.any():
                out.append((alive[done], state[done]))
                alive, state, at = alive[~done], state[~done], at[~done]
            state = self.table[state, self.classes[words.buf[at]]]
            keep = state > 0
            alive, state = alive[keep], state[keep]
            step += 1
        if not out:
            return (np.zeros(0, np.int64),) * 3
        places, states = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        keep = self.entry[states] >= 0
        places, states = places[keep], states[keep]
        order = np.argsort(places)
        return places[order], self.entry[states[order]], self.errors[states[order]]


def context(words: Words, buf: np.ndarray, doc: int, place: int) -> float:
    """How much a hit counts, by the words and marks around it."""
    lo, hi = max(int(words.first[doc]), place - WINDOW), min(int(words.first[doc + 1]), place + WINDOW + 1)
    before = buf[words.start[lo] : words.start[place]].tobytes()
    after = buf[words.end[place] : words.end[hi - 1]].tobytes() if hi - 1 > place else b""
    edge = int(words.offsets[doc + 1])
    after += buf[words.end[hi - 1] : min(edge, int(words.end[hi - 1]) + 4)].tobytes()
    before = buf[max(int(words.offsets[doc]), int(words.start[lo]) - 4) : words.start[lo]].tobytes() + before
    if any(m in before for m in MARKS) and any(m in after for m in MARKS):
        return QUOTED
    near = {words.word(i) for i in range(lo, hi) if i != place}
    if near & REPORTING:
        return REPORTED
    return DIRECT if near & ADDRESS and any(words.word(i) in ADDRESS for i in range(max(lo, place - 2), place)) else 1.0


@dataclass
class Model:
    automaton: Automaton
    weight: np.ndarray  # by (entry, misspelled)
    coef: tuple[float, float, float]

    def evidence(self, words: Words, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, float]]]:
        """(sum of weights, hits) by document, and the hits (place, entry, errors, weight)."""
        total, count, hits = np.zeros(words.n_docs), np.zeros(words.n_docs), []
        seen = set()
        for place, k, errors in zip(*(x.tolist() for x in self.automaton.match(words)), strict=True):
            w = float(self.weight[k, min(1, errors)])
            if w > 0:
                doc = int(np.searchsorted(words.first, place, "right")) - 1
                w *= context(words, buf, doc, place)
                said = (doc, words.word(place))
                w *= AGAIN if said in seen else 1.0
                seen.add(said)
                total[doc] += w
                count[doc] += w > 0.5
                hits.append((place, k, errors, w))
        return total, count, hits

    def score(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        a, b, c = self.coef
        return 1 / (1 + np.exp(-np.clip(a + b * np.minimum(total, 12) + c * np.log1p(count), -500, 500)))


def _words(text: str) -> list[str]:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = find_words(raw, np.array([0, len(raw)]), ALNUM, fingerprints=False)
    return [w.word(i).decode("utf-8", "replace") for i in range(len(w.start))]


Key = tuple[str, bool]  # a whole word, or a stem that at least one more character follows


def _keys(word: str) -> Iterator[Key]:
    if len(word) >= 4:
        yield word, False
    for n in STEMS:
        if len(word) <= n:
            break
        yield word[:n], True


def _pick(toxic: Callable[[], Iterable[str]], clean: Callable[[], Iterable[str]], stems: bool, skip: frozenset[str], share: float) -> dict[Key, tuple[int, float]]:
    """{entry: (toxic texts that hold it, log odds)} of the entries of one kind that speak for
    toxicity with certainty, in ever other surroundings; words in skip are left out of account."""
    held: dict[Key, int] = defaultdict(int)
    n_toxic = 0
    for text in toxic():
        n_toxic += 1
        for key in {key for w in set(_words(text)) - skip for key in _keys(w) if key[1] == stems}:
            held[key] += 1
    least = max(SURROUNDINGS, share * n_toxic)
    held = {k: v for k, v in held.items() if v >= least}
    against: dict[Key, int] = dict.fromkeys(held, 0)
    n_clean = 0
    for text in clean():
        n_clean += 1
        for key in {key for w in set(_words(text)) - skip for key in _keys(w) if key in against}:
            against[key] += 1

    def odds(k: Key, errors: float = 0.0) -> float:
        p, q = held[k] + 0.5, against[k] + 0.5
        return math.log(p / (n_toxic + 1)) - math.log(q / (n_clean + 1)) - errors * math.sqrt(1 / p + 1 / q)

    good = {k for k in held if odds(k, 1.0) >= LEAST_ODDS}
    around: dict[Key, set] = {k: set() for k in good}
    for text in toxic():
        words = ["", *_words(text), ""]
        for i in range(1, len(words) - 1):
            for key in _keys(words[i]):
                if key in good and words[i] not in skip:
                    around[key].add((words[i - 1], words[i + 1]))
    return {k: (held[k], odds(k)) for k in good if len(around[k]) >= max(SURROUNDINGS, 0.5 * held[k])}


def learn_lexicon(toxic: Callable[[], Iterable[str]], clean: Callable[[], Iterable[str]]) -> list[tuple[str, bool, float]]:
    """(entry, is a stem, log odds): whole words that many toxic texts hold, then stems of the rest.
    The words of a text that was copied with small changes stand among the same words each time,
    so they are not taken for entries. Of nested stems, the longest that is not rarer says it best."""
    words = _pick(toxic, clean, False, frozenset(), WORD_SHARE)
    stems = _pick(toxic, clean, True, frozenset(w for w, _ in words), STEM_SHARE)
    chosen = sorted(words, key=lambda k: (-words[k][0], k[0]))[: MAX_ENTRIES // 2]
    for key in sorted(stems, key=lambda k: (-stems[k][0] * stems[k][1], -len(k[0]), k[0])):
        word = key[0]
        better = any(o != key and o[0].startswith(word) and stems[o][0] >= 0.9 * stems[key][0] for o in stems)
        nested = any(s and (word.startswith(o) or o.startswith(word)) for o, s in chosen)
        if not better and not nested and len(chosen) < MAX_ENTRIES:
            chosen.append(key)
    found = words | stems
    return [(w, s, found[w, s][1]) for w, s in chosen]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, remainder: int = 2, per_class: int = PER_CLASS) -> Model:
    sample, counts = training_sample(docs, labels, label, mod, remainder, per_class)
    texts: dict[int, set[bytes]] = {0: set(), 1: set()}
    for r in sample.select("label", "text").toLocalIterator():
        texts[r["label"]].add(r["text"].encode())  # exact copies count once
    own = {k: sorted(v) for k, v in texts.items()}
    lexicon = learn_lexicon(lambda: (t.decode() for t in own[1]), lambda: (t.decode() for t in own[0])) if own[0] and own[1] else []
    automaton = Automaton([(w.encode(), s) for w, s, _ in lexicon])
    n = sum(counts.values())
    share = counts.get(1, 0) / n if n else 0.1
    weight = np.zeros((max(1, len(lexicon)), 2))
    weight[: len(lexicon), 0] = [min(5.0, o) for _, _, o in lexicon]
    if not lexicon:
        return Model(automaton, weight, (math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0))
    # A misspelling is trusted as far as clean texts lack it.
    seen = np.zeros((len(lexicon), 2))
    blocks = []
    for k in (0, 1):
        column = pa.array([t.decode() for t in own[k]], pa.large_string())
        for _, _, buf, offsets in text_blocks(column):
            words = find_words(buf, offsets, ALNUM, fingerprints=False)
            blocks.append((k, buf, words))
            places, entries, errors = automaton.match(words)
            exact = set(np.searchsorted(words.first, places[errors == 0], "right").tolist())
            for p, e in zip(places[errors > 0].tolist(), entries[errors > 0].tolist(), strict=True):
                if int(np.searchsorted(words.first, p, "right")) not in exact:
                    seen[e, k] += 1
    rate = (seen[:, 1] + 1.0) / (len(own[1]) + 1) / ((seen[:, 0] + 0.5) / (len(own[0]) + 1))
    weight[:, 1] = np.clip(np.where(seen[:, 0] > 2 + 0.002 * len(own[0]), np.log(rate) - 1, np.log(rate)), 0, 3.0)
    model = Model(automaton, weight, (0.0, 0.0, 0.0))
    x, y = [], []
    for k, buf, words in blocks:
        total, count, _ = model.evidence(words, buf)
        x.append(np.column_stack([np.ones(len(total)), np.minimum(total, 12), np.log1p(count)]))
        y.append(np.full(len(total), k))
    xs, ys = np.concatenate(x), np.concatenate(y)
    each = np.where(ys == 1, share / max(1, (ys == 1).sum()), (1 - share) / max(1, (ys == 0).sum()))
    coef = np.zeros(3)
    for _ in range(60):  # Newton steps of a ridge-regularised logistic regression
        p = 1 / (1 + np.exp(-np.clip(xs @ coef, -30, 30)))
        ridge = np.diag([1e-6, 1e-3, 1e-3])
        grad = xs.T @ (each * (p - ys)) + ridge @ coef
        step = np.linalg.solve((xs * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ xs + ridge, grad)
        coef -= np.clip(step, -2, 2)
    return Model(automaton, weight, (float(coef[0]), max(0.0, float(coef[1])), max(0.0, float(coef[2]))))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_hits, terms): terms are the matched words in order, with their entry and weight."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[doc_id].dataType.simpleString()
    terms = pa.list_(pa.struct([("term", pa.string()), ("entry", pa.string()), ("errors", pa.int32()), ("weight", pa.float64())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo, hi, buf, offsets in text_blocks(batch.column(1)):
                words = find_words(buf, offsets, ALNUM, fingerprints=False)
                total, count, hits = m.evidence(words, buf)
                found: list[list] = [[] for _ in range(hi - lo)]
                for place, k, errors, w in hits:
                    entry, stem = m.automaton.entries[k]
                    doc = int(np.searchsorted(words.first, place, "right")) - 1
                    found[doc].append({"term": words.word(place).decode("utf-8", "replace"), "entry": entry.decode("utf-8", "replace") + "*" * stem, "errors": errors, "weight": w})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(m.score(total, count)), pa.array(count.astype(np.int64)), pa.array(found, terms)], names=["doc_id", "score", "n_hits", "terms"]
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        trimmed(run), f"doc_id {id_type}, score double, n_hits bigint, terms array<struct<term:string,entry:string,errors:int,weight:double>>"
    )


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits)."""
    out = score(docs, fit(docs, labels, mod=mod, remainder=remainder))
    return out.select("doc_id", held_out(mod, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def reject(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs without the texts that score threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def change(batch):
        keep = np.ones(batch.num_rows, bool)
        for lo, hi, buf, offsets in text_blocks(batch.column(place)):
            total, count, _ = shared.value.evidence(find_words(buf, offsets, ALNUM, fingerprints=False), buf)
            keep[lo:hi] = shared.value.score(total, count) < threshold
        return batch if keep.all() else batch.filter(pa.array(keep))

    return through(docs, change)
