"""Toxicity by Levenshtein automata over a lexicon trie.

`LexiconTrie` holds terms (whole words) and stems (the beginning of a word).
A Levenshtein automaton of radius 1 reads the trie's edges and the word at
once: its state is the row of edit distances, cut off above the radius, and
branches without a live entry are left. A word reaches the automaton only if
it shares an unedited half with some entry (with one edit, one of the two
halves is untouched), which loses nothing and spares most words the walk.

Hits are weighed in a window of tokens: quotation marks around a hit, or a
reporting word near it, make it a quotation. A logistic regression on the
counts of exact, stem and misspelled hits, quoted and not, gives the score.

The lexicon is learned from labelled training rows, and so are the
regression's weights: from at most `sample` of them, those with the smallest
hash of doc_id (documented bound). Scoring covers all rows and whole texts.
Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null text is empty and gets the score of a text without hits.
Without training rows of both classes the lexicon is empty and the score is
the share of toxic training rows, smoothed. Repeated rows give repeated
results; of repeated labels each counts. A very long text is read whole, by
one task. Without documents there are no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Columns, documents_of, rows_of, scratch_table
from .encoding import by_size

_WORD = re.compile(r"[^\W_]+(?:[*@$!'][^\W_]+)*|[\"“”«»„]")
_QUOTES = frozenset('"“”«»„')
#: Words that report what others said.
REPORTING = frozenset("said says wrote writes quoted quote called calls reported dijo escribió llamó dit écrit appelé sagte schrieb nannte".split())


class LevenshteinAutomaton:
    """Accepts the strings within `radius` edits of a word.

    A state maps places in the word to distances, only those within the
    radius: at most 2 * radius + 1 of them are live at once.
    """

    def __init__(self, word: str, radius: int):
        self.word, self.radius, self.end = word, radius, len(word)

    def start(self) -> dict[int, int]:
        return {i: i for i in range(min(self.radius, self.end) + 1)}

    def step(self, state: dict[int, int], letter: str) -> dict[int, int]:
        out: dict[int, int] = {}
        over = self.radius + 1
        for i, d in state.items():
            out[i] = min(out.get(i, over), d + 1)  # the letter is one too many
            if i < self.end:
                out[i + 1] = min(out.get(i + 1, over), d + (self.word[i] != letter))
        for i in sorted(out):  # letters of the word left out
            while out[i] < self.radius and i < self.end and out.get(i + 1, over) > out[i] + 1:
                out[i + 1] = out[i] + 1
                i += 1
        return {i: out[i] for i in sorted(out) if out[i] <= self.radius}

    def accepts(self, state: dict[int, int]) -> bool:
        return self.end in state


class LexiconTrie:
    """Terms and stems; match(word) says how the lexicon takes a word."""

    EXACT, STEM, NEAR, NEAR_STEM = range(4)

    def __init__(self, terms: set[str], stems: set[str], least: int = 5):
        """`least`: letters that an entry needs to be matched with an edit."""
        self.terms, self.stems, self.least = terms, stems, least
        self.root: dict = {}
        for kind, entries in (("term", terms), ("stem", stems)):
            for entry in entries:
                if len(entry) >= least:
                    node = self.root
                    for c in entry:
                        node = node.setdefault(c, {})
                    node[kind] = True
        self.heads = {e[: len(e) // 2] for e in terms | stems if len(e) >= least}
        self.tails = {e[len(e) // 2 :] for e in terms if len(e) >= least}
        self.inner = {(len(e) // 2 + shift, e[len(e) // 2 :]) for e in stems if len(e) >= least for shift in (-1, 0, 1)}
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.inner_sizes = sorted({(at, len(x)) for at, x in self.inner})
        self.stem_sizes = sorted({len(x) for x in stems})
        self.longest = max(map(len, terms | stems), default=0)

    def match(self, word: str) -> int | None:
        if word in self.terms:
            return self.EXACT
        if any(word[:n] in self.stems for n in self.stem_sizes):
            return self.STEM
        if len(word) < self.least - 1 or not (
            any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes) or any((at, word[at : at + n]) in self.inner for at, n in self.inner_sizes)
        ):
            return None
        return self.near(word[: self.longest + 2], len(word) <= self.longest + 1)

    def near(self, word: str, whole: bool) -> int | None:
        """Intersects the word's automaton of radius 1 with the trie."""
        own = LevenshteinAutomaton(word, 1)
        waiting, found = [(self.root, own.start())], None
        while waiting:
            node, state = waiting.pop()
            if whole and "term" in node and own.accepts(state):
                return self.NEAR
            if "stem" in node:  # some beginning of the word is near the stem
                found = self.NEAR_STEM
            for c, below in node.items():
                if len(c) == 1:
                    after = own.step(state, c)
                    if after:
                        waiting.append((below, after))
        return found


N_FEATURES = 9


@dataclass
class ToxicityModel:
    terms: set[str]
    stems: set[str]
    weights: np.ndarray
    window: int

    @cached_property
    def trie(self) -> LexiconTrie:
        return LexiconTrie(self.terms, self.stems)

    def features(self, text: bytes, cache: dict[str, int | None]) -> np.ndarray:
        """1, the logarithm of 1 + unquoted and quoted hits of each kind."""
        words = _WORD.findall(text.decode("utf-8", "replace").lower())
        for w in set(words).difference(cache):
            cache[w] = self.trie.match(w)
        kinds = list(map(cache.__getitem__, words))
        counts = np.zeros(8)
        if kinds.count(None) < len(kinds):
            quotes = [i for i, w in enumerate(words) if w in _QUOTES]
            told = {i for i, w in enumerate(words) if w in REPORTING}
            for i, kind in enumerate(kinds):
                if kind is not None:
                    before, after = bisect_left(quotes, i), bisect_right(quotes, i)
                    open_before = before % 2 and after < len(quotes) and quotes[after] - i <= self.window
                    counts[kind + 4 * bool(open_before or any(j in told for j in range(i - self.window, i + self.window + 1)))] += 1
        return np.concatenate([[1.0], np.log1p(counts)])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's steps; the constant isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _entries(text: bytes) -> list[str]:
    return [w for w in _WORD.findall(text.decode("utf-8", "replace").lower()) if len(w) >= 3]


def _varied(train: DataFrame, marked: list, least: int) -> set[tuple[bool, str]]:
    """The marked entries that follow at least `least` different words: copies of one text name one neighbour only."""
    own = {(r.stem, r.entry) for r in marked}  # bounded by the caller

    def run(batches):
        found = set()
        for batch in batches:
            for (text,) in rows_of(batch):
                words = _entries(text)
                for before, w in zip(["", *words], words, strict=False):
                    found.update((stem, e, before) for stem, e in ((False, w), *((True, w[:n]) for n in range(4, min(len(w), 8)))) if (stem, e) in own)
        rows = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["stem", "entry", "before"])

    pairs = train.where("label = 1").select("text").mapInArrow(run, "stem boolean, entry string, before string").distinct()
    return {(r.stem, r.entry) for r in pairs.groupBy("stem", "entry").count().where(F.col("count") >= least).collect()}


def learn_lexicon(train: DataFrame, least_docs: int = 5, purity: float = 0.9) -> tuple[set[str], set[str]]:
    """Terms and stems that mark label 1: Spark counts, for each word and word beginning, the documents of either label.

    An entry needs `least_docs` documents and as many different words before
    it. Of beginnings that say the same, the shortest is kept. The lexicon is
    bounded by the training sample: it has at most a `least_docs`th of the
    different words and beginnings of the sample's documents, summed.
    """

    def run(batches):
        found: Counter = Counter()

        def rows():
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k[1] for k in keys], pa.string()), pa.array([k[0] for k in keys], pa.bool_()), pa.array([found[k] if k[2] else 0 for k in keys], pa.int64()), pa.array([0 if k[2] else found[k] for k in keys], pa.int64())], ["entry", "stem", "bad", "good"])

        for batch in batches:
            for text, label in rows_of(batch):
                words = set(_entries(text))
                found.update((False, w, label == 1) for w in words)
                found.update((True, s, label == 1) for s in {w[:n] for w in words for n in range(4, min(len(w), 8))})
                if len(found) > 500_000:
                    yield rows()
                    found.clear()
        yield rows()

    counts = train.select("text", "label").mapInArrow(run, "entry string, stem boolean, bad long, good long").groupBy("entry", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    marked = counts.where((F.col("bad") >= least_docs) & (F.col("bad") >= purity * (F.col("bad") + F.col("good")))).collect()  # bound: see above
    varied = _varied(train, marked, least_docs)
    marked = [r for r in marked if (r.stem, r.entry) in varied]
    # by beginning, the documents of the word that covers most
    best: dict[str, int] = {}
    for r in marked:
        if not r.stem:
            for n in range(4, min(len(r.entry), 7) + 1):
                best[r.entry[:n]] = max(best.get(r.entry[:n], 0), r.bad)
    stems: set[str] = set()
    for r in sorted(marked, key=lambda r: (len(r.entry), -r.bad, r.entry)):
        if r.stem and not any(r.entry[:n] in stems for n in range(4, len(r.entry))):
            # a beginning stands for several words, else the word itself says as much
            if r.bad > 1.5 * best.get(r.entry, 0):
                stems.add(r.entry)
    terms = {r.entry for r in marked if not r.stem and not any(r.entry[:n] in stems for n in range(4, len(r.entry) + 1))}
    return terms, stems


def train_model(docs: DataFrame, labels: DataFrame, sample: int = 20_000, window: int = 8) -> ToxicityModel:
    """docs: doc_id, text (bytes); labels: doc_id, label 0/1. `sample`: labelled rows that are used at most."""
    chosen = labels.where("doc_id is not null and label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    train = scratch_table(docs.join(F.broadcast(chosen), "doc_id"), "toxic-train")  # broadcast bound: `sample` rows of 12 bytes
    terms, stems = learn_lexicon(train)
    model = ToxicityModel(terms, stems, np.zeros(N_FEATURES), window)

    def run(batches):
        cache: dict[str, int | None] = {}
        for batch in batches:
            for text, label in rows_of(batch):
                yield pa.RecordBatch.from_pylist([{"x": model.features(text, cache).tolist(), "y": label}], schema=pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())]))

    rows = train.select("text", F.col("label").cast("int")).mapInArrow(run, "x array<double>, y int").collect()  # at most `sample` rows of 9 numbers
    y = np.array([r.y for r in rows], float)
    if len(set(y)) == 2:
        model.weights = fit(np.array([r.x for r in rows]), y)
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        model.weights[0] = math.log(share / (1 - share))
    return model


def score_texts(docs: DataFrame, model: ToxicityModel, threshold: float) -> DataFrame:
    """doc_id, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        cache: dict[str, int | None] = {}
        for batch in batches:
            for rows in by_size(rows_of(batch)):
                scores = model.score(np.array([model.features(t, cache) for _, t in rows]))
                out = Columns(schema)
                for (doc_id, _), s in zip(rows, scores.tolist(), strict=True):
                    out.add(doc_id, s, int(s >= threshold))
                yield out.take()
                if len(cache) > 400_000:
                    cache.clear()

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame, train_on, label_col: str = "toxic", threshold: float = 0.3, sample: int = 20_000, window: int = 8) -> DataFrame:
    """Learns from the labelled rows whose doc_id `train_on` (a condition on a column) admits; scores all documents."""
    docs = documents_of(documents)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    return score_texts(docs, train_model(docs, known.where(train_on(F.col("doc_id"))), sample, window), threshold)
