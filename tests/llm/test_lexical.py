"""Lexical search against a plain ranking; treaps by their own rules."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, queries, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, words = len(counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item, text in queries:
        scored = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // words
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    df = sum(1 for _, x in counts if x[t])
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((score, i))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank + 1, i, s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "ünï", "naïve", "日本", "42"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    made = [(i, rng.choice([" ", ", ", "_", "\n"]).join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(n)]
    return made + [(900, None), (901, ""), (902, "-- !"), (903, "W1 " * 50_000 + "w2"), (904, "x" * 200_000 + " w3"), (None, "w40 w41"), (5, "w40 w41"), (5, "w40 w41")]


@pytest.mark.parametrize("shard,slice_items,walk", [(16_384, 4096, 1 << 18), (40, 3, 64)])
def test_brute_force(spark, monkeypatch, shard, slice_items, walk):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "SLICE_ITEMS", slice_items)
    monkeypatch.setattr(lexical, "WALK", walk)
    rng = random.Random(3)
    docs = corpus(rng, 150)
    queries = [(i, " ".join(rng.choices([f"W{i}" for i in range(60)] + ["日本", "ÜNÏ", "none"], k=rng.randrange(1, 30)))) for i in range(10)] + [(20, None), (21, "??"), (22, "unknown"), (3, "w40 w41"), (None, "w7")]
    df = spark.createDataFrame([(t, i, "k", 1) for i, t in docs], "text string, doc_id long, terms string, n int").repartition(4)
    asked = spark.createDataFrame([(t, i, 1) for i, t in queries], "text string, item_id long, doc_id int")
    got = lexical.search(df, asked, k=7)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, queries, 7)
    assert lexical.search(df.where("false"), asked).count() == 0 and lexical.search(df, asked.where("false")).count() == 0
    assert lexical.search(df.where("doc_id = 901"), asked).count() == 0


def test_treaps_are_ordered_twice():
    rng = np.random.default_rng(1)
    priority = rng.integers(0, 50, 200)
    starts = [0, 0, 120, 121, 200]
    left, right, roots = lexical.treaps(starts, priority.tolist())

    def walk(i):
        if i < 0:
            return []
        assert all(c < 0 or priority[c] <= priority[i] for c in (left[i], right[i]))
        return [*walk(left[i]), i, *walk(right[i])]

    assert [walk(r) for r in roots[:-1].tolist()] == [list(range(a, b)) for a, b in zip(starts, starts[1:], strict=False)]


def shard_of(rng, docs, terms, share):
    held = np.flatnonzero(rng.random(docs * terms) < share)
    return held // docs, held % docs


@pytest.mark.parametrize("kind", ["random", "same", "rising"])
def test_walks_prune_and_find_all(kind):
    rng = np.random.default_rng(2)
    docs, number = 3000, 12
    term, doc = shard_of(rng, docs, number, 0.3)
    impact = {"random": rng.integers(1, 10**9, len(doc)) ** 2 // 10**9 + 1, "same": np.full(len(doc), 700), "rising": doc * 1000 + 1}[kind]
    shard = lexical.Shard(term, doc, impact, docs, number)
    seen, real = [], lexical.Shard._topmost
    shard._topmost = lambda nodes, low, high: seen.append(len(nodes)) or real(shard, nodes, low, high)
    queries = [np.array([0, 3, 4]), np.array([1]), np.arange(number), np.array([], np.int64)]
    q, d, s = shard.top(queries, 10, np.zeros(4, np.int64))
    for i, own in enumerate(queries):
        total = np.zeros(docs, np.int64)
        for t in own:
            np.add.at(total, doc[term == t], impact[term == t])
        order = [x for x in np.lexsort((np.arange(docs), -total)) if total[x] > 0][:10]
        assert d[q == i].tolist() == order and s[q == i].tolist() == total[order].tolist()
    assert sum(seen) < 3 * 2 * docs  # each document is a pivot of each query at most once
    if kind == "rising":
        assert sum(seen) < docs  # most intervals are dropped, and treaps aren't chains
        assert len(seen) < 400
    floor = shard.top([np.array([1])], 10, np.array([s[q == 1][4]]))
    assert floor[2].tolist() == s[q == 1][: len(floor[2])].tolist() and len(floor[2]) >= 5
