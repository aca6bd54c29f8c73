"""MinHash near-duplicates against brute force; stars against a plain union."""

import random
import re

import numpy as np
import pytest

from barloom.llm import minhash, stars
from barloom.llm.common import _STRETCH, words_of


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def expected(rows, width, times):
    """(doc_id, n, component, kept) a row, by comparing all pairs of sets; times: the similarity in percent."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and root[i] != root[j] and 100 * both >= times * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    ids = {}
    for (doc_id, _), r in zip(rows, root, strict=True):
        if doc_id is not None:
            ids[r] = min(ids.get(r, doc_id), doc_id)
    return sorted(((doc_id, len(s), ids.get(r), doc_id == ids.get(r)) for (doc_id, _), s, r in zip(rows, sets, root, strict=True)), key=repr)


def family(rng, base, copies, least, most):
    out = []
    for _ in range(copies):
        near = base[:]
        for at in rng.sample(range(len(base)), rng.randint(least, most)):
            near[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(near))
    return out


def corpus(rng):
    texts = [None, "", " \t\n", "one", "One", "one two", "a a a", "a a a a", "ONE two three", "é É é x", "w " * 4000]
    for n in (8, 30, 120, 400):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts += [" ".join(base)] * 3 + family(rng, base, 25, 1, max(1, n // 25))  # an original and edited copies
        far = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts += family(rng, far, 25, max(1, n // 60), max(1, n // 30))  # copies whose original isn't there
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("width,similarity,block", [(3, 0.85, 1000), (5, 0.8, 4)])
def test_brute_force(spark, monkeypatch, width, similarity, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = list(enumerate(corpus(random.Random(width))))
    rows += [(7, "one more text of id seven"), (None, rows[3][1]), (None, "nobody knows this text at all"), (None, "nobody knows this text at all"), rows[5]]
    df = spark.createDataFrame([(i, t, "k", b"s", 1) for i, t in rows], "doc_id long, text string, key string, sig binary, row int").repartition(5)
    got = minhash.near_duplicates(df, similarity, width).collect()
    want = expected(rows, width, round(100 * similarity))
    assert len(got) == len(want)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in got), key=repr) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({w[2] for w in want}) < len({t for _, t in rows})
    empty = minhash.near_duplicates(df.where("false"), similarity, width)
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_unsettled_buckets_are_compared_in_blocks(spark, monkeypatch):
    """With most of the stars' links taken away, the blocks find what is left."""
    made, real, star = [], minhash._block_links, minhash._star_links
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "_star_links", lambda *a: star(*a).where("a % 3 = 0"))
    monkeypatch.setattr(minhash, "_block_links", lambda *a: made.append(real(*a)) or made[-1])
    rng, texts = random.Random(9), []
    for n in (60, 150, 300):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts += family(rng, base, 30, 1, n // 60)
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 0.85, 3).collect()
    assert made[0].count() > 20
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == expected(rows, 3, 85)


def test_block_links_join_all_that_is_near():
    rng = np.random.default_rng(4)
    bands, per_band, bound = minhash.plan(0.85)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    found = [np.unique(np.where(rng.random(400) < p, rng.integers(0, 1 << 63, 400, np.uint64), base)) for p in rng.choice([0.02, 0.05, 0.12, 0.4], 60)]

    class Held:
        def get(self, file, at, size):
            assert size == 8 * len(found[at])
            return found[at]

    member = lambda side, i: (side, i, i, len(found[i]), minhash.minima(found[i], bands * per_band).astype(np.uint8).tobytes(), "f", i)
    near = lambda i, j: (lambda both: 100 * both >= 85 * (len(found[i]) + len(found[j]) - both))(len(set(found[i].tolist()) & set(found[j].tolist())))

    def classes(pairs):
        root = list(range(60))
        for i, j in pairs:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
        return root

    alone = minhash.block_links([member(0, i) for i in range(60)], Held(), bound, minhash.Fraction("0.85"))
    assert all(near(i, j) for i, j in alone) and classes(alone) == classes((i, j) for i in range(60) for j in range(i) if near(i, j))
    both = minhash.block_links([member(int(i >= 30), i) for i in range(60)], Held(), bound, minhash.Fraction("0.85"))
    assert all(i < 30 <= j for i, j in both) and classes(both) == classes((i, j) for i in range(30) for j in range(30, 60) if near(i, j))


def test_plan_misses_few():
    for s in (0.5, 0.7, 0.8, 0.85, 0.9):
        bands, rows, bound = minhash.plan(s)
        assert (1 - s**rows) ** bands < 1e-6 and 0 < bound < bands * rows * s


def test_minima_estimate_similarity():
    rng = np.random.default_rng(6)
    both, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (700, 150, 150))
    x, y = minhash.minima(np.concatenate([both, a]), 512), minhash.minima(np.concatenate([both, b]), 512)
    assert abs((x == y).mean() - 0.7) < 0.08


def test_alternating_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2400)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    nodes = {x for e in edges for x in e if x is not None}
    got = stars.alternating(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.u, r.v) for r in got) == sorted((x, find(x)) for x in nodes if find(x) != x)
    assert stars.alternating(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_longer_than_a_stretch():
    """A word is hashed whole, wherever stretches end."""
    long = bytes(97 + i % 23 for i in range(_STRETCH + 77))
    text = b"ab " + long + b" cd " + b"e" * 10 + b"\n" + long * 2 + b" " + long
    h, starts, ends = words_of(text)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == text.split()
    assert h[1] == h[5] and len(set(h.tolist())) == 5
    assert words_of(long[:1000])[0][0] == words_of(b" " * (_STRETCH - 500) + long[:1000] + b" x")[0][0]
