"""Near-duplicates of the pipeline against brute force."""

import random

import corpus_pipeline
from barloom.llm import resemblance


def words_of(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(n, near):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and near(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_of_similarity_08_go(spark, sf):
    rng, texts = random.Random(5), [None, "", "word", "Word", "two words", "one two three four five"]
    for n in (40, 60, 150, 400):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            for changes in (0, 0, 1, 2, n // 60 + 1, n // 40 + 1, n // 20 + 1):
                near = base[:]
                for at in rng.sample(range(n), changes):
                    near[at] = "changed%d" % rng.randrange(10**6)
                texts.append(" ".join(near))
    rng.shuffle(texts)
    sets = [words_of(t) for t in texts]
    root = groups(len(texts), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    assert 20 < len(set(root)) < len(set(map(str, texts)))
    docs = spark.createDataFrame([(t, i, "k", "s", i) for i, t in enumerate(texts)], "text string, doc_id long, bands string, key string, row int").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(docs), sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and kept.columns == docs.columns
    nameless = docs.selectExpr("text", "cast(null as long) doc_id", "key")
    assert resemblance.one_of_each(nameless.unionByName(nameless)).count() == len(set(root))
    assert resemblance.one_of_each(docs.where("false")).count() == 0
