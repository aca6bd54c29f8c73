"""The pipeline's stages take effect, each on what the one before kept."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns_and_order(spark, sf, stages):
    names = list(stages)
    assert names == ["quality rules", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(stages[n].columns == columns for n in names[:-1])


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_stage(spark, sf, stages):
    """Kept are those the verdicts keep, whose band tests/llm/test_brute_force.py holds against a plain version; rows are unchanged."""
    from barloom.llm import quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.verdicts(docs, ["doc_id"]).where("kept").collect()}
    before, after = rows_of(docs), rows_of(stages["quality rules"])
    assert set(after) == kept and all(before[i] == r for i, r in after.items()) and 0 < len(kept) < len(before)


def test_near_duplicate_stage_is_brute_force(stages):
    """One document, the smallest id, of each group that a Jaccard similarity of 0.8 of five-word shingles connects."""
    before, after = rows_of(stages["quality rules"]), rows_of(stages["simhash near-dedup"])
    ids = sorted(before)

    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: shingles(before[i].text) for i in ids}, {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    assert set(after) == set(root.values()) and all(before[i] == r for i, r in after.items())


def test_suffix_stage_is_brute_force(stages):
    """Words that a string of 50 words covers which starts elsewhere, too, are gone, and no others."""
    before, after = rows_of(stages["simhash near-dedup"]), rows_of(stages["suffix-array dedup"])
    times, cut = Counter(), {i: list(WORD.finditer(r.text or "")) for i, r in before.items()}
    for found in cut.values():
        w = [m.group() for m in found]
        times.update(tuple(w[k : k + 50]) for k in range(len(w) - 49))
    changed = 0
    for i, r in before.items():
        w, gone = [m.group() for m in cut[i]], set()
        for k in range(len(w) - 49):
            if times[tuple(w[k : k + 50])] > 1:
                gone.update(range(k, k + 50))
        text, at = "", 0
        for k in sorted(gone):
            if k - 1 not in gone:
                text += r.text[at : cut[i][k].start()]
            at = cut[i][k].end()
        text += (r.text or "")[at:]
        assert (after[i].text if i in after else "") == text, i
        changed += bool(gone)
        if i in after:
            assert after[i].n_chars == (len(text) if gone else r.n_chars) and (after[i].lang, after[i].source) == (r.lang, r.source)
    assert changed


def test_decontamination_and_packing_stages(spark, sf, stages):
    """Documents with a found item go, as tests/llm/test_partial_quotes.py holds against brute force; the ids of all others are packed once."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from barloom.llm import decontamination

    before, after = rows_of(stages["suffix-array dedup"]), rows_of(stages["benchmark decontamination"])
    found = {r.doc_id for r in decontamination.contaminated(stages["suffix-array dedup"], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(after) == set(before) - found
    tok, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(int)
    for r in stages["packing"].collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in after.items()}


def test_clashing_columns_are_handed_on(spark, sf):
    """Columns named as the stages' own are told apart and returned."""
    own = ["_kept", "kept", "n_words", "band", "bands", "key", "row", "fp", "mark0", "c0", "data", "block", "_n_bytes", "start"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for c in own:
        docs = docs.withColumn(c, docs.doc_id.cast("string"))
    docs = docs.cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(r._kept == str(r.doc_id) == r.start == r.c0 for r in out.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).agg({"length": "sum"}).first()[0] > 0


def test_nulls_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    nulls = docs.limit(5).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "cast(null as string) lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
        stage(spark, nulls, sf).count()


def test_run_is_the_stages(spark, sf, stages):
    whole = corpus_pipeline.run(spark, sf)
    assert whole.selectExpr("sum(length)").first()[0] == stages["packing"].selectExpr("sum(length)").first()[0]
