"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, lexical, lm_scoring, minhash, packing, quality, simhash, suffix_dedup, token_counts, token_output, toxicity, warc, whitening
from .common import bounded_batches

#: Files of the public tokenizers.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), identity=0.8, overlap=13)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, width=3, seed=42)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_tables(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), budget=512)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), held_out=(7, 2))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=1000)


OP5_SQL = """
WITH own AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS payload_digest FROM own),
keepers AS (SELECT payload_digest, max(page_id) AS keeper FROM digests WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM digests d LEFT JOIN keepers k ON d.payload_digest = k.payload_digest AND payload_bytes >= 1000
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), least=400, words=50)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0, capacity=1024)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: fold(doc_id, 4) != 2, threshold=0.3)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), similarity=0.85, width=3)


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM words WHERE len(w) >= 3
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 2
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT b, r FROM reach JOIN links ON a = reach.doc_id)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN reach ON d.doc_id = reach.doc_id GROUP BY d.doc_id
"""

def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    fit = whitening.fit(vectors, components=32, scale=64, shift=1_000_000)
    if fit is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*(F.lit(float(e / fit.trace)) for e in fit.values)) if len(fit.values) else F.array(F.lit(0.0))
    rows = fit.transform(vectors).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(fit.identity_error(vectors)).alias("identity_error"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


TERMS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13_SQL = f"""
WITH terms AS (SELECT doc_id, unnest({TERMS}) AS t FROM documents),
wanted AS (SELECT DISTINCT item_id, unnest({TERMS}) AS t FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
counts AS (SELECT doc_id, t, count(*) AS tf FROM terms SEMI JOIN (SELECT DISTINCT t FROM wanted) USING (t) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, corpus GROUP BY t),
scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
    FROM wanted JOIN weights USING (t) JOIN counts USING (t) JOIN lengths USING (doc_id), corpus GROUP BY ALL
),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_simhash, op3_token_counts, op4_lm_scoring, op5_warc, op6_token_output, op7_quality_rules, op8_suffix_dedup, op9_packing, op10_toxicity, op11_minhash, op12_whitening, op13_lexical)}
ORACLES: dict[str, str] = {"op5_warc": OP5_SQL, "op11_minhash": OP11_SQL, "op13_lexical": OP13_SQL}
