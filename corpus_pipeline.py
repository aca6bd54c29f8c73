"""A training-data pipeline over `documents`: each stage reads what the stage before kept.

quality rules -> near-duplicates -> suffix-array dedup -> benchmark
decontamination -> packing. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontamination, packing, quality, resemblance, suffix_dedup
from barloom.llm.common import scratch_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    found = quality.verdicts(docs, docs.columns)
    inner = [f"c{i}" for i in range(len(found.columns))]  # documents may have columns of the same names
    return found.toDF(*inner).where(inner[-1]).select(*inner[: len(docs.columns)]).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, whose five-word shingles have a Jaccard similarity of 0.8 or more: the one with the smallest doc_id."""
    return resemblance.one_of_each(docs, similarity=0.8, width=5, radius=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 words that occur elsewhere too; a document of which nothing is left goes.

    n_chars is the length of what is left.
    """
    return suffix_dedup.deduplicated(docs, least=50, core=12, period=8, unit=suffix_dedup.WORDS, length_col="n_chars").where("length(text) > 0")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), identity=0.8, overlap=13)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row a piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Perplexity, fingerprints and tokenizers have no form in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch_table(docs, "pipeline")
    return docs
