"""SimHash near-duplicates whose links are held to a Jaccard similarity of shingles.

A document's shingles are the distinct runs of `width` words, lower-cased. Two
documents are near-duplicates if their shingle sets have a Jaccard similarity
of at least `similarity`; groups are what such links connect.

Candidates are, first, documents whose fingerprints of these shingles are
within `radius` bits, by the BK-trees of simhash.py: what they connect is a
bucket. At a similarity of 0.8 fingerprints of 64 bits lie some ten bits apart,
though, where no block of bits is both shared and selective and a BK-tree
prunes nothing. So MinHash widens the candidates by its own buckets: a pair at
the similarity itself misses all of them with a probability under 1e-6.

Documents with equal sets are merged first. Buckets are verified as minhash.py
does: against a representative, then, where that doesn't settle them, in
blocks, with the full sets read from the shared folder. No bucket, however
large, goes to one task.

Defined cases: every row is a document of its own. Null text is empty; all
texts without words are the same. With fewer words than a shingle the whole
sequence is one shingle. Texts of any length are taken whole. Of a group the
row with the smallest doc_id stays, of equal ids the first row; a null doc_id
is kept only where all members lack one. An empty table gives an empty table,
and columns of any names are handed on.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minhash
from .common import bounded_batches, keep_in_place, scratch_table, slices_of
from .components import components
from .simhash import links, majority


def one_of_each(df: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, one of each group of near-duplicates: the smallest doc_id's; of repeated rows one."""
    bounded_batches(df.sparkSession)
    id_at, text_at, names = df.columns.index(id_col), df.columns.index(text_col), df.columns
    plain, least = [f"c{i}" for i in range(len(names))], Fraction(str(similarity))
    bands, per_band, bound = minhash.plan(similarity)
    enough = minhash.smallest(least)
    inner = df.toDF(*plain).withColumn("row", F.monotonically_increasing_id())
    made = {"n": T.LongType(), "key": T.BinaryType(), "fp": T.LongType(), "bands": T.ArrayType(T.LongType()), "sig": T.BinaryType()}
    fields = T.StructType([*inner.schema.fields, *(T.StructField(n, t) for n, t in made.items())])

    def sign(batches):
        for batch in (part for b in batches for part in slices_of(b)):
            sizes, keys, fps, lists, signatures = [], [], [], [], []
            for t in batch.column(text_at).to_pylist():
                found = minhash.shingle_set(t.encode("utf-8") if t else b"", width)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                fp = majority(found) if len(found) else 0
                fps.append(fp - (fp >> 63 << 64))
                minimum = minhash.minima(found, bands * per_band) if len(found) >= enough else None
                lists.append(None if minimum is None else minhash.band_keys(minimum, bands))
                signatures.append(None if minimum is None else minimum.astype(np.uint8).tobytes())
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip((sizes, keys, fps, lists, signatures), kinds, strict=True))], names=[*batch.schema.names, *made])

    rows = scratch_table(inner.mapInArrow(sign, fields), "resemblance-rows")
    own = rows.select(F.col(f"c{id_at}").cast("long").alias("doc_id"), "key", "row")
    distinct = scratch_table(rows.groupBy("key").agg(F.min("row").alias("node"), F.min("n").alias("n"), F.min("fp").alias("fp")), "resemblance-distinct")
    # what BK-trees connect within the radius is a bucket, named by one of its fingerprints
    some = distinct.where(F.col("n") >= (enough if enough < float("inf") else 1 << 62))
    trees = components(links(some.select("fp", F.col("fp").alias("node")).distinct(), radius))
    near = some.join(trees.select(F.col("node").alias("fp"), "root"), "fp", "left").select(F.xxhash64(F.coalesce("root", "fp"), F.lit("fingerprint")).alias("band"), "node")
    signed = keep_in_place(rows.select("row", "bands"), distinct.select(F.col("node").alias("row")), "row", "resemblance-distinct-rows")
    banded = signed.select(F.explode("bands").alias("band"), F.col("row").alias("node")).unionByName(near)
    texts = rows.select("row", "n", "sig", F.coalesce(F.col(f"c{text_at}").cast("string"), F.lit("")).cast("binary").alias("text"))
    found = minhash.connected(texts, banded, width, bound, least)
    classes = distinct.join(found.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("key", F.coalesce("root", "node").alias("of"))
    # the smallest row of each group, by (doc_id, row); ids that are null come last
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = own.join(classes, "key").groupBy("of").agg(F.min(order).alias("best")).select(F.col("best.row").alias("row"))
    return keep_in_place(rows, kept, "row", "resemblance-kept").select(*plain).toDF(*names)
