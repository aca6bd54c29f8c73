"""Token ids in binary shards, each document compressed with one shared zstandard dictionary.

A shard holds documents in ascending order of doc_id: frames are dealt by
ranges of (doc_id, checksum, row), so neither many null ids nor many equal
ones come to one task, and a range's file is closed at SHARD_BYTES. Layout of
``shard-NNNNN-NNN.ids``: the magic ``BLIDS1``, a byte for the width of an id (2 or
4), the SHA-256 of the dictionary, then one zstandard frame a document. Beside
it, ``shard-NNNNN-NNN.idx``: the same SHA-256, then for each document four
little-endian 64-bit integers: doc_id, offset of its frame, length of its
frame, number of ids. The dictionary is ``dictionary.zstd``. A short document
is read with one seek into the index and one into the shard.

The dictionary is trained on a sample of at most `sample` documents, chosen by
a hash of doc_id from all rows, of which each gives its first 16 KiB of ids;
that bound is a parameter. It changes sizes only, never contents.

Order: doc_id, then the text's checksum for repeated ids; a null doc_id comes
first and is kept as -2**63 in the index. Null text is empty and holds the end
id alone. An empty table gives no shards and no rows. A very long text is one
frame.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Columns, Store, documents_of, rows_of, scratch_path, scratch_table
from .encoding import by_size, encoder

MAGIC = b"BLIDS1"
NULL_ID = -(1 << 63)
#: Bytes of text that go to one shard, about.
SHARD_BYTES = 24 << 20


@dataclass(frozen=True)
class Coding:
    """How ids become bytes: their width and the shared dictionary."""

    width: int
    dictionary: bytes

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.dictionary).digest()

    def compressor(self):
        return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None)

    def decompressor(self):
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None)


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train(docs: DataFrame, tokenizer: str, end: bytes, width: int, sample: int, size: int) -> bytes:
    """The dictionary; empty if there is too little to train one."""
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bound: `sample` rows of 8 bytes
    few = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")
    first = few.select(F.expr("substring(text, 1, 65536)").alias("text"))

    def run(batches):
        for batch in batches:
            for rows in by_size(rows_of(batch)):
                ids = encoder(tokenizer).encode([t for (t,) in rows])
                yield pa.RecordBatch.from_arrays([pa.array([_narrow(x + end, width)[:16384] for x in ids], pa.binary())], ["ids"])

    got = [bytes(r[0]) for r in first.mapInArrow(run, "ids binary").limit(2 * sample).toLocalIterator()]  # at most 2 * sample * 16 KiB
    try:
        return zstandard.train_dictionary(size, sorted(got)).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_shards(df: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int = 49_408, sample: int = 512, dictionary_size: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, Coding, DataFrame]:
    """Writes the shards; gives their folder, the coding and the manifest: shard, name, docs, tokens, first (tokens in earlier shards)."""
    docs = documents_of(df, id_col, text_col)
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-shards")
    end, width = np.array([end_id], "<u4").tobytes(), 2 if max(vocabulary, end_id + 1) <= 65_536 else 4
    coding = Coding(width, train(docs, tokenizer, end, width, sample, dictionary_size))
    with Store(folder).write("dictionary.zstd") as f:
        f.write(coding.dictionary)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))

    def encode(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("n_ids", pa.int64()), ("frame", pa.binary())])
        pack = coding.compressor()
        for batch in batches:
            for rows in by_size(rows_of(batch)):
                out = Columns(schema)
                for (doc_id, text), ids in zip(rows, encoder(tokenizer).encode([t for _, t in rows]), strict=True):
                    out.add(doc_id, zlib.crc32(text), len(ids) // 4 + 1, pack.compress(_narrow(ids + end, width)))
                yield out.take()

    frames = scratch_table(docs.mapInArrow(encode, "doc_id long, crc long, n_ids long, frame binary"), "token-frames", "none")
    # the row's number parts rows that are equal in all else
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc").asc(), F.col("row").asc()]
    dealt = frames.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, *order)
    dealt = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "crc", "n_ids", "frame", "row").sortWithinPartitions(*order)

    def write(batches):
        schema = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
        source = ((shard, doc_id, n, frame) for batch in batches for shard, doc_id, _, n, frame, _ in rows_of(batch))
        waiting, parts = next(source, None), 0
        while waiting is not None:  # a range with long documents gives several shards
            shard, name, store = waiting[0], f"shard-{waiting[0]:05d}-{parts:03d}", Store(folder)
            index, at = [], len(MAGIC) + 33
            with store.write(name + ".ids") as f:
                f.write(MAGIC + bytes([coding.width]) + coding.digest)
                while waiting is not None and (not index or at < SHARD_BYTES):
                    _, doc_id, n, frame = waiting
                    f.write(frame)
                    index.append((NULL_ID if doc_id is None else doc_id, at, len(frame), n))
                    at += len(frame)
                    waiting = next(source, None)
            table = np.array(index, "<i8")
            with store.write(name + ".idx") as f:
                f.write(coding.digest + table.tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": shard << 32 | parts, "name": name, "docs": len(index), "tokens": int(table[:, 3].sum())}], schema=schema)
            parts += 1

    manifest = scratch_table(dealt.mapInArrow(write, "shard long, name string, docs long, tokens long"), "token-manifest")
    # one row a shard, so one task is enough for the running sum
    first = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return folder, coding, manifest.withColumn("first", first)


class ShardReader:
    """Single documents of a shard, by position, without reading the others."""

    def __init__(self, store: Store, name: str, coding: Coding):
        data = store.read(name + ".idx")
        if data[:32] != coding.digest:
            raise ValueError(f"{name} was written with another dictionary")
        self.index = np.frombuffer(data[32:], "<i8").reshape(-1, 4)
        self.file, self.coding, self.unpack = store.open(name + ".ids"), coding, coding.decompressor()

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, i: int) -> int | None:
        x = int(self.index[i, 0])
        return None if x == NULL_ID else x

    def ids(self, i: int) -> np.ndarray:
        _, at, size, n = (int(x) for x in self.index[i])
        self.file.seek(at)
        raw = self.unpack.decompress(self.file.read(size))
        found = np.frombuffer(raw, "<u2" if self.coding.width == 2 else "<u4").astype("<u4")
        if len(found) != n:
            raise ValueError("index and frame differ")
        return found


def read_shards(folder: str, coding: Coding, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for name, first in rows_of(batch):
                reader, out = ShardReader(Store(folder), name, coding), Columns(schema)
                for i in range(len(reader)):
                    ids = reader.ids(i)
                    out.add(reader.doc_id(i), first, len(ids), zlib.crc32(ids.tobytes()))
                    first += len(ids)
                    if len(out) >= 5000:
                        yield out.take()
                yield out.take()

    shards = manifest.count()  # rows: one a shard
    names = manifest.select("name", "first").repartition(max(1, shards))
    return names.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the shards of df and reads them back."""
    return read_shards(*write_shards(df, tokenizer, **options))
