"""Corpus-wide sums for hashed keys, asked and answered by block.

A block is a bounded run of documents, written once as a row of a table in the
shared folder. It asks for the totals of its distinct keys, each with what the
block itself adds; keys are dealt over buckets by their upper bits. A bucket's
task sums over the blocks and answers each; the answers are regrouped and
stored as one file a block. So a key costs at most one entry a block, however
frequent it is: there are no hot keys. A task holds one bucket or one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, rows_of, scratch_path, scratch_table

#: Entries that a bucket's task holds, about.
BUCKET_ENTRIES = 1_500_000
_PLAIN = 0x80


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers, by byte planes: high planes are mostly zero and compress away."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    used = 8
    while used > 1 and not raw[:, used - 1].any():
        used -= 1
    planes = raw[:, :used].T.tobytes()
    # few bytes stay as they are: a frame's head would cost more than it saves
    return bytes([used | _PLAIN]) + planes if len(planes) < 64 else bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes) -> np.ndarray:
    used, plain = blob[0] & ~_PLAIN, blob[0] & _PLAIN
    planes = np.frombuffer(blob[1:] if plain else zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def new_block_id() -> int:
    """Blocks are written once, so their names need not be reproducible."""
    return uuid.uuid4().int >> 66


def bucket_edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


class Answers:
    """The stored answers of an exchange."""

    def __init__(self, folder: str, columns: int):
        self.folder, self.columns, self.store = folder, columns, None

    def __getstate__(self):
        return {"folder": self.folder, "columns": self.columns, "store": None}

    def of(self, block: int, n: int) -> tuple[np.ndarray, ...]:
        """For the block's n keys in ascending order: the totals of each column, and whether the block is the first to ask."""
        if not n:
            return tuple(np.zeros(0, np.int64) for _ in range(self.columns + 1))
        self.store = self.store or Store(self.folder)
        data, at, parts = self.store.read(str(block)), 0, []
        while at < len(data):
            size = int.from_bytes(data[at : at + 4], "little")
            parts.append(unpack(data[at + 4 : at + 4 + size]).astype(np.int64).reshape(self.columns + 1, -1))
            at += 4 + size
        found = np.concatenate(parts, 1)
        if found.shape[1] != n:
            raise ValueError(f"block {block} asked for {n} keys and got {found.shape[1]} answers")
        return tuple(found)


def exchange(blocks: DataFrame, ask: Callable[[tuple], tuple[int, np.ndarray, list[np.ndarray]]], columns: int, entries: int, name: str, tally: Callable[[np.ndarray, list[np.ndarray]], list[int]] | None = None) -> tuple[Answers, list[int]]:
    """ask(row) gives a block's id, its sorted distinct keys and, by column, what the block adds for each; it may
    give a second hash of what each key stands for: then pairs of key and hash are distinct, sorted and counted.

    `entries`: about how many keys all blocks ask for; sets the number of buckets.
    `tally`: integers to be added up over buckets, from the distinct keys and their totals.
    """
    spark = blocks.sparkSession
    buckets = max(1, -(-entries // BUCKET_ENTRIES))
    ask_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("own", pa.list_(pa.binary())), ("check", pa.binary())])

    def asked(batches):
        edges = bucket_edges(buckets)
        for batch in batches:
            for row in rows_of(batch):
                block, keys, own, *check = ask(row)
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows = [(i, block, pack_sorted(keys[a:b]), [pack(x[a:b]) for x in own], pack(check[0][a:b]) if check else None) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, ask_schema, strict=True)], schema=ask_schema)

    answer_schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary()), ("tally", pa.list_(pa.int64()))])

    def answered(batches):
        rows = sorted((row for b in batches for row in rows_of(b)), key=lambda r: (r[0], r[1]))
        while rows:  # the rows of a bucket; a partition has one bucket
            mine = [r for r in rows if r[0] == rows[0][0]]
            rows = rows[len(mine) :]
            keys = [unpack_sorted(r[2]) for r in mine]
            ends = np.cumsum([len(k) for k in keys])
            distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            n = len(distinct)
            if mine[0][4] is not None:  # equal keys with another check are counted apart
                check = np.concatenate([unpack(r[4]) for r in mine])
                odd = np.flatnonzero(check != check[first][at])
                if len(odd):
                    _, more, which = np.unique(np.stack([at[odd].astype(np.uint64), check[odd]]), axis=1, return_index=True, return_inverse=True)
                    at[odd], first, n = n + which.ravel(), np.concatenate([first, odd[more]]), n + len(more)
            totals = [np.bincount(at, np.concatenate([unpack(r[3][c]) for r in mine]).astype(np.float64), n).astype(np.int64) for c in range(columns)]
            is_first = np.zeros(len(at), np.int64)
            is_first[first] = 1
            if tally:
                yield pa.RecordBatch.from_pylist([{"block": -1, "bucket": mine[0][0], "answer": b"", "tally": tally(distinct, totals)}], schema=answer_schema)
            del keys, distinct
            for r, a, b in zip(mine, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                found = np.concatenate([*(t[at[a:b]] for t in totals), is_first[a:b]])
                yield pa.RecordBatch.from_pylist([{"block": r[1], "bucket": r[0], "answer": pack(found), "tally": []}], schema=answer_schema)

    asks = blocks.mapInArrow(asked, "bucket int, block long, keys binary, own array<binary>, check binary")
    answers = scratch_table(asks.repartitionById(buckets, F.col("bucket")).mapInArrow(answered, "block long, bucket int, answer binary, tally array<long>"), f"{name}-answers", "none")
    folder = scratch_path(spark, f"{name}-by-block")
    stored = pa.schema([("block", pa.int64())])

    def by_block(batches) -> Iterator[pa.RecordBatch]:
        store, at, parts = Store(folder), None, []

        def close():
            with store.write(str(at)) as f:
                for p in parts:
                    f.write(len(p).to_bytes(4, "little") + p)
            return pa.RecordBatch.from_pylist([{"block": at}], schema=stored)

        for batch in batches:
            for block, _, answer in rows_of(batch):
                if block != at:
                    if at is not None:
                        yield close()
                    at, parts = block, []
                parts.append(answer)
        if at is not None:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = answers.where("block >= 0").select("block", "bucket", "answer").repartition(n, "block").sortWithinPartitions("block", "bucket")
    dealt.mapInArrow(by_block, "block long").agg(F.count("*")).collect()
    sums = [r.tally for r in answers.where("block < 0").select("tally").toLocalIterator()] if tally else []  # a row a bucket
    return Answers(folder, columns), [sum(x) for x in zip(*sums, strict=True)]
