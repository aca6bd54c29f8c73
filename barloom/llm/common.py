"""Shared plumbing of the text operators.

* `shared_dir` and `scratch_table`: intermediate tables live in the folder
  that ``spark.checkpoint.dir`` names, which driver and executors share, so
  a lost executor never takes the only copy with it.
* `Store`: binary files in that folder, by pyarrow's file systems.
* `documents_of`: the two columns the text operators read, nulls defined.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contract: the bytes that separate words, [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"


_draw = np.random.default_rng(8)
_LETTERS = _draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are hashed at once.
_STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_STRETCH - 1, base, np.uint64)]))


@lru_cache(maxsize=1)
def _scales() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    return _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE)] = True


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word: a polynomial over its bytes, as differences of one running sum."""
    if len(text) > _STRETCH:
        return _words_of_long(text)
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_WHITE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _scales()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32)), starts, ends


def _words_of_long(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, a stretch at a time, cut at white space; a word longer than a stretch is hashed in parts, with the same result as at once."""
    parts, at = [], 0
    while at < len(text):
        end = min(at + _STRETCH, len(text))
        if end < len(text):
            end = max((text.rfind(bytes([w]), at, end) + 1 for w in WHITE), default=0) or end
            if text[end - 1] not in WHITE and text[end] not in WHITE:  # a word from here on and beyond this stretch
                end = min((x for x in (text.find(bytes([w]), end) for w in WHITE) if x >= 0), default=len(text))
                parts.append((np.array([_hash_of_long(text[at:end])], np.uint64), np.array([at]), np.array([end])))
                at = end
                continue
        h, starts, ends = words_of(text[at:end])
        parts.append((h, starts + at, ends + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hash_of_long(word: bytes) -> int:
    """What words_of gives for a word of any length."""
    total, mask = 0, (1 << 64) - 1
    up = _scales()[0]
    for at in range(0, len(word), _STRETCH):
        part = np.frombuffer(word[at : at + _STRETCH], np.uint8)
        total = (total + int((_LETTERS[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)) & mask
    total = ((total ^ (total >> 31)) * 0xD6E8FEB86659FD93) & mask
    return total ^ (total >> 32)


#: Rows of text that go to Python at once, at most. Whole texts are wide: the default of 10 000 rows takes hundreds of MB of buffers a task.
ROWS_PER_BATCH = 500


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Lowers the session's Arrow batches to ROWS_PER_BATCH rows; lower settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset, a fresh local one (single-machine sessions only)."""
    base = bounded_batches(spark).conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") if "://" in base else "file://" + os.path.abspath(base)


_TRACKED: list[list[str]] = []


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The scratch paths that are made meanwhile, for whoever drops them when nothing reads them any more."""
    paths: list[str] = []
    _TRACKED.append(paths)
    try:
        yield paths
    finally:
        _TRACKED[:] = [t for t in _TRACKED if t is not paths]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _TRACKED:
        paths.append(path)
    return path


def scratch_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df once to the shared folder and returns a reader of it, which cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long and text as UTF-8 bytes (null: empty); other columns are not read."""
    bounded_batches(df.sparkSession)
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def slices_of(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batch in parts, so that only a few rows at a time become Python objects."""
    return (batch.slice(start, rows) for start in range(0, batch.num_rows, rows))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    for part in slices_of(batch):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


class Told:
    """Values for some rows of a written table, in a file for each writing partition: rows are looked up where they are read and never shuffled.

    told: row (from monotonically_increasing_id when the table was written), value (long).
    """

    def __init__(self, told: DataFrame, name: str):
        spark, self.folder = told.sparkSession, scratch_path(told.sparkSession, name)
        folder, schema = self.folder, pa.schema([("n", pa.int64())])

        def store(batches):
            out, number, held = Store(folder), None, []

            def close():
                with out.write(str(number)) as f:
                    f.write(np.array(held, "<i8").tobytes())
                return pa.RecordBatch.from_pylist([{"n": len(held)}], schema=schema)

            for batch in batches:
                for row, part, value in rows_of(batch):
                    if part != number:
                        if number is not None:
                            yield close()
                        number, held = part, []
                    held.append((row, value))
            if number is not None:
                yield close()

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = told.select(F.col("row").cast("long").alias("row"), F.shiftright("row", 33).alias("part"), F.col("value").cast("long").alias("value"))
        rows.repartition(n, "part").sortWithinPartitions("part", "row").mapInArrow(store, "n long").agg(F.sum("n")).collect()

    def reader(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For a task: of rows, which are told, and their values (0 for the others)."""
        out, parts = Store(self.folder), {}

        def look(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, value = np.zeros(len(row), bool), np.zeros(len(row), np.int64)
            for part in np.unique(row >> 33).tolist():
                if part not in parts:
                    parts[part] = np.frombuffer(out.read(str(part)), "<i8").reshape(-1, 2) if out.has(str(part)) else np.zeros((0, 2), np.int64)
                own, table = np.flatnonzero(row >> 33 == part), parts[part]
                if len(table):
                    at = np.minimum(np.searchsorted(table[:, 0], row[own]), len(table) - 1)
                    hit = table[at, 0] == row[own]
                    found[own], value[own] = hit, np.where(hit, table[at, 1], 0)
            return found, value

        return look


def keep_in_place(rows: DataFrame, kept: DataFrame, row_col: str, name: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """The rows of a written table whose row_col (see Told) is among kept's; `then`, if given, makes of each batch one of the schema in the same pass."""
    at, told = rows.columns.index(row_col), Told(kept.select(F.col(row_col).alias("row"), F.lit(1).alias("value")), name)

    def keep(batches):
        look = told.reader()
        for batch in batches:
            for part in slices_of(batch.filter(pa.array(look(batch.column(at).to_numpy())[0]))):
                yield then(part) if then else part

    return rows.mapInArrow(keep, schema or rows.schema)


class Columns:
    """Gathers rows by column and hands them out as record batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.data = schema, [[] for _ in schema]

    def add(self, *row) -> None:
        for column, x in zip(self.data, row, strict=True):
            column.append(x)

    def __len__(self) -> int:
        return len(self.data[0])

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(x, f.type) for x, f in zip(self.data, self.schema, strict=True)]
        self.data = [[] for _ in self.schema]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


class Store:
    """Files below one URI. Files appear whole or not at all: written beside, then renamed."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.root = pafs.FileSystem.from_uri(uri)

    def write(self, name: str):
        return _Pending(self, name)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()

    def has(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.File

    def drop(self, name: str = "") -> None:
        path = f"{self.root}/{name}" if name else self.root
        kind = self.fs.get_file_info(path).type
        if kind == pafs.FileType.Directory:
            self.fs.delete_dir(path)
        elif kind == pafs.FileType.File:
            self.fs.delete_file(path)


class _Pending:
    def __init__(self, store: Store, name: str):
        self.store, self.path = store, f"{store.root}/{name}"
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.store.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.store.fs.open_output_stream(self.temp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.store.fs.move(self.temp, self.path)
        else:
            self.store.fs.delete_file(self.temp)
