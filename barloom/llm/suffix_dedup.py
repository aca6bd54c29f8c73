"""Removal of repeated strings by prefix-free parsing.

A byte is removed if a string of `least` units that covers it starts anywhere
else in the corpus too. Units are bytes or words; strings don't cross
documents. A word, `[^\\x20\\x09-\\x0D]+`, stands as a 64-bit hash in what
follows, and a removed run of words is removed with the white space inside.

Parsing: a window of units whose rolling hash is 0 modulo `period` is a
trigger and ends a phrase; triggers depend on the units alone, so equal
strings are parsed alike inside. A string of `least` units belongs to the
first trigger in it: it is a suffix of the phrase that the trigger ends, and
the context that follows. Equal strings have equal suffixes and contexts.

1. For each trigger, the hash K of the first `core` units of its context and
   the hash E of its phrase with the whole context are counted over the corpus
   (see blocks.py). K once: none of its strings repeats, which settles most of
   a corpus. E twice or more: all of its strings repeat. An E has 63 bits
   and is counted apart where 32 more bits of the hash differ.
2. What is left are triggers of repeated contexts with different surroundings.
   One row for each distinct E goes to the task of its K. There the phrases
   and contexts make the dictionary and the parse: phrase suffixes are sorted
   (from the trigger back), contexts are ranked, and both get the lengths of
   the common parts of neighbours. Strings with a suffix of n units are equal
   if no neighbour between them, in the order of suffixes, has less than n
   units in common, nor, in the order of contexts, less than `least` - n: this
   is corpus order, by suffix and then by rank. The comparison is exact.
   A K with more than `hot` occurrences would gather too much in one task; its
   strings are counted over blocks instead, by hashes of 96 bits.
3. Strings without a trigger in their first `least` - `core` units (runs of
   few different units) are counted by their own hashes as in step 1.

Each block of documents then marks its bytes from the answers.

Defined cases: null text is empty; nothing is removed from texts shorter than
`least`. Repeated rows repeat each other's strings, whether their ids are
equal, null or neither. A very long text is a block of its own. An empty table
gives an empty table. Columns of any name are handed on. Texts are bytes of
UTF-8; `deduplicated` gives text and leaves out what is left of cut characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Answers, exchange, new_block_id, pack, pack_sorted, unpack, unpack_sorted
from .common import Columns, Store, rows_of, scratch_path, scratch_table, slices_of, tracked, words_of

BLOCK_BYTES = 4 << 20
_ONE = np.uint64(1)


class Unit:
    """How texts are cut: the numpy kind of a unit and the units in a trigger's window, a power of two."""

    def __init__(self, kind: str, window: int):
        self.kind, self.window, self.size = np.dtype(kind), window, np.dtype(kind).itemsize

    def units(self, text: bytes) -> bytes:
        return text if self.size == 1 else words_of(text)[0].astype(self.kind).tobytes()

    def gone(self, text: bytes, mask: np.ndarray) -> np.ndarray:
        """Which bytes of the text go, given which of its units go."""
        if self.size == 1:
            return mask
        _, starts, ends = words_of(text)
        turns = np.flatnonzero(np.diff(mask, prepend=False, append=False))
        edges = np.zeros(len(text) + 1, np.int32)
        edges[starts[turns[::2]]] += 1
        edges[ends[turns[1::2] - 1]] -= 1
        return np.cumsum(edges[:-1]) > 0


BYTES, WORDS = Unit("<u1", 8), Unit("<u8", 4)


def trigger_starts(data: np.ndarray, period: int, window: int = 8) -> np.ndarray:
    """Positions of the windows of units whose rolling hash is 0 modulo the period."""
    if len(data) < window:
        return np.zeros(0, np.int64)
    h, factor, size = data.astype(np.uint64) + _ONE, 0x9E3779B97F4A7C15, 1
    while size < window:  # doubles the window
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor % (1 << 64), 2 * size
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero((h >> np.uint64(33)) % np.uint64(period) == 0)


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of 128-bit digests, 63 bits as an even key and 32 more bits."""
    both = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return both[:, 0] & ~_ONE, both[:, 1] >> np.uint64(32)


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of a key and a check: the places of the distinct ones, ascending; for each pair, its place among them; their counts."""
    order = np.lexsort((checks, keys))
    new = (np.diff(keys[order], prepend=~keys[order[:1]]) != 0) | (np.diff(checks[order], prepend=checks[order[:1]]) != 0)
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at, np.diff(np.flatnonzero(new), append=len(keys))


class Parsed:
    """The strings of a text by trigger: string starts low..high (last included) belong to the trigger at `at`."""

    def __init__(self, units: bytes, least: int, core: int, period: int, unit: Unit):
        size = unit.size
        n, reach = len(units) // size, least - core
        last = n - least  # of the string starts
        t = trigger_starts(np.frombuffer(units, unit.kind), period, unit.window) if last >= 0 else np.zeros(0, np.int64)
        before = np.concatenate([[-1], t[:-1]]) if len(t) else t
        low, high = np.maximum(np.maximum(before + 1, t - reach), 0), np.minimum(t, last)
        use = low <= high
        self.at, self.low, self.high = t[use], low[use], high[use]
        covered = np.zeros(max(last + 1, 0) + 1, np.int64)
        np.add.at(covered, self.low, 1)
        np.add.at(covered, self.high + 1, -1)
        self.lone = np.flatnonzero(np.cumsum(covered[:-1]) == 0)  # strings of no trigger
        view, at, low, high = memoryview(units), self.at.tolist(), self.low.tolist(), self.high.tolist()
        k = [xxhash.xxh3_64_intdigest(view[size * i : size * (i + core)], 1) for i in at]
        e = b"".join([xxhash.xxh3_128_digest(view[size * a : size * (b + least)], (i - a) << 16 | i - b + 2) for i, a, b in zip(at, low, high, strict=True)])
        self.k = np.array(k, np.uint64) | _ONE
        self.e, self.e_check = _halves(e + b"".join([xxhash.xxh3_128_digest(view[size * i : size * (i + least)]) for i in self.lone.tolist()]))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def write_blocks(df: DataFrame, before: Batches | None, place: int, least: int, core: int, period: int, unit: Unit) -> DataFrame:
    """Rows: block, data (the rows of df, or those that `before` makes of them, Arrow IPC), n_keys; by string group (triggers first, then lone strings): low, high, at; and where the K and E of each are among the block's sorted keys."""
    names = ("at", "low", "high", "e_at", "k_at")
    schema = pa.schema([("block", pa.int64()), ("data", pa.binary()), ("keys", pa.binary()), ("checks", pa.binary()), ("counts", pa.binary()), ("n_keys", pa.int64()), *((n, pa.binary()) for n in names)])

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else held[0]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        start, found = 0, {n: [] for n in (*names[:3], "k", "e", "check", "lone")}
        for text in batch.column(place).to_pylist():
            units = unit.units(text.encode("utf-8") if text else b"")
            own = Parsed(units, least, core, period, unit)
            n = len(own.at)
            for name, x in (("at", own.at + start), ("low", own.low + start), ("high", own.high + start), ("k", own.k), ("e", own.e[:n]), ("check", own.e_check[:n])):
                found[name].append(x)
            found["lone"].append((own.lone + start, own.e[n:], own.e_check[n:]))
            start += len(units) // unit.size
        one = lambda xs, kind: np.concatenate(xs).astype(kind)
        lone, lone_e, lone_check = (one(x, kind) for x, kind in zip(zip(*found["lone"], strict=True), (np.int64, np.uint64, np.uint64), strict=True))
        k, e = one(found["k"], np.uint64), np.concatenate([one(found["e"], np.uint64), lone_e])
        keys, checks = np.concatenate([e, k]), np.concatenate([one(found["check"], np.uint64), lone_check, np.zeros(len(k), np.uint64)])
        own, at, counts = distinct(keys, checks)
        row = {"block": new_block_id(), "data": sink.getvalue().to_pybytes(), "keys": pack_sorted(keys[own]), "checks": pack(checks[own]), "counts": pack(counts), "n_keys": len(own)}
        row |= {n: pack(np.concatenate([one(found[n], np.int64), lone])) for n in names[:3]} | {"e_at": pack(at[: len(e)]), "k_at": pack(at[len(e) :])}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in before(batches) if before else batches:
            start = 0
            for i, n in enumerate(pa.compute.binary_length(batch.column(place)).fill_null(0).to_pylist()):
                size += n
                if size >= BLOCK_BYTES:
                    yield close([*held, batch.slice(start, i + 1 - start)])
                    held, size, start = [], 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield close(held)

    fields = "block long, data binary, keys binary, checks binary, counts binary, n_keys long, " + ", ".join(f"{n} binary" for n in names)
    return scratch_table(df.mapInArrow(run, fields), "suffix-blocks", "none")


class _Groups:
    """The string groups of a block, without its rows."""

    def __init__(self, row: tuple):
        self.id, self.n_keys = row[:2]
        self.at, self.low, self.high, self.e_at, self.k_at = (unpack(x).astype(np.int64) for x in row[2:7])

    def judged(self, answers: Answers, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By string group: whether all its strings repeat; which groups are to be compared; which of those have a hot K."""
        total, first = answers.of(self.id, self.n_keys)
        n = len(self.k_at)
        e, k = total[self.e_at], total[self.k_at]
        # a distinct E is sent once, by the first block that has it and its first group there
        _, once = np.unique(self.e_at[:n], return_index=True)
        sender = np.zeros(n, bool)
        sender[once] = first[self.e_at[once]] == 1
        compare = np.flatnonzero(sender & (k > e[:n]))
        return e > 1, compare, k[compare] > hot


class _Block(_Groups):
    def __init__(self, row: tuple, place: int, unit: Unit):
        super().__init__(row)
        self.batch = pa.ipc.open_stream(row[7]).read_all().combine_chunks().to_batches()[0]
        self.texts = [t.encode("utf-8") if t else b"" for t in self.batch.column(place).to_pylist()]
        self.parts = [unit.units(t) for t in self.texts]
        self.flat, self.size = b"".join(self.parts), unit.size

    def units(self, start: int, end: int) -> bytes:
        return self.flat[self.size * start : self.size * end]

    def strings(self, groups: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the strings of some groups: the two parts of the hash, and the start."""
        starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(self.low[g], self.high[g] + 1) for g in groups.tolist())])
        view, size = memoryview(self.flat), self.size
        return *_halves(b"".join([xxhash.xxh3_128_digest(view[size * i : size * (i + least)]) for i in starts.tolist()])), starts


_FIELDS = ("block", "n_keys", "at", "low", "high", "e_at", "k_at", "data")


def common(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Units that each row shares at its beginning with the row before it, up to the width; 0 for the first."""
    grid = np.zeros((len(rows), width), rows[0].dtype if rows else np.uint8)
    sizes = np.array([min(len(r), width) for r in rows])
    for i, r in enumerate(rows):
        grid[i, : sizes[i]] = r[: sizes[i]]
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = grid[1:] != grid[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), width)
        out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def equal_strings(phrases: list[bytes], contexts: list[bytes], least: int, unit: Unit = BYTES) -> list[np.ndarray]:
    """For each row, by the length of the phrase's suffix: whether another row has the same string there.

    The string with suffix length n is the last n units of the phrase and the first least - n of the context.
    """
    m = len(phrases)
    back = [np.frombuffer(p, unit.kind)[::-1] for p in phrases]
    ahead = [np.frombuffer(c, unit.kind) for c in contexts]
    sizes, context_sizes = np.array([len(p) for p in back]), np.array([len(c) for c in ahead])
    found = [np.zeros(n + 1, bool) for n in sizes.tolist()]
    if m < 2:
        return found
    keys = [p.tobytes() for p in back]
    by_suffix, by_context = sorted(range(m), key=keys.__getitem__), sorted(range(m), key=contexts.__getitem__)
    suffix_common = common([back[i] for i in by_suffix], int(sizes.max()))
    context_common = common([ahead[i] for i in by_context], least)
    suffix_place, context_place = np.empty(m, np.int64), np.empty(m, np.int64)
    suffix_place[by_suffix], context_place[by_context] = np.arange(m), np.arange(m)
    for n in range(int(sizes.max()) + 1):
        rows = np.flatnonzero((sizes >= n) & (context_sizes >= least - n))
        if len(rows) < 2:
            continue
        group = np.cumsum(suffix_common < n)[suffix_place[rows]] if n else np.zeros(len(rows), np.int64)
        key = group * (m + 1) + np.cumsum(context_common < least - n)[context_place[rows]]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        for i in rows[count[at] > 1].tolist():
            found[i][n] = True
    return found


def _compare(blocks: DataFrame, answers: Answers, place: int, least: int, core: int, hot: int, unit: Unit) -> str:
    """Step 2: compares by K; stores, for each block, its groups and which of their strings repeat. Gives the folder of the answers."""
    spark = blocks.sparkSession
    sent = pa.schema([("k", pa.int64()), ("block", pa.int64()), ("group", pa.int64()), ("phrase", pa.binary()), ("context", pa.binary()), ("answer", pa.bool_())])
    fields = "k long, block long, group long, phrase binary, context binary, answer boolean"

    def send(batches):
        for batch in batches:
            for row in rows_of(batch):
                own = _Block(row, place, unit)
                whole, compare, is_hot = own.judged(answers, hot)
                out = Columns(sent)
                for g in compare[~is_hot].tolist():
                    at, low, high = int(own.at[g]), int(own.low[g]), int(own.high[g])
                    k = xxhash.xxh3_64_intdigest(own.units(at, at + core), 1) >> 1
                    out.add(k, own.id, g, own.units(low, at), own.units(at, high + least), not bool(whole[g]))
                    if len(out) >= 4000:
                        yield out.take()
                yield out.take()

    back = pa.schema([("block", pa.int64()), ("group", pa.int64()), ("repeats", pa.binary())])

    def receive(batches):
        def close(rows):
            out = Columns(back)
            for (_, block, group, phrase, _, answer), same in zip(rows, equal_strings([r[3] for r in rows], [r[4] for r in rows], least, unit), strict=True):
                if answer and same.any():
                    out.add(block, group, np.packbits(same).tobytes())
            return out.take()

        held, k = [], None
        for batch in batches:
            for row in rows_of(batch):
                if row[0] != k and len(held) > 5000:  # whole groups of K
                    yield close(held)
                    held = []
                k = row[0]
                held.append(row)
        yield close(held)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.select(*_FIELDS).mapInArrow(send, fields)
    told = rows.repartition(n, "k").sortWithinPartitions("k").mapInArrow(receive, "block long, group long, repeats binary")
    folder = scratch_path(spark, "suffix-repeats")
    stored = pa.schema([("block", pa.int64())])

    def by_block(batches):
        store, at, held = Store(folder), None, []

        def close():
            table = pa.Table.from_arrays([pa.array([g for g, _ in held], pa.int64()), pa.array([r for _, r in held], pa.binary())], ["group", "repeats"])
            with store.write(str(at)) as f, pa.ipc.new_stream(f, table.schema) as w:
                w.write_table(table)
            return pa.RecordBatch.from_pylist([{"block": at}], schema=stored)

        for batch in batches:
            for block, group, repeats in rows_of(batch):
                if block != at:
                    if at is not None:
                        yield close()
                    at, held = block, []
                held.append((group, repeats))
        if at is not None:
            yield close()

    scratch_table(told.repartition(n, "block").sortWithinPartitions("block", "group").mapInArrow(by_block, "block long"), "suffix-named")
    return folder


#: What is told of a row beside its columns.
MARKS = ("_n_bytes", "_n_removed", "_n_spans", "_kept")


def removed(df: DataFrame, *args, **options) -> DataFrame:
    """The rows of df, all columns, and MARKS, the last of which are the remaining bytes. Arguments: as of `_removed`."""
    return _removed(df, *args, **options).toDF(*df.columns, *MARKS)


def _removed(df: DataFrame, least: int = 400, core: int = 100, period: int = 48, hot: int = 1000, text_col: str = "text", unit: Unit = BYTES) -> DataFrame:
    """As `removed`, with columns named by place, c0.. and mark0..: df may have some of the names of MARKS itself."""
    source, finish, schema = _plan(_placed(df), None, _placed(df).schema, df.columns.index(text_col), least, core, period, hot, unit)
    return source.mapInArrow(finish, schema)


def _placed(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def _plan(df: DataFrame, before: Batches | None, schema: T.StructType, place: int, least: int, core: int, period: int, hot: int, unit: Unit, written: Callable[[], None] = lambda: None) -> tuple[DataFrame, Batches, T.StructType]:
    """What gives the rows of df (or what `before` makes of them, of the schema) with mark0..: a table, a function for its batches, and its result's schema.

    written: called when nothing reads df any more.
    """
    blocks = write_blocks(df, before, place, least, core, period, unit)
    written()
    entries = int(blocks.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0])
    answers, _ = exchange(blocks.select("block", "keys", "checks", "counts"), lambda row: (row[0], unpack_sorted(row[1]), [unpack(row[3])], unpack(row[2])), 1, entries, "suffix")
    folder = _compare(blocks, answers, place, least, core, hot, unit)

    # strings of hot contexts: counted by hash over blocks; a block names each once for each distinct E it sends
    def hot_keys(row):
        own = _Block(row, place, unit)
        _, compare, is_hot = own.judged(answers, hot)
        keys, checks, _ = own.strings(compare[is_hot], least)
        of, _, counts = distinct(keys, checks)
        return own.id, keys[of], [counts], checks[of]

    def count_hot(batches):
        for batch in batches:
            for row in rows_of(batch):
                own = _Groups(row)
                _, compare, is_hot = own.judged(answers, hot)
                g = compare[is_hot]
                yield pa.RecordBatch.from_arrays([pa.array([int((own.high[g] - own.low[g] + 1).sum())])], ["n"])

    n_hot = int(blocks.select(*_FIELDS[:-1]).mapInArrow(count_hot, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) if entries else 0
    hot_answers = exchange(blocks.select(*_FIELDS), hot_keys, 1, n_hot, "suffix-hot")[0] if n_hot else None
    told = (T.LongType(), T.LongType(), T.LongType(), T.BinaryType())
    out_schema = T.StructType([*schema.fields, *(T.StructField(f"mark{i}", kind) for i, kind in enumerate(told))])

    def finish(batches):
        stored = Store(folder)
        for batch in batches:
            for row in rows_of(batch):
                own = _Block(row, place, unit)
                whole, compare, is_hot = own.judged(answers, hot)
                edges = np.zeros(len(own.flat) // own.size + 1, np.int32)
                np.add.at(edges, own.low[whole], 1)
                np.add.at(edges, own.high[whole] + least, -1)
                if stored.has(str(own.id)):
                    table = pa.ipc.open_stream(stored.read(str(own.id))).read_all()
                    for g, bits in zip(table["group"].to_pylist(), table["repeats"].to_pylist(), strict=True):
                        starts = own.at[g] - np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, starts + least, -1)
                if hot_answers and is_hot.any():
                    keys, checks, starts = own.strings(compare[is_hot], least)
                    of, at, _ = distinct(keys, checks)
                    starts = starts[hot_answers.of(own.id, len(of))[0][at] > 1]
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + least, -1)
                gone = np.cumsum(edges[:-1]) > 0
                start, found = 0, []
                for text, part in zip(own.texts, own.parts, strict=True):
                    n = len(part) // own.size
                    mask = gone[start : start + n]
                    start += n
                    if not mask.any():
                        found.append((len(text), 0, 0, text))
                        continue
                    mask = unit.gone(text, mask)
                    found.append((len(text), int(mask.sum()), int((mask & ~np.concatenate([[False], mask[:-1]])).sum()), np.frombuffer(text, np.uint8)[~mask].tobytes()))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*own.batch.columns, *columns], names=[*own.batch.schema.names, *(f"mark{i}" for i in range(4))])

    return blocks.select(*_FIELDS), finish, out_schema


def digests(df: DataFrame, least: int = 400, words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    words: also passage_bytes and n_passages, the bytes and runs that strings
    of so many words cover which start elsewhere too, whatever their length in
    bytes. That is a second parse, of words; the first's tables are dropped
    once it has read them.
    """
    own = df.select(df[id_col].cast("long").alias("c0"), df[text_col].cast("string").alias("c1"))
    told = T.StructType([own.schema["c0"], own.schema["c1"], *(T.StructField(f"c{i}", kind) for i, kind in ((2, T.LongType()), (3, T.LongType()), (4, T.LongType()), (5, T.StringType())))])
    with tracked() as first_paths:
        source, first, _ = _plan(own, None, own.schema, 1, least, least // 4, 48, 1000, BYTES)

    def digested(batches):
        for batch in first(batches):
            sha = pa.array([hashlib.sha256(k).hexdigest() for k in batch.column(5).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], sha], names=told.names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if not words:
        return source.mapInArrow(digested, told).select("c0", "c2", "c3", "c4", "c5").toDF(*names)
    drop = lambda: [Store(p).drop() for p in first_paths]
    source, second, _ = _plan(source, digested, told, 1, words, words // 4, 8, 1000, WORDS, drop)

    def shown(batches):
        for batch in second(batches):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 2, 3, 4, 5, 7, 8)], names=[*names, "passage_bytes", "n_passages"])

    return source.mapInArrow(shown, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_bytes long, n_passages long")


def deduplicated(df: DataFrame, least: int = 400, text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """df with the repeated strings taken out of its texts; length_col, if given, becomes the code points of changed texts. options: as of `removed`."""

    names = df.columns
    place, n, length_at = names.index(text_col), len(names), names.index(length_col) if length_col else None

    options = {"core": 100, "period": 48, "hot": 1000, "unit": BYTES} | options
    source, finish, _ = _plan(_placed(df), None, _placed(df).schema, place, least, **options)

    def run(batches):
        for batch in (part for b in finish(batches) for part in slices_of(b)):
            kept, was = batch.column(n + 3).to_pylist(), batch.column(place).to_pylist()
            texts = [w if w is None else k.decode("utf-8", "ignore") for w, k in zip(was, kept, strict=True)]
            columns = list(batch.columns[:n])
            columns[place] = pa.array(texts, pa.string())
            if length_at is not None:
                told = columns[length_at].to_pylist()
                columns[length_at] = pa.array([c if t == w else len(t) for c, t, w in zip(told, texts, was, strict=True)], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, df.schema)
