"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a few neighbouring tokens; tokens under a zero are
ignored, so a replaced word spoils only the seeds that look at it. Every seed
of the test items is hashed into sorted arrays; every seed of a training text
is looked up there. A hit names an item and the diagonal on which text and
item are aligned. Along the diagonal, the overlap around the hit is verified
token by token: any stretch counts that is as long as the item or as `overlap`
tokens, with at least `identity` of them equal. The whole item is reported if
it counts, else the stretch with the most equal tokens, the shortest of those.
Words inserted or left out only move an overlap to another diagonal.

Workers hash the test items and store them in the shared folder in slices of
about `slice_tokens` tokens (100 bytes a token with four masks). There is one
pass over the texts: a task cuts a block of texts into tokens once and holds
it against one slice after the other, so its memory doesn't depend on the size
of the test set, of which the driver sees the slices' names only.

A token is what is left of a white-space separated word after lower-casing
and without its characters that are no letters or digits; a word of which
nothing is left is no token. From PROMISED tokens on, the masks leave a seed
wherever a fifth of the tokens is replaced. An item with fewer has masks of its
own, as long as it is (`whole_masks`): of each placement of the replaced tokens
that `identity` allows, one of them looks away.

Defined cases: null texts and items without tokens match nothing, as do empty
tables. Repeated rows give repeated results, repeated items one result each. A
null item_id is reported as null. A very long text is cut and matched whole,
as a block of its own.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Columns, Store, bounded_batches, rows_of, scratch_path, slices_of
from .encoding import by_size

#: Which tokens of a window a seed looks at.
MASKS = ("111111", "11101011", "1100110101", "110100100011")
#: Tokens of a stretch from which on MASKS find it with a fifth of the tokens replaced.
PROMISED = 13
_OTHER = re.compile(r"[\W_]+")
_TABLE_BITS = 22
_ROUNDING = 1e-9


class _Tokens(dict):
    """The token's hash by raw word; 0 for a word without letters and digits."""

    def __missing__(self, word: bytes) -> int:
        token = _OTHER.sub("", word.decode("utf-8", "replace").lower())
        h = self[word] = (xxhash.xxh64_intdigest(token.encode()) | 1) if token else 0
        return h


def tokens_of(text: bytes, known: _Tokens) -> np.ndarray:
    words = text.split()
    found = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return found[found != 0]


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask's window at each position where it fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    for k, used in enumerate(mask):
        if used == "1":
            h = (h ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def whole_masks(n: int, replaced: int) -> list[str]:
    """Masks of n tokens, of which one looks at none of the replaced ones, wherever these are.

    The tokens are cut into 2 * replaced + 1 blocks, and each mask ignores
    `replaced` of them; where that would be very many masks, into replaced + 1
    blocks, of which each mask looks at one.
    """
    few = replaced < 3 and n >= 2 * replaced + 1
    blocks = 2 * replaced + 1 if few else min(n, replaced + 1)
    block = [k * blocks // n for k in range(n)]
    ignored = itertools.combinations(range(blocks), replaced if few else blocks - 1)
    return ["".join("0" if b in away else "1" for b in block) for away in ignored]


@dataclass
class Items:
    """A slice of test items: all tokens in a row, where each item starts, and per mask the sorted seeds."""

    ids: list
    tokens: np.ndarray
    starts: np.ndarray
    tables: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]  # mask, presence bits, sorted seeds, their positions

    @classmethod
    def of(cls, ids: list, tokens: list[np.ndarray], identity: float = 0.8) -> Items:
        starts = np.cumsum([0] + [len(t) for t in tokens])
        # whole short items are seeds themselves
        short = sorted({len(t) for t in tokens if 0 < len(t) < PROMISED})
        own_masks = [m for n in short for m in whole_masks(n, n - max(1, math.ceil(identity * n - _ROUNDING)))]
        tables = []
        for mask, general in [*((m, True) for m in MASKS), *((m, False) for m in own_masks)]:
            h, at = [], []
            for t, s in zip(tokens, starts[:-1].tolist(), strict=True):
                if general or len(t) == len(mask):
                    own = seeds(t, mask)
                    h.append(own)
                    at.append(np.arange(s, s + len(own)))
            h, at = np.concatenate(h), np.concatenate(at)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _TABLE_BITS, bool)
            bits[h >> np.uint64(64 - _TABLE_BITS)] = True
            tables.append((mask, np.packbits(bits), h[order], at[order]))
        return cls(ids, np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), starts, tables)


class Matcher:
    def __init__(self, items: Items, identity: float, overlap: int):
        self.items, self.identity, self.overlap = items, identity, overlap
        self.tables = [(m, np.unpackbits(b).view(bool), h, at) for m, b, h, at in items.tables]

    def hits(self, tokens: np.ndarray) -> np.ndarray:
        """Pairs (item, diagonal) that some seed names, without repeats."""
        found = []
        for mask, bits, keys, at in self.tables:
            h = seeds(tokens, mask)
            where = np.flatnonzero(bits[h >> np.uint64(64 - _TABLE_BITS)])
            if not len(where):
                continue
            low, high = np.searchsorted(keys, h[where]), np.searchsorted(keys, h[where], "right")
            times = high - low
            p = np.repeat(where, times)
            q = at[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            item = np.searchsorted(self.items.starts, q, "right") - 1
            found.append(np.stack([item, p - (q - self.items.starts[item])], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def verify(self, tokens: np.ndarray, item: int, shift: int) -> tuple[int, int, int] | None:
        """Start in the text, length and matches of the best overlap on a diagonal, if any is long and equal enough."""
        own = self.items.tokens[self.items.starts[item] : self.items.starts[item + 1]]
        first, last = max(0, -shift), min(len(own), len(tokens) - shift)
        same = own[first:last] == tokens[first + shift : last + shift]
        least, whole = min(self.overlap, len(own)), int(same.sum())
        if len(same) == len(own) and whole >= self.identity * len(own) - _ROUNDING:
            return first + shift, len(own), whole
        if len(same) < least:
            return None
        # a stretch is equal enough if the sum of match - identity doesn't fall over it; for each end, the earliest such start
        matched = np.concatenate([[0], np.cumsum(same)])
        sums = matched - self.identity * np.arange(len(matched))
        ends = np.arange(least, len(matched))
        starts = np.searchsorted(-np.minimum.accumulate(sums), -sums[ends] - _ROUNDING)
        fits = starts <= ends - least
        if not fits.any():
            return None
        ends, starts = ends[fits], starts[fits]
        # unequal tokens at the start count only where the stretch would be too short without them
        starts = np.minimum(np.searchsorted(matched, matched[starts], "right") - 1, ends - least)
        found = matched[ends] - matched[starts]
        k = np.lexsort((ends - starts, -found))[0]
        return first + int(starts[k]) + shift, int(ends[k] - starts[k]), int(found[k])

    def matches(self, cut: list[np.ndarray]) -> list[list[tuple]]:
        """For each text's tokens: (item_id, start, length, matched), one an item, the best."""
        starts = np.cumsum([0] + [len(t) for t in cut])
        flat = np.concatenate(cut) if cut else np.zeros(0, np.uint64)
        out: list[list[tuple]] = [[] for _ in cut]
        best: dict[tuple[int, int], tuple] = {}
        for item, shift in self.hits(flat).tolist():
            # seeds that reach over a border verify on neither side; both sides are tried
            size = int(self.items.starts[item + 1] - self.items.starts[item])
            low = max(0, int(np.searchsorted(starts, max(shift, 0), "right")) - 1)
            high = int(np.searchsorted(starts, min(shift + size, len(flat)), "left"))
            for doc in range(low, min(high, len(cut))):
                got = self.verify(cut[doc], item, shift - int(starts[doc]))
                if got and got[2] > best.get((doc, item), (0, 0, 0))[2]:
                    best[doc, item] = got
        for (doc, item), got in sorted(best.items()):
            out[doc].append((self.items.ids[item], *got))
        return out


@lru_cache(maxsize=2)
def matcher(folder: str, name: str, identity: float, overlap: int) -> Matcher:
    """A stored slice; a worker process keeps the last two."""
    return Matcher(pickle.loads(Store(folder).read(name)), identity, overlap)


class Slices:
    """Stored slices of test items."""

    def __init__(self, benchmark: DataFrame, most: int, id_col: str, text_col: str, identity: float, overlap: int):
        spark = bounded_batches(benchmark.sparkSession)
        self.folder, self.identity, self.overlap = scratch_path(spark, "test-items"), identity, overlap
        rows = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
        size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        folder, schema = self.folder, pa.schema([("name", pa.string())])

        def store(batches):
            known, ids, tokens, size = _Tokens(), [], [], 0

            def close():
                name = uuid.uuid4().hex
                with Store(folder).write(name) as f:
                    f.write(pickle.dumps(Items.of(ids, tokens, identity)))
                return pa.RecordBatch.from_pylist([{"name": name}], schema=schema)

            for batch in batches:
                for item_id, text in rows_of(batch):
                    own = tokens_of(text, known)
                    if ids and len(own) and size + len(own) > most:
                        yield close()
                        ids, tokens, size = [], [], 0
                    if len(own):
                        ids.append(item_id)
                        tokens.append(own)
                        size += len(own)
            if ids:
                yield close()

        # a slice has some five bytes of text a token; slices are stored by tasks that have about one to store
        told = rows.coalesce(max(1, int(size // (5 * most)))).mapInArrow(store, "name string")
        self.names = sorted(r.name for r in told.collect())  # a name a slice

    def found(self, rows: Iterator[tuple], known: _Tokens) -> Iterator[tuple[tuple, list[tuple]]]:
        """Each row (.., text) with its matches."""
        for block in by_size(rows, (2 << 20) if len(self.names) < 2 else (16 << 20)):
            cut = [tokens_of(r[-1], known) for r in block]
            if len(known) > 600_000:
                known.clear()
            got = [matcher(self.folder, name, self.identity, self.overlap).matches(cut) for name in self.names]
            yield from ((row, [x for part in each for x in part]) for row, *each in zip(block, *got, strict=True))


def contaminated(docs: DataFrame, benchmark: DataFrame, identity: float = 0.8, overlap: int = 13, slice_tokens: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start and length of the overlap in tokens, matched: one row a document and item found in it."""
    bounded_batches(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "start", "length", "matched")])
    items = Slices(benchmark, slice_tokens, item_col, item_text_col, identity, overlap)

    def run(batches):
        known = _Tokens()
        for batch in batches:
            out = Columns(schema)
            for (doc_id, _), got in items.found(rows_of(batch), known):
                for x in got:
                    out.add(doc_id, *x)
            yield out.take()

    return own.mapInArrow(run, "doc_id long, item_id long, start long, length long, matched long")


def clean(docs: DataFrame, benchmark: DataFrame, identity: float = 0.8, overlap: int = 13, slice_tokens: int = 200_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no test item is found."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    items = Slices(benchmark, slice_tokens, item_col, item_text_col, identity, overlap)

    def run(batches):
        known = _Tokens()
        for batch in (part for b in batches for part in slices_of(b)):
            texts = ((t.encode("utf-8") if t else b"",) for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([not got for _, got in items.found(texts, known)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
