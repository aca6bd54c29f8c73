"""Token counts by prefix dynamic programming.

For a byte-level BPE vocabulary, the encoding of a prefix ends in the one
token that (a) is a suffix of the prefix and (b) may follow the last token of
the encoding of what is before it. So ``count[i] = count[i - len(token)] + 1``
runs over the bytes once and gives the exact count of *every* prefix. Whether
a token may follow another is decided by the merges along their common border
and is remembered by pair. The last token of a prefix doesn't depend on what
comes after it, so it is remembered by prefix, too: words that begin alike
share that part of the work.

A text's table holds, for each code point, the change in the token count when
the prefix grows by it. Truncation and budget questions read the table:
nothing is encoded again.

Defined cases: a null text is empty (0 tokens, empty table). Repeated rows
give repeated results. Bytes that aren't UTF-8 count as U+FFFD. A special
string inside a text is one token, as by the library's default. Texts of any
length are counted whole. Ids may be null or repeat: they are handed on. An
empty table gives no rows. Only the two columns named are read.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Columns, documents_of, rows_of
from .encoding import by_size, chunks_of, trim

#: The published pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 60
#: Bytes of the longest prefix that is remembered; what lies beyond is computed each time.
_REMEMBERED = 24


def byte_names() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    def __init__(self, path: str, limit: int = 600_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        byte = byte_names()
        raw = lambda s: bytes(byte[c] for c in s)
        self.ids = {raw(s): i for s, i in told["model"]["vocab"].items() if all(c in byte for c in s)}
        self.made: dict[tuple[int, int], tuple[int, int]] = {}  # pair: rank, token
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = (raw(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            self.made.setdefault((a, b), (rank, c))
            self.parts.setdefault(c, (rank, a, b))
        self.special = [t["content"] for t in told["added_tokens"]]
        for s in self.special:
            self.ids.pop(s.encode(), None)
        self.pattern, self.limit = regex.compile(PATTERN), limit
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.border: dict[tuple[int, int], bool] = {}
        self.cache: dict[bytes, bytes] = {}
        self.size = [0] * (1 + max(self.ids.values()))
        #: Each token and each end of one: the token, or -1.
        self.ends: dict[bytes, int] = {}
        for token, i in self.ids.items():
            self.size[i] = len(token)
            self.ends[token] = i
            for start in range(1, len(token)):
                self.ends.setdefault(token[start:], -1)
        self.last: dict[bytes, int] = {}  # prefix of a pre-token: the last token of its encoding

    def stands(self, x: int, y: int) -> bool:
        """Whether the border between the tokens x and y outlives all merges."""
        pair, before_x, before_y, kept = (x, y), _NEVER, _NEVER, True
        while True:
            merge = self.made.get((x, y))
            if merge is not None and merge[0] < before_x and merge[0] <= before_y:
                kept = False
                break
            from_x, from_y = self.parts.get(x), self.parts.get(y)
            if from_x is None and from_y is None:
                break
            if from_y is None or from_x is not None and from_x[0] > from_y[0]:
                before_x, x = from_x[0], from_x[2]
            else:
                before_y, y = from_y[0], from_y[1]
        if len(self.border) > 1_000_000:
            self.border.clear()
        self.border[pair] = kept
        return kept

    def piece(self, word: bytes) -> list[int]:
        """Token counts of the prefixes of one pre-token, from 1 byte on."""
        ends, border, stands, size, known = self.ends.get, self.border.get, self.stands, self.size, self.last
        last, count = [-1], [0]
        for end in range(1, len(word) + 1):
            prefix = word[:end]
            token = known.get(prefix)
            if token is None:
                fits = []  # tokens that end here, short ones first
                for start in range(end - 1, -1, -1):
                    found = ends(word[start:end])
                    if found is None:
                        break
                    if found >= 0:
                        fits.append((start, found))
                for start, token in reversed(fits):
                    if not start:
                        break
                    kept = border((last[start], token))
                    if kept is None:
                        kept = stands(last[start], token)
                    if kept:
                        break
                if end <= _REMEMBERED:
                    known[prefix] = token
            last.append(token)
            count.append(count[end - size[token]] + 1)
        del count[0]
        return count

    def plain(self, text: str) -> list[int]:
        """Counts after each code point of a text without special strings."""
        counts: list[int] = []
        total, pieces = 0, self.pattern.findall(text)
        for k, word in enumerate(pieces):
            data = word.encode("utf-8")
            own = self.piece(data)
            if len(data) != len(word):  # a code point ends before a byte that continues none
                own = [n for n, after in zip(own, (*data[1:], 0), strict=True) if after & 0xC0 != 0x80]
            at = [total + n for n in own]
            if word in ("'re", "'ve", "'ll"):  # cut after the first letter, the letter is a piece of its own
                at[1] = total + 2
            if counts and k and pieces[k - 1].isspace():
                # white space before a visible character gives its last character away; up to there the run is one piece
                run = pieces[k - 1] + word[0] if word[0].isspace() else ""
                if run:
                    at[0] = total - self.piece(pieces[k - 1].encode())[-1] + self.piece(run.encode())[-1]
            counts += at
            total += own[-1]
        return counts

    def whole(self, text: str) -> list[int]:
        """Counts after each code point; special strings are single tokens."""
        if not any(s in text for s in self.special):
            return self.plain(text)
        counts: list[int] = []
        total = start = 0
        for m in self.split.finditer(text):
            with_part = self.plain(text[start : m.end() - 1])  # a cut special string is ordinary text
            before = self.plain(text[start : m.start()])
            total_before = before[-1] if before else 0
            counts += [total + n for n in [*before, *with_part[len(before) :]]] + [total + total_before + 1]
            total, start = total + total_before + 1, m.end()
        return counts + [total + n for n in self.plain(text[start:])]

    def steps(self, text: bytes) -> bytes:
        """The table: 16-bit changes of the count, one a code point."""
        if text[text[:1] == b" " :].isalpha():  # a single pre-token of ASCII letters
            counts = self.piece(text)
        else:
            counts = self.whole(text.decode("utf-8", "replace"))
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def table(self, text: bytes) -> np.ndarray:
        """Token counts after 1, 2, ... code points of a text."""
        chunks = chunks_of(text)
        if chunks is None:
            return np.cumsum(np.frombuffer(self.steps(text), "<i2"), dtype=np.int64)
        for c in set(chunks).difference(self.cache):
            self.cache[c] = self.steps(c)
        out = np.cumsum(np.frombuffer(b"".join(map(self.cache.__getitem__, chunks)), "<i2"), dtype=np.int64)
        trim(self.cache, self.limit)
        trim(self.last, self.limit)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_at(table: np.ndarray, code_points: int) -> int:
    """Tokens of the prefix with so many code points."""
    return int(table[min(code_points, len(table)) - 1]) if code_points > 0 and len(table) else 0


def longest_within(table: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix that takes at most `budget` tokens."""
    fits = np.flatnonzero(table <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_tables(df: DataFrame, tokenizer: str, budget: int, id_col: str = "doc_id", text_col: str = "text", tables: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > budget), chars_in_budget; with tables, also each prefix's count."""
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("chars_in_budget", pa.int64())]
    schema = pa.schema(kinds + [("prefix_tokens", pa.list_(pa.int64()))] * tables)

    def run(batches):
        own = counter(tokenizer)
        for batch in batches:
            for rows in by_size(rows_of(batch)):
                out = Columns(schema)
                for doc_id, text in rows:
                    table = own.table(text)
                    total = count_at(table, len(table))
                    out.add(doc_id, len(text), total, total > budget, longest_within(table, budget), *([table] if tables else []))
                yield out.take()

    spark_schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_in_budget long" + ", prefix_tokens array<long>" * tables
    return documents_of(df, id_col, text_col).mapInArrow(run, spark_schema)
