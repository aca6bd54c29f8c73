"""Token ids of whole texts, exactly as the tokenizers library gives them, from a bounded cache of chunks.

A text is cut before every white-space run and after ASCII letters that no
further letter follows. Neither of the two pre-tokenizers in use lets a token
cross these borders, so the chunks' ids, joined, are the text's ids; equal
chunks are encoded once. Texts with white space beyond ASCII are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain, islice

import numpy as np

_CHUNK = re.compile(rb"[\t-\r ]*+[A-Za-z]++(?![\x80-\xff])|[\t-\r ]*+[^\t-\r ]++|[\t-\r ]++")
#: Bytes without which _RARE can't match; most texts have none of them.
_LEADS = [bytes([b]) for b in (0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3)]
#: White space that some library may take as such: C0 separators, U+0085, U+00A0, U+1680, U+2000-200A, U+2028/9, U+202F, U+205F, U+3000.
_RARE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


#: Chunks of the first texts that go to a table small enough for the processor's cache.
HOT = 16_384


def chunks_of(text: bytes) -> list[bytes] | None:
    """The chunks of a text, or None if it has to be taken whole."""
    if any(b in text for b in _LEADS) and _RARE.search(text):
        return None
    return _CHUNK.findall(text)


def trim(cache: dict, limit: int) -> None:
    """Keeps the oldest half, which holds the frequent chunks, once the cache is full."""
    if len(cache) > limit:
        for key in list(islice(reversed(cache), len(cache) - limit // 2)):
            del cache[key]


class ChunkEncoder:
    """encode(texts) gives the ids of each text as little-endian unsigned 32-bit integers.

    Where the vocabulary drops white space and lower-cases, words are the
    chunks, lower-cased beforehand unless a special string may be among them.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.cache, self.old = Tokenizer.from_file(path), limit, {}, {}
        self.hot: dict[bytes, bytes] | None = None
        told = json.loads(self.tokenizer.to_str())
        steps = {x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])}
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.words = {"Replace", "Lowercase"} <= steps and cuts[0].get("behavior") == "Removed"
        self.parting = next(((t["content"].encode(), t["id"]) for t in told["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])), None)
        self.marks = {t["content"][:2].encode() for t in told["added_tokens"]}

    def library(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def library_of_chunks(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of many chunks at less cost: a special token, which splits a text before all else, parts them."""
        found: dict[bytes, bytes] = {}
        for start in range(0, len(chunks), 100):
            part = chunks[start : start + 100]
            if self.parting and sum(map((joined := self.parting[0].join(part)).count, self.marks)) == len(part) - 1:
                ids = np.array(self.tokenizer.encode_batch_fast([joined.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
                ends = 4 * np.flatnonzero(ids == self.parting[1])
                raw = ids.tobytes()
                found.update(zip(part, map(raw.__getitem__, map(slice, [0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)])), strict=True))
            else:
                found.update(zip(part, self.library(part), strict=True))
        return found

    def cut(self, text: bytes) -> list[bytes] | None:
        if not self.words:
            return chunks_of(text)
        return (text if any(m in text for m in self.marks) else text.lower()).split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        if self.hot is None and (counts := Counter(chain.from_iterable(c for c in cut if c))):
            first = [c for c, n in counts.most_common(HOT) if n > 1]
            self.hot = dict(zip(first, map(self.library_of_chunks(first).__getitem__, first), strict=True))
        hot, get, missing = (self.hot or {}).get, self.cache.get, set()
        found, gaps = [], []
        for chunks in cut:
            if chunks is None:
                found.append(None)
                gaps.append(())
                continue
            ids, still = list(map(hot, chunks)), []
            rare = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(rare, map(get, map(chunks.__getitem__, rare)), strict=True):
                if x is None:
                    still.append(i)
                else:
                    ids[i] = x
            missing.update(map(chunks.__getitem__, still))
            found.append(ids)
            gaps.append(still)
        old = self.old
        self.cache.update((c, old[c]) for c in missing if c in old)
        self.cache.update(self.library_of_chunks([c for c in missing if c not in old]))
        cache = self.cache
        for chunks, ids, still in zip(cut, found, gaps, strict=True):
            for i in still:
                ids[i] = cache[chunks[i]]
        out = [self.library([t])[0] if ids is None else b"".join(ids) for t, ids in zip(texts, found, strict=True)]
        if len(self.cache) > self.limit:  # what is used again comes back from the older half
            self.old, self.cache = self.cache, {}
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process and file."""
    return ChunkEncoder(path)


def by_size(rows, most: int = 1 << 21):
    """Lists of (.., text) rows with about `most` bytes of text each; a longer text is a list of its own."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[-1]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        yield held
