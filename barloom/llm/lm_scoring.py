"""LM scoring by deleted interpolation.

The probability of a word after another mixes three estimates: the bigram's
and the word's maximum likelihood in the training texts, and the uniform
1 / (V + 1). The mixture weights depend on the bucket of the context's
frequency (its binary logarithm). They are learned by expectation-maximisation
on held-out counts: one fold of the training texts is deleted from the counts
and predicted by the rest. The texts' statistics for that are a histogram over
(bucket, bigram estimate, word estimate), the estimates as quarter powers of
two of their ratio to the uniform one, which bounds it whatever the corpus.
The final scores use all training texts and exact estimates.

Words are lower-cased over A-Z and cut at ASCII white space; a text ends with
an end token, and begins after a start that is a context only. Counts are
summed by 64-bit hashes, see blocks.py; nothing of the vocabulary is sent to
the driver or broadcast.

Defined cases: null text is empty and has the end token alone. A null doc_id
counts as the empty text for the fold. Repeated rows count each. Without
training texts N and V are 0, and all tokens score the uniform estimate. A
very long text is a block of its own and is scored whole. An empty table gives
no rows. Only the two columns named are read, whatever the others are called.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Answers, exchange, new_block_id, pack, unpack
from .common import Columns, documents_of, rows_of, scratch_table

START, END = xxhash.xxh64_intdigest(b"\x00start"), xxhash.xxh64_intdigest(b"\x00end")
BLOCK_TOKENS = 1_000_000
TOP_BUCKET = 24
#: Steps of a histogram's axis: 4 to a doubling, from 2**-16 to 2**48 times the uniform estimate, and one for zero.
_LOW, _STEPS = -64, 258


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _blocks(df: DataFrame, held_out: tuple[int, int], em_fold: int) -> DataFrame:
    """Rows: block, doc_ids, roles (0 training, 1 training and deleted for the weights, 2 held out), lengths, words (distinct hashes), tokens (their places)."""
    fold, out_at = held_out
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("roles", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary()), ("n_tokens", pa.int64()), ("n_train", pa.int64()), ("n_em", pa.int64())])

    def run(batches):
        known, ids, roles, parts = _Hashes(), [], [], []

        def close():
            flat = np.concatenate(parts)
            words, tokens = np.unique(flat, return_inverse=True)
            lengths, role = np.array([len(p) for p in parts]), np.array(roles)
            row = {
                "block": new_block_id(), "doc_ids": list(ids), "roles": bytes(roles), "lengths": pack(lengths), "words": pack(np.diff(words, prepend=np.uint64(0))), "tokens": pack(tokens),
                "n_tokens": len(flat), "n_train": int(lengths[role < 2].sum()), "n_em": int(lengths[role == 1].sum()),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        size = 0
        for batch in batches:
            for doc_id, text in rows_of(batch):
                found = text.lower().split()
                k = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % fold
                own = np.empty(len(found) + 1, np.uint64)
                own[:-1] = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
                own[-1] = END
                ids.append(doc_id)
                roles.append(2 if k == out_at else 1 if k == em_fold else 0)
                parts.append(own)
                size += len(own)
                if size >= BLOCK_TOKENS:
                    yield close()
                    size = 0
                    for x in (ids, roles, parts):
                        x.clear()
            if len(known) > 600_000:
                known.clear()
        if parts:
            yield close()

    fields = "block long, doc_ids array<long>, roles binary, lengths binary, words binary, tokens binary, n_tokens long, n_train long, n_em long"
    return scratch_table(documents_of(df).mapInArrow(run, fields), "lm-blocks", "none")


class _Block:
    """A block's tokens with their keys: words and the start end in 1, bigrams in 0."""

    def __init__(self, row: tuple):
        self.id, self.doc_ids, roles, lengths, words, tokens = row
        self.lengths, self.roles = unpack(lengths).astype(np.int64), np.frombuffer(roles, np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        words, tokens = np.cumsum(unpack(words), dtype=np.uint64), unpack(tokens).astype(np.int64)
        flat = words[tokens]
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[self.starts] = START
        pairs = ((before * np.uint64(0x9E3779B97F4A7C15)) ^ (flat >> np.uint64(32)) ^ (flat << np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        one = np.uint64(1)
        pairs = (pairs ^ (pairs >> np.uint64(31))) & ~one
        keys = np.concatenate([words | one, [START | one], pairs])
        # places of each token's word, context and bigram among the sorted distinct keys
        self.keys, at = np.unique(keys, return_inverse=True)
        n = len(words)
        self.word = at[:n][tokens]
        self.pair = at[n + 1 :]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = at[n]
        self.role = np.repeat(self.roles, self.lengths)
        self.start_at = at[n]

    def counts(self, roles: tuple[int, ...]) -> np.ndarray:
        use = np.isin(self.role, roles)
        found = np.bincount(self.word[use], minlength=len(self.keys)) + np.bincount(self.pair[use], minlength=len(self.keys))
        found[self.start_at] += np.isin(self.roles, roles).sum()
        return found


_FIELDS = ("block", "doc_ids", "roles", "lengths", "words", "tokens")


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then by the binary logarithm of the frequency."""
    return np.minimum(np.floor(np.log2(np.maximum(counts, 0.5))).astype(np.int64) + 1, TOP_BUCKET)


def expectation_maximisation(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, times: np.ndarray, rounds: int = 60, prior: float = 1.0) -> np.ndarray:
    """Weights (bigram, word, uniform) of each bucket, each estimate credited with `prior` more tokens, so that none is ruled out; a bucket without held-out counts takes those of all, an unseen context none for the bigram."""

    def learned(use: np.ndarray) -> np.ndarray:
        parts = np.stack([p2[use], p1[use], np.full(int(use.sum()), p0)], 1)
        w, n = np.full(3, 1 / 3), times[use]
        for _ in range(rounds):
            share = parts * w
            share /= share.sum(1, keepdims=True)
            w = ((share * n[:, None]).sum(0) + prior) / (n.sum() + 3 * prior)
        return w

    every = learned(np.ones(len(times), bool)) if times.sum() else np.full(3, 1 / 3)
    out = np.tile(every, (TOP_BUCKET + 1, 1))
    for b in range(TOP_BUCKET + 1):
        if times[bucket == b].sum() > 0:
            out[b] = learned(bucket == b)
    return out


def _ratio(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.divide(x, of, out=np.zeros(len(x)), where=of > 0)


def _histogram(blocks: DataFrame, answers: Answers, n: int, p0: float) -> tuple[np.ndarray, ...]:
    """bucket, bigram estimate, word estimate, times over the deleted fold's tokens; at most 25 * 258 * 258 rows."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                if 1 not in row[2]:
                    continue
                own = _Block(row)
                train, em, _ = answers.of(own.id, len(own.keys))
                rest = (train - em).astype(np.float64)
                use = own.role == 1
                context = rest[own.context[use]]
                cells = bucket_of(context)
                for p in (_ratio(rest[own.pair[use]], context), rest[own.word[use]] / max(n, 1)):
                    step = np.round(4 * np.log2(np.maximum(p, 1e-300) / p0)).astype(np.int64) - _LOW + 1
                    cells = cells * _STEPS + np.where(p > 0, np.clip(step, 1, _STEPS - 1), 0)
                cells, times = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(times)], ["cell", "times"])

    rows = blocks.select(*_FIELDS).mapInArrow(run, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).collect()
    cells, times = np.array([r.cell for r in rows], np.int64), np.array([r.times for r in rows], np.float64)
    value = lambda step: np.where(step > 0, p0 * np.exp2((step - 1 + _LOW) / 4), 0.0)
    return cells // _STEPS**2, value(cells // _STEPS % _STEPS), value(cells % _STEPS), times


def score(df: DataFrame, held_out: tuple[int, int] = (7, 2), em_fold: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: (m, k): rows whose crc32 of doc_id modulo m is k are not learned
    from. em_fold: the remainder whose rows are deleted to learn the weights.
    """
    blocks = _blocks(df, held_out, em_fold)
    totals = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_em"), F.lit(0))).first()
    n_tokens, n_train, n_em = (int(x) for x in totals)

    def ask(row):
        own = _Block(row)
        return own.id, own.keys, [own.counts((0, 1)), own.counts((1,))]

    one, start = np.uint64(1), np.uint64(START | 1)
    answers, tallied = exchange(blocks.select(*_FIELDS), ask, 2, n_tokens, "lm", lambda keys, sums: [int((((keys & one) == one) & (keys != start) & (sums[0] > 0)).sum())])
    vocabulary = tallied[0] if tallied else 0
    p0 = 1 / (vocabulary + 1)
    weights = expectation_maximisation(*(h := _histogram(blocks, answers, n_train - n_em, p0))[:3], p0, h[3])
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                own = _Block(row)
                train = answers.of(own.id, len(own.keys))[0].astype(np.float64)
                word, context = train[own.word], train[own.context]
                mix = weights[bucket_of(context)]
                p = mix[:, 0] * _ratio(train[own.pair], context) + mix[:, 1] * (word / max(n_train, 1)) + mix[:, 2] * p0
                by_text = lambda x: np.add.reduceat(x, own.starts)
                base = by_text(np.log10((word + 1) / (n_train + vocabulary + 1)))
                out = Columns(schema)
                for x in zip(own.doc_ids, (own.roles == 2).tolist(), own.lengths.tolist(), by_text((word > 0).astype(np.int64)).tolist(), base.tolist(), by_text(np.log10(p)).tolist(), strict=True):
                    out.add(*x[:4], n_train, *x[4:])
                yield out.take()

    return blocks.select(*_FIELDS).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
