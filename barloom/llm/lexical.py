"""Ranked lexical search by inverted treaps.

Terms are the maximal runs of letters and digits of ASCII and of all other
characters beyond ASCII, A-Z lowered. A term's weight and a document's length
give each posting a whole-number impact (`impacts`); a document's score for a
query is the sum of the impacts of the query's terms, once each.

Each term of a shard of documents has a treap: search order by doc_id, heap
order by impact, so a subtree's root bounds all scores below it. Impacts are
heaped by sixteenths of an octave and equal ones by a hash: that keeps treaps
shallow where impacts rise or fall with doc_id, or are all the same. The
treaps of a query's terms are walked together (`Shard.top`). An interval of
documents has one node a term, the topmost inside it; where their summed
maxima can't reach the k-th best score so far, the interval is dropped; else
the document of the highest node is scored and parts the interval in two. A
task walks many intervals of many queries at a time, the best first.

1. Queries are dealt into slices of at most SLICE_ITEMS items and about
   SLICE_TERMS terms, stored in the shared folder. What follows is done a
   slice at a time, over all documents.
2. A pass over the texts keeps each document's length and its counts of the
   slice's terms (nothing else is in any sum), and counts documents, terms and
   document frequencies.
3. Weights, at most one number a term of the slice, go to the shared folder.
   Tasks gather the stored counts into shards, build the treaps and hand on
   the k best a query, whose best k in turn are the result. Texts are not
   shuffled; nothing but those k rows a task and query is.

Defined cases: null and empty texts and those without a term are in no count
and no result; so is a query without terms. Rows are documents, whether ids
repeat or not; equal scores go by doc_id, null last, then by no order. Repeated
queries have a result each. Terms of any length count whole. Empty tables give
empty results. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Columns, Store, documents_of, rows_of, scratch_path, scratch_table

SLICE_ITEMS, SLICE_TERMS = 4096, 1 << 20
#: Documents and postings of a shard, at most (a document is never cut).
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000
#: Nodes of the treaps that are walked at once.
WALK = 1 << 18
#: Sorts where an id would go.
NO_ID = (1 << 63) - 1

_TERM = bytearray(b" " * 128) + bytes(range(128, 256))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _TERM[_c] = _c
for _c in range(65, 91):
    _TERM[_c] = _c + 32
_TERM = bytes(_TERM)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Whole numbers: weight times the saturated count of a term in a document of so many terms."""
    m = 50 + (50 * length * docs) // words
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def treaps(starts: list[int], priority: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children and, for each list starts[t] to starts[t + 1] in search order, the root; -1 where there is none."""
    n = len(priority)
    left, right, roots = [-1] * n, [-1] * n, [-1] * (len(starts) - 1)
    for t, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        if a == b:
            continue
        path: list[int] = []  # from the root along right children
        for i in range(a, b):
            x, last = priority[i], -1
            while path and priority[path[-1]] < x:
                last = path.pop()
            left[i] = last
            if path:
                right[path[-1]] = i
            path.append(i)
        roots[t] = path[0]
    return tuple(np.array([*x, -1], np.int64) for x in (left, right, roots))  # the last is what -1 points to


class Shard:
    """The treaps of some documents' postings: term, doc (its place in the order of doc_id) and impact over 0, in order of (term, doc)."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        self.docs, self.terms = docs, terms
        step = np.floor(np.log2(impact) * 16).astype(np.int64)
        cap = np.zeros(int(step.max(initial=0)) + 1, np.int64)
        np.maximum.at(cap, step, impact)
        cap = np.maximum.accumulate(cap)
        hashed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)
        starts = np.searchsorted(term, np.arange(terms + 1))
        self.left, self.right, self.roots = treaps(starts.tolist(), ((step << 30) | hashed.astype(np.int64)).tolist())
        self.keys = term.astype(np.int64) * docs + doc
        self.doc, self.impact, self.most = np.append(doc, -1), np.append(impact, 0), np.append(cap[step], 0)

    def _topmost(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From nodes (a row an interval, a column a term), the topmost ones at or below them inside low to high."""
        flat, width = nodes.reshape(-1).copy(), nodes.shape[1]
        open_ = np.flatnonzero(flat >= 0)
        while len(open_):
            at, row = flat[open_], open_ // width
            above, below = self.doc[at] > high[row], self.doc[at] < low[row]
            moved = above | below
            open_, at, above = open_[moved], at[moved], above[moved]
            flat[open_] = np.where(above, self.left[at], self.right[at])
            open_ = open_[flat[open_] >= 0]
        return flat.reshape(nodes.shape)

    def top(self, queries: list[np.ndarray], k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, doc, score of the k best documents of each query (terms as numbers) that reach least; equal scores by doc."""
        found, width = (np.zeros(0, np.int64),) * 3, max(map(len, queries), default=0)
        if not width or not self.docs:
            return found
        terms = np.full((len(queries), width), self.terms, np.int64)  # that number has no treap
        for i, q in enumerate(queries):
            terms[i, : len(q)] = q
        floor, batch = np.maximum(least, 1), min(4096, max(16, WALK // width))
        query = np.arange(len(queries))
        nodes, low, high = self.roots[terms], np.zeros(len(query), np.int64), np.full(len(query), self.docs - 1)
        bound = self.most[nodes].sum(1)
        whole = np.maximum(bound, 1)
        while len(query):
            keep = bound >= floor[query]
            waiting = [x[keep] for x in (query, nodes, low, high, bound)]
            taken = [x[-batch:] for x in waiting]
            waiting = [x[:-batch] for x in waiting]
            query, nodes, low, high, _ = taken
            if not len(query):
                break
            at = np.argmax(self.most[nodes], 1)
            pivot = self.doc[nodes[np.arange(len(nodes)), at]]
            row, column = np.nonzero((nodes >= 0) & (self.doc[nodes] != pivot[:, None]))  # where another document is on top
            wanted = terms[query[row], column] * self.docs + pivot[row]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            score = np.where(self.doc[nodes] == pivot[:, None], self.impact[nodes], 0).sum(1)
            np.add.at(score, row, np.where(self.keys[place] == wanted, self.impact[place], 0))
            good = score >= floor[query]
            if good.any():
                found = tuple(np.concatenate([x, y[good]]) for x, y in zip(found, (query, pivot, score), strict=True))
                order = np.lexsort((found[1], -found[2], found[0]))
                found = tuple(x[order] for x in found)
                rank = np.arange(len(order)) - np.searchsorted(found[0], found[0])
                last = rank == k - 1
                floor[found[0][last]] = np.maximum(floor[found[0][last]], found[2][last])
                found = tuple(x[rank < k] for x in found)
            parts = []
            for a, b in ((low, pivot - 1), (pivot + 1, high)):
                below = self._topmost(nodes, a, b)
                bounds = self.most[below].sum(1)
                some = bounds >= floor[query]
                parts.append([x[some] for x in (query, below, a, b, bounds)])
            made = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.argsort(made[4] / whole[made[0]], kind="stable")  # the best are taken next
            query, nodes, low, high, bound = (np.concatenate([x, y[order]]) for x, y in zip(waiting, made, strict=True))
        return found


def _slices(queries: DataFrame, item_col: str, text_col: str, folder: str) -> list[str]:
    """Names of the files of query slices: a record batch of query (its row), item and distinct terms."""
    own = documents_of(queries, item_col, text_col).toDF("item_id", "text").withColumn("query", F.monotonically_increasing_id())
    schema = pa.schema([("query", pa.int64()), ("item", pa.int64()), ("terms", pa.list_(pa.binary()))])

    def store(batches):
        rows, terms, names = [], 0, []

        def close():
            name = uuid.uuid4().hex
            with Store(folder).write(name) as f, pa.ipc.new_stream(f, schema) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema))
            names.append(name)

        for batch in batches:
            for item, text, query in rows_of(batch):
                distinct = sorted(set(terms_of(text)))
                if not distinct:
                    continue
                if rows and (len(rows) >= SLICE_ITEMS or terms + len(distinct) > SLICE_TERMS):
                    close()
                    rows, terms = [], 0
                rows.append((query, item, distinct))
                terms += len(distinct)
        if rows:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    parts = max(1, -(-queries.count() // SLICE_ITEMS))
    return sorted(r.name for r in own.coalesce(parts).mapInArrow(store, "name string").collect())  # a row a slice


class Slice:
    """A stored slice of queries, as read by a task: its vocabulary and each query's terms as numbers of it."""

    def __init__(self, folder: str, name: str):
        with Store(folder).open(name) as f:
            table = pa.ipc.open_stream(f).read_all()
        self.queries, self.items = table.column("query").to_pylist(), table.column("item").to_pylist()
        lists = table.column("terms").to_pylist()
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for terms in lists for t in terms}))}
        self.terms = [np.array([self.vocabulary[t] for t in terms], np.int64) for terms in lists]


def _counted(docs: DataFrame, folder: str, name: str) -> DataFrame:
    """Rows of documents (doc_id, n, terms, times) and, where `total`, of a task's sums: documents, terms, and terms with document frequencies."""
    schema = pa.schema([("total", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def run(batches):
        number = Slice(folder, name).vocabulary
        frequency, docs, words = np.zeros(len(number), np.int64), 0, 0
        for batch in batches:
            out = Columns(schema)
            for doc_id, text in rows_of(batch):
                counts = Counter(terms_of(text))
                n = counts.total()
                if not n:
                    continue
                docs, words = docs + 1, words + n
                own = [(number[t], c) for t, c in counts.items() if t in number]
                if own:
                    terms, times = zip(*own, strict=True)
                    frequency[list(terms)] += 1
                    out.add(False, doc_id, n, terms, times)
            yield out.take()
        seen = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_pylist([{"total": True, "doc_id": docs, "n": words, "terms": seen, "times": frequency[seen]}], schema=schema)

    return scratch_table(docs.mapInArrow(run, "total boolean, doc_id long, n long, terms array<int>, times array<long>"), "lexical-counts")


def _best(counted: DataFrame, folder: str, name: str, weights: str, docs: int, words: int, postings: int, k: int) -> DataFrame:
    """query, item_id, doc_id, score: the k best of each task's documents for each query of the slice.

    Small parts of the stored counts are read together, up to a shard a task:
    the larger a shard, the more of it is never looked at.
    """
    schema = pa.schema([("query", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        own, weight_of = Slice(folder, name), np.frombuffer(Store(folder).read(weights), "<i8")
        best = tuple(np.zeros(0, np.int64) for _ in range(3))  # query, doc_id, score
        ids, lengths, terms, times, held = [], [], [], [], 0

        def search():
            nonlocal best, ids, lengths, terms, times, held
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            sizes = np.array([len(t) for t in terms], np.int64)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc, term = np.repeat(place, sizes), np.concatenate(terms).astype(np.int64)
            impact = impacts(weight_of[term], np.concatenate(times), np.repeat(np.array(lengths, np.int64), sizes), docs, words)
            sort = np.lexsort((doc, term))
            sort = sort[impact[sort] > 0]
            shard = Shard(term[sort], doc[sort], impact[sort], len(order), len(weight_of))
            by_id = np.array(ids, np.int64)[order]
            floor = np.zeros(len(own.terms), np.int64)
            full = np.bincount(best[0], minlength=len(floor)) == k
            np.minimum.at(low := np.full(len(floor), NO_ID), best[0], best[2])
            floor[full] = low[full]
            for start in range(0, len(own.terms), 64):
                q, d, s = shard.top(own.terms[start : start + 64], k, floor[start : start + 64])
                best = tuple(np.concatenate([x, y]) for x, y in zip(best, (q + start, by_id[d], s), strict=True))
            best = tuple(x[np.lexsort((best[1], -best[2], best[0]))] for x in best)
            rank = np.arange(len(best[0])) - np.searchsorted(best[0], best[0])
            best = tuple(x[rank < k] for x in best)
            ids, lengths, terms, times, held = [], [], [], [], 0

        for batch in batches:
            lists = [batch.column(i).combine_chunks() if isinstance(batch.column(i), pa.ChunkedArray) else batch.column(i) for i in (2, 3)]
            for i, (doc_id, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids.append(NO_ID if doc_id is None else doc_id)
                lengths.append(n)
                terms.append(lists[0][i].values.to_numpy())
                times.append(lists[1][i].values.to_numpy())
                held += len(terms[-1])
                if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                    search()
        if ids:
            search()
        doc_id = pa.array(best[1], pa.int64(), mask=best[1] == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(own.queries, np.int64)[best[0]], pa.int64()), pa.array([own.items[q] for q in best[0].tolist()], pa.int64()), doc_id, pa.array(best[2], pa.int64())], schema=schema)

    shards = max(1, -(-docs // SHARD_DOCS), -(-postings // SHARD_POSTINGS))
    return counted.where("not total").select("doc_id", "n", "terms", "times").coalesce(shards).mapInArrow(run, "query long, item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each query the k documents of the highest scores over 0. Runs jobs when called."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "lexical")
    found = None
    for name in _slices(queries, item_col, query_col, folder):
        counted = _counted(documents_of(docs, id_col, text_col), folder, name)
        sums = counted.where("total")
        totals = sums.agg(F.sum("doc_id").alias("docs"), F.sum("n").alias("words")).first()
        pairs = sums.select(F.explode(F.arrays_zip("terms", "times")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.times").alias("df"))
        weights, postings = np.zeros(len(Slice(folder, name).vocabulary), "<i8"), 0
        for r in pairs.toLocalIterator():  # a row a term of the slice at most
            weights[r.term] = weight(r.df, totals.docs)
            postings += r.df
        if not totals.words:
            break
        with Store(folder).write(f"{name}-weights") as f:
            f.write(weights.tobytes())
        part = _best(counted, folder, name, f"{name}-weights", totals.docs, totals.words, postings, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
