"""Packing by Karmarkar-Karp multiway differencing.

A document's ids fill whole sequences first; what is left (less than a
sequence) waits in a block. A block's rests become near-equal windows: each
rest starts as a partial partition with one used window, and the two partial
partitions with the largest spread are merged with opposing imbalances, the
fullest window of one on the emptiest of the other, until one is left. Where a
window exceeds the capacity, the window count rises; or, with `cut`, it rises
to the least count that holds the tokens and the excess of a window is cut off
its last rests and moved into the room of others, so that a block pads less
than one sequence.

Blocks form within a partition of the input as it is read: nothing is
shuffled, a task holds one block, and a lost task gives the same rows again.
A sequence's id is the partition's number in the upper bits and a counter in
the lower, so ids are unique, not dense.

Defined cases: null text is empty and packs the end id alone. Repeated rows
are packed once each, in the order in which they are read, whether ids are
equal, null or neither; of equal sizes the one read first comes first. Texts
of any length stream out in whole sequences. An empty table gives no pieces.
Only the two columns named are read, whatever the others are called.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Columns, documents_of, rows_of
from .encoding import by_size, encoder


def differencing(sizes: list[int], windows: int) -> list[int]:
    """The window of each item, the sums near-equal."""
    if windows <= 1:
        return [0] * len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, i, sums, i))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, tree_a = heapq.heappop(heap)
        _, _, b, tree_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]  # only the differences matter
        heapq.heappush(heap, (-int(sums[0]), tie, sums, (tree_a, tree_b, order)))
        tie += 1
    found = [0] * len(sizes)
    waiting = [(heap[0][3], np.arange(windows))] if heap else []
    while waiting:
        tree, slots = waiting.pop()
        if isinstance(tree, int):
            found[tree] = int(slots[0])
            continue
        a, b, order = tree
        before = np.empty_like(slots)
        before[order] = slots
        waiting += [(a, before), (b, before[::-1])]
    return found


def windows_of(sizes: list[int], capacity: int, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in it, length), none above the capacity."""
    total = sum(sizes)
    count = max(1, -(-total // capacity))
    while True:
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
        for i, w in enumerate(differencing(sizes, count)):
            found[w].append((i, 0, sizes[i]))
        over = max(sum(x[2] for x in w) for w in found)
        if over <= capacity or cut:
            break
        count += 1
    if over > capacity:
        loose = []
        for w in found:
            excess = sum(x[2] for x in w) - capacity
            while excess > 0:
                i, start, n = w.pop()
                if n > excess:
                    w.append((i, start, n - excess))
                loose.append((i, start + max(0, n - excess), min(n, excess)))
                excess -= min(n, excess)
        for w in sorted(found, key=lambda w: sum(x[2] for x in w)):
            room = capacity - sum(x[2] for x in w)
            while room and loose:
                i, start, n = loose.pop()
                w.append((i, start, min(n, room)))
                if n > room:
                    loose.append((i, start + room, n - room))
                room -= min(n, room)
    return [w for w in found if w]


def pack(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, block: int = 128, cut: bool = True, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with with_ids, the ids too.

    `block`: windows differenced together.
    """
    kinds = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.uint32()))] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        own, serial = encoder(tokenizer), TaskContext.get().partitionId() << 33
        rests: list[tuple] = []
        held = 0
        out = Columns(schema)

        def piece(doc_id, start, ids, whole, sequence, offset):
            out.add(doc_id, start, len(ids) // 4, zlib.crc32(ids), whole, sequence, offset, *([np.frombuffer(ids, "<u4")] if with_ids else []))

        def flush(serial):
            for window in windows_of([len(r[2]) // 4 for r in rests], capacity, cut):
                offset = 0
                for i, start, n in window:
                    doc_id, first, ids, whole = rests[i]
                    piece(doc_id, first + start, ids[4 * start : 4 * (start + n)], whole, serial, offset)
                    offset += n
                serial += 1
            return serial

        for batch in batches:
            for rows in by_size(rows_of(batch)):
                for (doc_id, _), ids in zip(rows, own.encode([t for _, t in rows]), strict=True):
                    ids += end
                    whole = len(ids) // 4
                    full = whole - whole % capacity
                    for start in range(0, full, capacity):
                        piece(doc_id, start, ids[4 * start : 4 * (start + capacity)], whole, serial, 0)
                        serial += 1
                    if full < whole:
                        rests.append((doc_id, full, ids[4 * full :], whole))
                        held += whole - full
                    if held >= block * capacity:
                        serial = flush(serial)
                        rests.clear()
                        held = 0
                yield out.take()
        if rests:
            flush(serial)
            yield out.take()

    spark_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    if with_ids:
        schema = schema.set(7, pa.field("ids", pa.list_(pa.int64())))
    return documents_of(df, id_col, text_col).mapInArrow(run, spark_schema)
