"""SimHash near-duplicates with BK-trees.

A fingerprint bit is set if it is set in over half of the shingles' XXH64
values. Equal fingerprints are merged first, so trees hold distinct ones.

Fingerprints within `radius` bits agree in one of radius + 1 blocks of bits;
each block's value names a shard. A shard's fingerprints go into a BK-tree,
whose children are keyed by their integer Hamming distance to the parent, and
a query follows only the edges within the radius of its own distance. Every
new fingerprint is first a query, then a node: the shard's links come out as
the edges of a spanning forest, at most one less than its fingerprints,
whatever the number of pairs.

A shard beyond `most` fingerprints is split again by the same argument: of the
bits outside its block, one of radius + 1 parts agrees. That is repeated for
parts that are still too large, four rounds at most. At radius 2 there are
then 14 free bits: no tree is larger than 2 ** 14, however dense the
fingerprints lie.

Components come from rounds of local union-find over dealt links, each round
written to the shared folder; no table of all links, components or
fingerprints is ever in one place.

Defined cases: rows with one doc_id are one document, which links by each of
its texts. Null text is empty; without words the fingerprint is zero and
links as any other; with fewer words than a shingle the whole sequence is one
shingle. Texts of any length are taken whole, and an empty table gives no
rows. Repeated rows give repeated results. A null doc_id is never a
component's id unless all members lack one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Columns, documents_of, keep_in_place, rows_of, scratch_table, slices_of
from .components import components

BITS = 64
_LOW = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from bit 0 on; eight counters to a word, emptied before they overflow."""
    out = np.zeros((8, 8), np.int64)
    for start in range(0, len(hashes), 255):
        part = hashes[start : start + 255]
        for k in range(8):
            out[k] += np.add.reduce((part >> np.uint64(k)) & _LOW).reshape(1).view(np.uint8)
    return out.T.reshape(-1)


_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    return int((_WEIGHTS[2 * bit_counts(hashes) > len(hashes)]).sum(dtype=np.uint64))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if width == 3:
        shingles = map(join, zip(words, words[1:], words[2:], strict=False))
    else:
        shingles = (join(words[i : i + width]) for i in range(len(words) - width + 1))
    return majority(np.fromiter((digest(s, seed) for s in shingles), np.uint64))


def fingerprints(df: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            out = Columns(schema)
            for doc_id, text in rows_of(batch):
                fp = fingerprint(text, width, seed)
                out.add(doc_id, fp - (fp >> 63 << 64))
            yield out.take()

    return documents_of(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Nodes by index; `below[i]` maps a distance to the child at it."""

    def __init__(self):
        self.values: list[int] = []
        self.below: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Values of the tree at most `radius` bits from value."""
        found, waiting, values, below = [], [0] if self.values else [], self.values, self.below
        while waiting:
            i = waiting.pop()
            d = (values[i] ^ value).bit_count()
            if d <= radius:
                found.append(values[i])
            children = below[i]
            if len(children) > 2 * radius + 1:
                waiting += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
            else:
                waiting += [j for k, j in children.items() if d - radius <= k <= d + radius]
        return found

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.below.append({})
            return
        i = 0
        while True:
            d = (self.values[i] ^ value).bit_count()
            if not d:
                return
            if d not in self.below[i]:
                self.below[i][d] = len(self.values)
                self.values.append(value)
                self.below.append({})
                return
            i = self.below[i][d]


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values within the radius of each other, by a BK-tree."""
    tree, group, links = BKTree(), {}, []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for v in values:
        group[v] = v
        for w in tree.within(v, radius):
            a, b = root(v), root(w)
            if a != b:
                group[a] = b
                links.append((v, w))
        tree.add(v)
    return links


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    """The bit positions in `parts` lists of near-equal length."""
    return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]


def _masked(bits: list[int]):
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("long"))


def _levels(radius: int, bits: list[int], depth: int) -> list[tuple[str, list[int]]]:
    """Names and bits of the shards of one level, given the bits that no level above has fixed."""
    return [(f"{depth}.{i}", part) for i, part in enumerate(_blocks(bits, radius + 1))]


def _rounds(radius: int, most: int) -> int:
    """Splits after which the free bits tell at most `most` fingerprints apart, four at most."""
    free, n = BITS, 0
    while 2**free > most and n < 4:
        free, n = free - max(1, free // (radius + 1)), n + 1
    return max(1, n)


def links(distinct: DataFrame, radius: int, most: int = 20_000) -> DataFrame:
    """a, b: links between the nodes of distinct fingerprints (columns fp, node) that connect all within the radius."""
    spark = distinct.sparkSession
    # rows: fp, node, path (the blocks fixed so far, by name), key (their bits' values)
    open_rows = distinct.select("fp", "node", F.lit("").alias("path"), F.lit(0).cast("long").alias("key"))
    fixed: dict[str, list[int]] = {"": []}
    ready = []
    depth = _rounds(radius, most)
    for level in range(depth):
        after, branches = {}, []
        for path, bits in fixed.items():
            free = [b for b in range(BITS) if b not in set(bits)]
            for name, part in _levels(radius, free, level):
                after[f"{path}/{name}"] = bits + part
                branches.append((path, f"{path}/{name}", bits + part))
        shard = F.explode(F.array(*(F.when(F.col("path") == p, F.struct(F.lit(q).alias("path"), _masked(bits).alias("key"))) for p, q, bits in branches)))
        rows = open_rows.select("fp", "node", shard.alias("s")).where("s is not null").select("fp", "node", "s.path", "s.key")
        if level == depth - 1:
            ready.append(rows)
            break
        # shards that are too large: each has over `most` rows, so they are few beside the rows
        large = rows.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("path", "key")
        large = scratch_table(large, "simhash-large")
        if not large.head(1):
            ready.append(rows)
            break
        ready.append(rows.join(large, ["path", "key"], "left_anti"))
        open_rows = rows.join(large, ["path", "key"], "left_semi").select("fp", "node", "path", "key")
        fixed = after
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    every = every.select("fp", "node", "path", "key")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        at, held = None, {}

        def close():
            if len(held) > 1:
                for v, w in forest(list(held), radius):
                    out.add(held[v], held[w])

        out = Columns(schema)
        for batch in batches:
            for fp, node, path, key in rows_of(batch):
                if (path, key) != at:
                    close()
                    at, held = (path, key), {}
                held[fp & ((1 << 64) - 1)] = node
                if len(out) > 10_000:
                    yield out.take()
        close()
        yield out.take()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(n, "path", "key").sortWithinPartitions("path", "key", "fp").mapInArrow(run, "a long, b long")


#: Nodes of fingerprints whose documents all lack an id: above any other, so that they name no component with ids in it.
NAMELESS = 1 << 62


def classes(own: DataFrame, radius: int) -> DataFrame:
    """fp, component_id for each distinct fp of own (doc_id, fp). A fingerprint's node is its smallest doc_id, so a component's smallest node is its id."""
    node = F.coalesce(F.min("doc_id"), F.lit(NAMELESS) + F.shiftrightunsigned(F.first("fp"), 2))
    distinct = scratch_table(own.groupBy("fp").agg(node.alias("node")), "simhash-distinct")
    found = components(links(distinct, radius)).withColumnRenamed("node", "member")
    root = F.coalesce("root", "node")
    return distinct.join(found, distinct.node == found.member, "left").select("fp", F.when(root < NAMELESS, root).alias("component_id"))


def near_duplicates(df: DataFrame, radius: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links reach)."""
    own = scratch_table(fingerprints(df, width, seed, id_col, text_col), "simhash")
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(classes(own, radius), "fp").select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, radius: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, one of each component: the smallest doc_id's; of repeated rows one; where a component has no ids, one row a fingerprint."""
    id_at, text_at, names = df.columns.index(id_col), df.columns.index(text_col), df.columns
    plain = [f"c{i}" for i in range(len(names))]
    inner = df.toDF(*plain).withColumn("row", F.monotonically_increasing_id())
    fields = T.StructType([*inner.schema.fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in (part for b in batches for part in slices_of(b)):
            found = (fingerprint(t.encode("utf-8") if t else b"", width, seed) for t in batch.column(text_at).to_pylist())
            fp = pa.array([x - (x >> 63 << 64) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], names=[*batch.schema.names, "fp"])

    rows = scratch_table(inner.mapInArrow(run, fields), "simhash-rows")
    own = rows.select(F.col(f"c{id_at}").cast("long").alias("doc_id"), "fp", "row")
    named = own.join(classes(own, radius), "fp")
    # the smallest row of each component, by (doc_id, row); ids that are null come last
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = named.groupBy(F.coalesce("component_id", F.col("fp")).alias("of"), F.col("component_id").isNull().alias("nameless")).agg(F.min(order).alias("best"))
    kept = best.select(F.col("best.row").alias("row"))
    return keep_in_place(rows, kept, "row", "simhash-kept").select(*plain).toDF(*names)
