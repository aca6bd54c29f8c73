"""MinHash near-duplicates: minima of many universal hashes, bands, verified signatures, exact links.

A document's set holds its distinct shingles of `width` words, A-Z lowered
(hashes of 64 bits). Documents with equal sets are merged first, by a hash of
128 bits. A signature holds, for each of `bands` x `rows` hash functions
(a x + b mod 2 ** 64, upper half), the least value over the set; documents
whose `rows` minima of a band agree share a bucket. `plan` picks both numbers
so that a pair at exactly the asked similarity misses all buckets with a
probability under 1e-6. Of two documents in a bucket the signatures are
compared first: a pair is passed over if five standard deviations fewer minima
agree than the similarity makes expect (a loss of some 3e-7 at the similarity
itself, less above). What is left is confirmed on the full sets.

A bucket may hold a third of all documents, so its pairs are never made.

1. Each bucket's members are held against its representative, the member with
   the most company in all its buckets: of an original and its edited copies
   that is the original. That is one pair a member.
2. Links become components (stars.py).
3. A bucket that is all one component is done. Where one isn't, members
   outside the representative's component are held against all others of
   another component, block by block of BLOCK members, a task holding two
   blocks of signatures; it reads the few full sets it needs from the shared
   folder and emits only links that join something new. So no link between
   different components is lost, however large the bucket.

Sets are stored once, in files of the shared folder, for documents with a
bucket of two or more; texts are never shuffled.

Defined cases: null text is empty; with no words the set is empty and linked
with nothing; with fewer words than `width` the whole sequence is the one
shingle. Sets so small that no other set can be as similar as asked have no
buckets. Texts of any length are taken whole. Every row is a document of its
own: rows with one doc_id, and repeated rows, give a row each. A component's
id is the smallest doc_id of its rows, null where all lack one; a row without
an id is kept only there. Empty tables give empty results. Only the two
columns named are read, whatever the others are called.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Columns, Store, Told, documents_of, keep_in_place, rows_of, scratch_path, scratch_table, slices_of, words_of
from .stars import alternating

#: Members of a block in step 3.
BLOCK = 1000
#: Bytes of sets that a task keeps at hand.
CACHE = 64 << 20
_MOST = 512
_draw = np.random.default_rng(11)
_A = _draw.integers(0, 1 << 63, _MOST, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, _MOST, np.uint64) * np.uint64(2)


def plan(similarity: float) -> tuple[int, int, int]:
    """Bands, rows of a band, and how many minima must agree for a pair to be confirmed."""
    rows = max(1, round(math.log(0.35) / math.log(similarity)))
    bands = math.ceil(math.log(1e-6) / math.log1p(-(similarity**rows)))
    n = bands * rows
    if n > _MOST:
        raise ValueError(f"no plan of {_MOST} minima for a similarity of {similarity}")
    return bands, rows, math.floor(n * similarity - 5 * math.sqrt(n * similarity * (1 - similarity)))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of fewer words one hash of all."""
    words = words_of(text.lower())[0]
    if not len(words):
        return words
    k = min(width, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(found: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n universal hash functions over a set."""
    x, least = (found >> np.uint64(32))[:, None], np.full(n, (1 << 64) - 1, np.uint64)
    a, b = _A[:n], _B[:n]
    for start in range(0, len(x), 256):
        np.minimum(least, (x[start : start + 256] * a + b).min(0), out=least)
    return least >> np.uint64(32)


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    h = np.arange(bands, dtype=np.uint64)
    for part in least.reshape(bands, -1).T:
        h = (h ^ part) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Sets:
    """Sets in files of the shared folder, the last ones read kept at hand."""

    def __init__(self, folder: str):
        self.store, self.held, self.bytes, self.files = Store(folder), OrderedDict(), 0, OrderedDict()

    def get(self, file: str, at: int, size: int) -> np.ndarray:
        key = (file, at)
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        if file not in self.files:
            self.files[file] = self.store.open(file)
            if len(self.files) > 32:
                self.files.popitem(last=False)[1].close()
        found = np.frombuffer(self.files[file].read_at(size, at), "<u8")
        self.held[key] = found
        self.bytes += size
        while self.bytes > CACHE and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1].nbytes
        return found


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least.denominator * both >= least.numerator * (len(a) + len(b) - both)


def smallest(least: Fraction) -> float:
    """Shingles of the smallest set that another one can be as similar to as asked."""
    return math.ceil(least / (1 - least)) if least < 1 else math.inf


def _signed(df: DataFrame, width: int, bands: int, n: int, least: Fraction) -> DataFrame:
    """Each row with its text, set size, the set's key, and of sets that may have a partner the band keys and signature."""
    enough = smallest(least)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        for batch in (part for b in batches for part in slices_of(b)):
            sizes, keys, lists, signatures = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, width)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                if len(found) >= enough:
                    minimum = minima(found, n)
                    lists.append(band_keys(minimum, bands))
                    signatures.append(minimum.astype(np.uint8).tobytes())
                else:
                    lists.append(None)
                    signatures.append(None)
            columns = [batch.column(2), batch.column(0), batch.column(1), *(pa.array(x, f.type) for x, f in zip((sizes, keys, lists, signatures), list(schema)[3:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    numbered = df.withColumn("row", F.monotonically_increasing_id())
    return scratch_table(numbered.mapInArrow(run, "row long, doc_id long, text binary, n long, key binary, bands array<long>, sig binary"), "minhash-rows")


def _stored(rows: DataFrame, wanted: DataFrame, width: int, folder: str) -> DataFrame:
    """node, n, sig and the place of the set for the wanted rows, whose sets are written to the folder."""
    told = Told(wanted.select("row", F.lit(1).alias("value")), "minhash-wanted")
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("file", pa.string()), ("at", pa.int64())])

    def run(batches):
        look, name, at = told.reader(), uuid.uuid4().hex, 0
        with Store(folder).write(name) as f:
            for batch in batches:
                out = Columns(schema)
                for row, n, sig, text in rows_of(batch.filter(pa.array(look(batch.column(0).to_numpy())[0]))):
                    found = shingle_set(text, width).astype("<u8").tobytes()
                    f.write(found)
                    out.add(row, n, sig, name, at)
                    at += len(found)
                yield out.take()

    return scratch_table(rows.select("row", "n", "sig", "text").mapInArrow(run, "node long, n long, sig binary, file string, at long"), "minhash-sets")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _star_links(pairs: DataFrame, info: DataFrame, folder: str, bound: int, least: Fraction) -> DataFrame:
    """a, b: the pairs (node, rep) whose sets are as similar as asked."""
    other = info.toDF("rep", "rep_n", "rep_sig", "rep_file", "rep_at")
    near = F.least("n", "rep_n") * least.denominator >= F.greatest("n", "rep_n") * least.numerator
    both = pairs.join(info, "node").join(other, "rep").where(near).select("node", "n", "sig", "file", "at", "rep", "rep_n", "rep_sig", "rep_file", "rep_at")

    def run(batches):
        sets = Sets(folder)
        for batch in batches:
            out = Columns(_LINKS)
            for a, n, sig, file, at, b, m, other_sig, other_file, other_at in rows_of(batch):
                if np.count_nonzero(np.frombuffer(sig, np.uint8) == np.frombuffer(other_sig, np.uint8)) >= bound and similar(sets.get(file, at, 8 * n), sets.get(other_file, other_at, 8 * m), least):
                    out.add(a, b)
            yield out.take()

    return both.mapInArrow(run, "a long, b long")


def block_links(members: list[tuple], folder_sets: Sets, bound: int, least: Fraction) -> list[tuple[int, int]]:
    """Links that join components, of the members (side, node, root, n, sig, file, at) of two blocks, or of one with another member of it."""
    alone = len({m[0] for m in members}) < 2
    left = members if alone else [m for m in members if m[0] == members[0][0]]
    right = members if alone else [m for m in members if m[0] != members[0][0]]
    known: dict[int, int] = {}

    def root(x: int) -> int:
        while known.get(x, x) != x:
            known[x] = known.get(known[x], known[x])
            x = known[x]
        return x

    sizes, roots = np.array([m[3] for m in right], np.int64), np.array([m[2] for m in right], np.int64)
    signs = np.frombuffer(b"".join(m[4] for m in right), np.uint8).reshape(len(right), -1)
    links = []
    for i, (_, a, of, n, sig, file, at) in enumerate(left):
        start = i + 1 if alone else 0
        agree = np.count_nonzero(signs[start:] == np.frombuffer(sig, np.uint8), axis=1)
        may = (agree >= bound) & (roots[start:] != of) & (np.minimum(sizes[start:], n) * least.denominator >= np.maximum(sizes[start:], n) * least.numerator)
        for j in (np.flatnonzero(may) + start).tolist():
            _, b, other, m, _, other_file, other_at = right[j]
            x, y = root(of), root(other)
            if x != y and similar(folder_sets.get(file, at, 8 * n), folder_sets.get(other_file, other_at, 8 * m), least):
                known[x] = y
                links.append((a, b))
    return links


def _block_links(members: DataFrame, reps: DataFrame, found: DataFrame, info: DataFrame, folder: str, bound: int, least: Fraction) -> DataFrame | None:
    """a, b: the links between components that the stars around representatives don't show; None where every bucket is settled."""
    rooted = scratch_table(members.select("band", "node").join(found.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-rooted")
    buckets = rooted.groupBy("band").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"))
    # buckets with the same members are one
    unsettled = buckets.where("low < high and c > 2").groupBy("c", "x").agg(F.min("band").alias("band")).select("band")
    main = rooted.join(reps, "band").where("node = rep").select("band", F.col("root").alias("main"))
    own = rooted.join(unsettled, "band").join(main, "band").withColumn("outside", F.col("root") != F.col("main"))
    own = scratch_table(own.select("band", "node", "root", "outside"), "minhash-unsettled")
    if not own.head(1):
        return None
    blocks = own.groupBy("band").agg(F.ceil(F.count_if("outside") / BLOCK).cast("int").alias("out"), F.ceil(F.count_if(~F.col("outside")) / BLOCK).cast("int").alias("ins"))
    hashed, last = F.xxhash64("node"), F.col("out") + F.col("ins") - 1
    side = F.when(F.col("outside"), F.pmod(hashed, F.col("out"))).otherwise(F.col("out") + F.pmod(hashed, F.col("ins"))).cast("int")
    # members outside meet every block, the others the blocks of members outside; blocks of one bucket are numbered with those outside first
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("outside"), last).otherwise(F.col("out") - 1)))
    dealt = own.join(blocks, "band").where("out > 0").withColumn("side", side).withColumn("other", others)
    dealt = dealt.select("band", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "root")
    dealt = dealt.join(info, "node").select("band", "low", "high", "side", "node", "root", "n", "sig", "file", "at")

    def run(batches):
        sets, key, held = Sets(folder), None, []
        for batch in batches:
            out = Columns(_LINKS)
            for band, low, high, *member in rows_of(batch):
                if (band, low, high) != key:
                    for a, b in block_links(held, sets, bound, least) if len(held) > 1 else ():
                        out.add(a, b)
                    key, held = (band, low, high), []
                held.append(tuple(member))
            yield out.take()
        out = Columns(_LINKS)
        for a, b in block_links(held, sets, bound, least) if len(held) > 1 else ():
            out.add(a, b)
        yield out.take()

    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "band", "low", "high").sortWithinPartitions("band", "low", "high", "side", "node").mapInArrow(run, "a long, b long")


def connected(rows: DataFrame, banded: DataFrame, width: int, bound: int, least: Fraction) -> DataFrame:
    """u, v: each row whose set is linked to others' but isn't its component's first, and that first one.

    rows: row, n, sig, text (binary) of all; banded: the buckets, band and node (a row). Only these are compared.
    """
    counts = banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    members = scratch_table(banded.join(counts, "band").select("band", "node", "c"), "minhash-members")
    folder = scratch_path(rows.sparkSession, "minhash-set-files")
    info = _stored(rows, members.select(F.col("node").alias("row")).distinct(), width, folder)
    company = members.groupBy("node").agg(F.sum("c").alias("company"))
    reps = scratch_table(members.join(company, "node").groupBy("band").agg(F.max_by("node", "company").alias("rep")), "minhash-representatives")
    pairs = members.join(reps, "band").where("node <> rep").select("node", "rep").distinct()
    found = alternating(_star_links(pairs, info, folder, bound, least))
    more = _block_links(members, reps, found, info, folder, bound, least)
    return found if more is None else alternating(found.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more))


def near_duplicates(df: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept, a row a row of df. Runs jobs when called."""
    least = Fraction(str(similarity))
    bands, per_band, bound = plan(similarity)
    rows = _signed(documents_of(df, id_col, text_col), width, bands, bands * per_band, least)
    own = rows.select("doc_id", "n", "key", "row")
    distinct = scratch_table(own.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "minhash-distinct")
    signed = keep_in_place(rows.select("row", "bands"), distinct.select(F.col("node").alias("row")), "row", "minhash-distinct-rows")
    found = connected(rows, signed.select(F.explode("bands").alias("band"), F.col("row").alias("node")), width, bound, least)
    classes = distinct.join(found.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = classes.join(named, "root").select("key", "component_id")
    linked = own.where("n > 0").join(of_key, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    every = linked.unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
