"""Quality rules and n-gram perplexity.

The language model is a modified Kneser-Ney trigram over the characters of
words. Spark counts the trigrams of all reference texts; every code point that
they have is a symbol of its own, white space stands for the word's edge, and
code points that none of them has are CLASSES symbols without counts. Nothing
bounds the alphabet. What is sent to the workers is bounded by `sent`
trigrams, as sorted arrays of 64-bit hashes with a log-probability (trigrams,
bigrams) and a back-off weight (contexts) beside each hash, read by binary
search. A larger model stays in tables: its probabilities are made by joins,
only the `sent` most frequent trigrams go to the workers, and a document asks
for its others by a join on the trigram. Trigrams that are asked for most are
joined by a broadcast, so none makes a task large. Both ways give the same
probabilities; `sent` changes where they are looked up, never what they are.

The model's reference text is every document of at least 50 words with at most
`symbol_share` of the contract's symbols a word and at most `upper_share` of
its ASCII letters in upper case: junk must not teach the model what junk looks
like. All documents are read and all are scored.

A document's perplexity is 10 ** (-log10 probability / symbols). Each language
has a band around its own documents: below the lower or above the upper bound
of the logarithm, a document is rejected. The bounds are Tukey fences,
`reach` times the distance between the quartiles. A language's quartiles are
drawn towards those of all documents by the weight of `prior` documents: a
language gains its own band gradually as it grows. Quartiles are read from
exact counts by steps of a ten-thousandth of the logarithm, so they don't
depend on how the table is dealt.

Defined cases: null text has no words, fails the base rules and has a null
perplexity; a null language is a language of its own. Repeated rows give
repeated results; ties of the quartiles go to the lower step. A very long text
is scored whole, by one task. An empty table gives no rows. Bytes that aren't
UTF-8 count as U+FFFD. Columns are handed on under any name but those that are
added.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, Columns, rows_of, scratch_table
from .encoding import by_size

#: Fixed by the contract: the symbols that count.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
#: White space, which no word holds, so that these stand for no code point of a word.
EDGE, *OTHERS = map(chr, (32, 9, 10, 11, 12, 13))
#: Symbols for code points that the model has not seen.
CLASSES = len(OTHERS)
#: Trigrams that are sent to the workers, at most.
SENT = 1 << 20


def other(code: int) -> str:
    """The class of a code point."""
    return OTHERS[(code * 40503 >> 8) % CLASSES]


class _Symbols(dict):
    """Numbers of the symbols; a code point that the model has not seen has its class's."""

    def __missing__(self, c: str) -> int:
        n = self[c] = self[other(ord(c))]
        return n


def hashed(codes: np.ndarray) -> np.ndarray:
    """Mixes n-gram codes to 64-bit hashes, one to one."""
    x = codes.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass
class Trigrams:
    """The model; the hash arrays are sorted."""

    symbols: dict[str, int]
    tri: tuple[np.ndarray, np.ndarray]  # hash, log10 probability
    bi: tuple[np.ndarray, np.ndarray]
    uni: np.ndarray  # log10 probability by symbol
    weight2: tuple[np.ndarray, np.ndarray]  # contexts of two symbols: hash, log10 back-off
    weight1: np.ndarray

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words, each between edges (two before, one after), and where each word's predicted symbols begin."""
        flat = np.array(list(map(self.symbols.__getitem__, "".join(f"{EDGE}{EDGE}{w}{EDGE}" for w in words))), np.int64)
        return flat, np.cumsum([0] + [len(w) + 3 for w in words])

    def log10(self, words: list[str]) -> np.ndarray:
        """log10 probability of each word, its end included."""
        if not words:
            return np.zeros(0)
        flat, starts = self.codes(words)
        n = len(self.uni)
        a, b, c = flat[:-2], flat[1:-1], flat[2:]
        found = _look(self.tri, (a * n + b) * n + c, np.nan)
        miss = np.flatnonzero(np.isnan(found))
        if len(miss):
            a, b, c = a[miss], b[miss], c[miss]
            low = _look(self.bi, b * n + c, np.nan)
            low = np.where(np.isnan(low), self.weight1[b] + self.uni[c], low)
            found[miss] = _look(self.weight2, a * n + b, 0.0) + low
        sums = np.concatenate([[0.0], np.cumsum(found)])
        return sums[starts[1:] - 2] - sums[starts[:-1]]

    def scores(self, words: list[str]) -> tuple[np.ndarray, dict[int, list[str]]]:
        return self.log10(words), {}


@dataclass
class Frequent:
    """The most frequent trigrams of a model that isn't sent whole, and where the whole is."""

    known: tuple[np.ndarray, np.ndarray]  # hash, log10 probability
    tables: tuple[DataFrame, ...]  # not sent
    unseen: float  # log10 probability of a symbol without counts

    def __getstate__(self):
        return self.__dict__ | {"tables": ()}

    def scores(self, words: list[str]) -> tuple[np.ndarray, dict[int, list[str]]]:
        """The summed log10 of each word's trigrams that are here, and the other trigrams of the words that have some."""
        if not words:
            return np.zeros(0), {}
        text = "".join(f"{EDGE}{EDGE}{w}{EDGE}" for w in words)
        starts = np.cumsum([0] + [len(w) + 3 for w in words])
        found = _look(self.known, gram_codes(text), np.nan)
        gone = np.isnan(found)
        found[gone] = 0
        sums = np.concatenate([[0.0], np.cumsum(found)])
        across = np.concatenate([starts[1:-1] - 2, starts[1:-1] - 1])  # trigrams of two words
        gone[across] = False
        lost: dict[int, list[str]] = {}
        gone = np.flatnonzero(gone)
        for i, k in zip(gone.tolist(), (np.searchsorted(starts, gone, "right") - 1).tolist(), strict=True):
            lost.setdefault(k, []).append(text[i : i + 3])
        return sums[starts[1:] - 2] - sums[starts[:-1]], lost


def gram_codes(text: str) -> np.ndarray:
    """A number for each three neighbouring characters: their code points, 21 bits each."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _look(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray, default: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(codes), default)
    h = hashed(codes)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], default)


def _sorted(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = hashed(codes)
    order = np.argsort(h)
    return h[order], values[order]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney: the discount of a count of 0, 1, 2, 3 and more, from how many n-grams have 1 to 4; fixed ones where the data give none."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 0.95, 1.9, 2.85])


def _level(context: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Discounted probability of each n-gram, and each context's back-off weight (1 for unseen contexts)."""
    d = _discounts(*(int((counts == k).sum()) for k in (1, 2, 3, 4)))[np.minimum(counts, 3)]
    total = np.bincount(context, counts, size)
    return np.maximum(counts - d, 0) / total[context], np.where(total > 0, np.bincount(context, d, size) / np.maximum(total, 1e-300), 1.0)


def estimate(rows: list[tuple[str, int]], letters: list[str]) -> Trigrams:
    """The model from the trigrams' counts, whose symbols are EDGE, OTHERS and the letters."""
    symbols = _Symbols({s: i for i, s in enumerate([EDGE, *OTHERS, *letters])})
    n = len(symbols)
    parts = np.array([[symbols[c] for c in g] for g, _ in rows], np.int64).reshape(-1, 3)
    counts = np.array([c for _, c in rows], np.int64)
    a, b, c = parts.T
    # lower orders count in how many different contexts an n-gram occurs
    pairs, types2 = np.unique(b * n + c, return_counts=True)
    types1 = np.bincount(pairs % n, minlength=n)
    seen = np.flatnonzero(types1)
    p1, rest1 = _level(np.zeros(len(seen), np.int64), types1[seen], 1)
    uni = np.full(n, rest1[0] / n)
    uni[seen] += p1
    p2, rest2 = _level(pairs // n, types2, n)
    p2 = p2 + rest2[pairs // n] * uni[pairs % n]
    lower = dict(zip(pairs.tolist(), p2.tolist(), strict=True))
    contexts, at = np.unique(a * n + b, return_inverse=True)
    p3, rest3 = _level(at, counts, len(contexts))
    p3 = p3 + rest3[at] * np.array([lower[x] for x in (b * n + c).tolist()])
    log = lambda x: np.log10(np.maximum(x, 1e-30))
    return Trigrams(symbols, _sorted((a * n + b) * n + c, log(p3)), _sorted(pairs, log(p2)), log(uni), _sorted(contexts, log(rest3)), log(rest2))


def is_reference(text: bytes, words: int, symbol_share: float, upper_share: float) -> bool:
    upper = len(text) - len(text.translate(None, _UPPER))
    letters = upper + len(text) - len(text.translate(None, _UPPER.lower()))
    return words >= 50 and len(text) - len(text.translate(None, SYMBOLS)) <= symbol_share * words and upper <= upper_share * letters


def count_trigrams(df: DataFrame, sent: int = SENT, text_col: str = "text", symbol_share: float = 0.1, upper_share: float = 0.3) -> Trigrams | Frequent:
    """Counts over all reference texts and estimates; at most `sent` trigrams reach the driver."""
    words = df.select(F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        def grams(counts):
            found: Counter = Counter()
            for word, k in counts.items():
                w = f"{EDGE}{EDGE}{word.decode('utf-8', 'replace')}{EDGE}"
                for i in range(len(w) - 2):
                    found[w[i : i + 3]] += k
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for (text,) in rows_of(batch):
                words = text.split()
                if is_reference(text, len(words), symbol_share, upper_share):
                    counts.update(words)
                if len(counts) > 100_000:
                    yield grams(counts)
                    counts = Counter()
        yield grams(counts)

    summed = scratch_table(words.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "trigrams")
    if summed.count() > sent:
        return in_tables(summed, sent)
    rows = [(r.gram, r.n) for r in summed.toLocalIterator()]  # at most `sent`
    return estimate(rows, sorted({g[2] for g, _ in rows} - {EDGE}))


def _order(grams: DataFrame, k: int, under: DataFrame | float) -> tuple[DataFrame, DataFrame]:
    """gram, n, p of the n-grams of order k, as `_level` and `estimate` have them, and context, rest; under: gram, p of the order below, or one probability for all."""
    times = dict(grams.where("n <= 4").groupBy("n").count().collect())
    d = F.array(*map(F.lit, _discounts(*(times.get(i, 0) for i in (1, 2, 3, 4))).tolist()))[F.least("n", F.lit(3)).cast("int")]
    own = grams.select("gram", "n", d.alias("d"), F.substring("gram", 1, k - 1).alias("context"))
    by = scratch_table(own.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("rest")), "contexts")
    joined = own.join(by, "context")
    if isinstance(under, DataFrame):
        joined = joined.withColumn("low", F.substring("gram", 2, k - 1)).join(under.select(F.col("gram").alias("low"), F.col("p").alias("under")), "low")
    else:
        joined = joined.withColumn("under", F.lit(under))
    p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("under")
    return scratch_table(joined.select("gram", "n", p.alias("p")), "order"), by.select("context", "rest")


def _log(p):
    return F.log10(F.greatest(p, F.lit(1e-30)))


def in_tables(summed: DataFrame, sent: int) -> Frequent:
    """The same model by joins. A symbol or pair has at most as many neighbours as there are code points, so no key is large."""
    pairs = scratch_table(summed.groupBy(F.substring("gram", 2, 2).alias("gram")).agg(F.count("*").alias("n")), "pairs")
    singles = scratch_table(pairs.groupBy(F.substring("gram", 2, 1).alias("gram")).agg(F.count("*").alias("n")), "singles")
    symbols = singles.count() + CLASSES  # the edge is among them
    p1, rest1 = _order(singles, 1, 1 / symbols)
    p2, rest2 = _order(pairs, 2, p1)
    p3, rest3 = _order(summed, 3, p2)
    # the most frequent by steps of their count, so that nothing is sorted
    step = F.floor(16 * F.log2("n"))
    steps = sorted(p3.groupBy(step).count().collect(), reverse=True)
    least = [s for (s, _), total in zip(steps, np.cumsum([c for _, c in steps]), strict=True) if total <= sent]
    top = p3.where(step >= least[-1]) if least else p3.where("false")
    rows = [(r.gram, r.log) for r in top.select("gram", _log(F.col("p")).alias("log")).toLocalIterator()]  # at most `sent`
    known = _sorted(gram_codes("".join(g for g, _ in rows))[::3], np.array([x for _, x in rows])) if rows else (np.zeros(0, np.uint64), np.zeros(0))
    return Frequent(known, (p3, rest3, p2, rest2, p1), float(np.log10(max(rest1.first().rest / symbols, 1e-30))))


def asked_for(table: DataFrame, model: Frequent) -> DataFrame:
    """row, log_rest: the summed log10 of the trigrams in the column asked (array of gram, times), for the rows that ask."""
    p3, rest3, p2, rest2, p1 = model.tables
    asked = table.select("row", F.inline("asked"))
    # symbols are no more than there are code points: they are sent
    logs = (
        asked.groupBy("gram").agg(F.count("*").alias("rows"))
        .join(p3.select("gram", _log(F.col("p")).alias("l3")), "gram", "left")
        .withColumns({"ab": F.substring("gram", 1, 2), "bc": F.substring("gram", 2, 2), "b": F.substring("gram", 2, 1), "c": F.substring("gram", 3, 1)})
        .join(rest3.select(F.col("context").alias("ab"), _log(F.col("rest")).alias("w3")), "ab", "left")
        .join(p2.select(F.col("gram").alias("bc"), _log(F.col("p")).alias("l2")), "bc", "left")
        .join(F.broadcast(rest2.select(F.col("context").alias("b"), _log(F.col("rest")).alias("w2"))), "b", "left")
        .join(F.broadcast(p1.select(F.col("gram").alias("c"), _log(F.col("p")).alias("l1"))), "c", "left")
    )
    zero = F.lit(0.0)
    low = F.coalesce("l2", F.coalesce("w2", zero) + F.coalesce("l1", F.lit(model.unseen)))
    logs = scratch_table(logs.select("gram", "rows", F.coalesce("l3", F.coalesce("w3", zero) + low).alias("log")), "asked-logs")
    hot = F.broadcast(scratch_table(logs.orderBy(F.desc("rows"), "gram").limit(SENT_GRAMS).select("gram", "log"), "asked-most"))
    others = asked.join(hot.select("gram"), "gram", "left_anti").join(logs.select("gram", "log"), "gram")
    return scratch_table(asked.join(hot, "gram").unionByName(others).groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("log_rest")), "asked-sums")


class Scorer:
    """Base counts and log-probabilities of texts; words are looked up once and kept up to a bound."""

    def __init__(self, model: Trigrams | Frequent, limit: int = 250_000):
        self.model, self.limit = model, limit
        self.number: dict[bytes, int] = {}
        self.lost: dict[int, list[str]] = {}
        self.log, self.size = np.zeros(limit + 1), np.zeros(limit + 1, np.int64)

    def learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.number))
        if len(self.number) + len(new) > self.limit:
            self.number.clear()
            self.lost.clear()
            new = list(words)
        if len(new) > self.limit:
            self.limit = len(new)
            self.log, self.size = np.zeros(self.limit + 1), np.zeros(self.limit + 1, np.int64)
        at = len(self.number)
        texts = [w.decode("utf-8", "replace") for w in new]
        for start in range(0, len(texts), 20_000):
            part = texts[start : start + 20_000]
            self.log[at + start : at + start + len(part)], lost = self.model.scores(part)
            self.lost.update((at + start + i, grams) for i, grams in lost.items())
            self.size[at + start : at + start + len(part)] = [len(w) + 1 for w in part]
        self.number.update(zip(new, range(at, at + len(new)), strict=True))

    def rows(self, texts: list[bytes]) -> list[tuple]:
        cut = [t.split() for t in texts]
        self.learn(set().union(*cut))
        return [self.row(t, w) for t, w in zip(texts, cut, strict=True)]

    def row(self, text: bytes, words: list[bytes]) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log10 of the probability, its symbols, trigrams to ask for (or None)."""
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        lines = [x for x in text.split(b"\n") if x.strip()]
        asked: Counter = Counter()
        if self.lost:
            for i, k in zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True):
                for gram in self.lost.get(i, ()):
                    asked[gram] += k
        visible = text.translate(None, WHITE)
        return (
            len(words), len(visible.decode("utf-8", "replace")), len(visible) - len(visible.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(ids), float(self.log[ids].sum()), int(self.size[ids].sum()),
            [{"gram": g, "times": n} for g, n in asked.items()] if asked else None,
        )


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more in the text."""
    if len(ids) < 4:
        return 0
    if ids.max() >> 21:
        _, dense = np.unique(ids, return_inverse=True)
        n = int(dense.max()) + 1
        windows = np.unique(dense[:-2] * n + dense[1:-1], return_inverse=True)[1] * n + dense[2:]
    else:
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    ordered = np.sort(windows)
    found = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(found):
        return 0
    twice = np.isin(windows, found)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= twice
    return int(covered.sum())


def scored(df: DataFrame, model: Trigrams | Frequent, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, the base counts, base_failed, log_known, symbols, asked: log10 of the probability but for the trigrams that are asked for."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by SENT
    own = df.select(*(df[k].alias(f"k{i}") for i, k in enumerate(keys)), F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    kinds = [own.schema[f"k{i}"].dataType.simpleString() for i in range(len(keys))]
    spark_schema = ", ".join([f"k{i} {k}" for i, k in enumerate(kinds)] + [f"{n} long" for n in COUNTS] + ["base_failed boolean", "log_known double", "symbols long", "asked array<struct<gram:string,times:long>>"])
    grams = pa.list_(pa.struct([("gram", pa.string()), ("times", pa.int64())]))

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            schema = pa.schema([*list(batch.schema)[: len(keys)], *((n, pa.int64()) for n in COUNTS), ("base_failed", pa.bool_()), ("log_known", pa.float64()), ("symbols", pa.int64()), ("asked", grams)])
            for rows in by_size(rows_of(batch)):
                out = Columns(schema)
                for row, found in zip(rows, scorer.rows([r[-1] for r in rows]), strict=True):
                    out.add(*row[:-1], *found[:5], found[0] < 50 or 100 * found[4] > 50 * found[0], *found[5:])
                yield out.take()

    return own.mapInArrow(run, spark_schema)


def _quartiles(steps: DataFrame, by: list[str]) -> DataFrame:
    """by, n, low, high: quartiles from the columns step and n; a row a step is few whatever the corpus."""
    w = Window.partitionBy(*by)
    so_far = F.sum("n").over(w.orderBy("step"))
    own = steps.groupBy(*by, "step").agg(F.sum("n").alias("n")).withColumns({"_c": so_far, "_n": F.sum("n").over(w)})
    return own.groupBy(*by).agg(F.first("_n").alias("n"), *((F.min(F.when(F.col("_c") >= q * F.col("_n"), F.col("step"))) / STEPS).alias(name) for q, name in ((0.25, "low"), (0.75, "high"))))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Steps of the perplexity's logarithm to 1.
STEPS = 10_000
#: Rows of bands that are sent to the workers; more are joined by a shuffle, with the same result.
SENT_BANDS = 100_000
#: The same for trigrams that are asked for.
SENT_GRAMS = 100_000


def verdicts(df: DataFrame, keys: list[str], sent: int = SENT, reach: float = 6.0, prior: int = 100, lang_col: str = "lang", text_col: str = "text", prefix: str = "") -> DataFrame:
    """keys (and the language), base counts, base_failed, log_perplexity, kept; prefix goes before the new names.

    Columns that have one of the new names already are told apart by the prefix.
    """
    keys = keys if lang_col in keys else [*keys, lang_col]
    inner = [f"k{i}" for i in range(len(keys))]
    model = count_trigrams(df, sent, text_col)
    band = F.coalesce(F.col(inner[keys.index(lang_col)]).cast("string"), F.lit("\x00"))
    table = scratch_table(scored(df, model, keys, text_col).withColumns({"band": band, "row": F.monotonically_increasing_id()}), "quality")
    log = F.col("log_known")
    if isinstance(model, Frequent):
        table, log = table.join(asked_for(table, model), "row", "left"), log + F.coalesce("log_rest", F.lit(0.0))
    table = table.withColumn("log_perplexity", F.when(F.col("symbols") > 0, -log / F.col("symbols")))
    added = [*COUNTS, "base_failed", "log_perplexity"]
    # the bands are those of texts that the base rules keep
    good = table.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
    steps = scratch_table(good.groupBy("band", F.floor(F.col("log_perplexity") * STEPS).alias("step")).agg(F.count("*").alias("n")), "quality-steps")
    every = _quartiles(steps, []).first()
    low, high = (every.low, every.high) if every and every.n else (0.0, 0.0)
    share = F.col("n") / (F.col("n") + prior)
    bands = scratch_table(_quartiles(steps, ["band"]).select("band", (share * F.col("low") + (1 - share) * low).alias("low"), (share * F.col("high") + (1 - share) * high).alias("high")), "quality-bands")
    joined = table.join(F.broadcast(bands) if bands.count() <= SENT_BANDS else bands, "band", "left")
    width = F.greatest(F.coalesce("high", F.lit(high)) - F.coalesce("low", F.lit(low)), F.lit(0.01)) * reach
    inside = F.col("log_perplexity").between(F.coalesce("low", F.lit(low)) - width, F.coalesce("high", F.lit(high)) + width)
    kept = F.coalesce(~F.col("base_failed") & inside, F.lit(False))
    return joined.select(*inner, *added, kept.alias("kept")).toDF(*keys, *(prefix + n for n in (*added, "kept")))
