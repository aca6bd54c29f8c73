"""Series cut into chunks of rows, so that one series is the work of many tasks.

Chunk k of a series holds its rows k * rows to (k + 1) * rows - 1. For trailing
windows a chunk's group also has the `before` rows ahead of it, for leading
ones the `after` rows behind it (`_own` tells them apart). Row numbers come
from counts by stretches of time, so no task ever sorts a whole series.

What a chunk has to know of the rows before its group is carried: `Carries`
gives running sums, maxima and last values by totals of the chunks, and
`relay` hands on the state of any fold: chunks start from guesses, and those
whose guess isn't what the chunk before ends with are run again from that. A
fold that forgets its start, as most do, needs a round or two; the result is
that of the plain fold in any case.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept
from ..sources.bars import TIMEFRAMES

KEYS = ("symbol", "timeframe")
#: Columns that chunked frames have besides their own.
MARKS = ("_i", "_chunk", "_own")


def numbered(bars: DataFrame, rows: int, by: tuple[str, ...] = KEYS) -> DataFrame:
    """bars with _i, the row's place in its series by ts, from 0. Stretches of time of `rows` bars are counted and sorted one by one."""
    seconds = F.create_map(*(F.lit(x) for kv in TIMEFRAMES.items() for x in kv))
    width = F.coalesce(F.try_element_at(seconds, F.col("timeframe")), F.lit(60)).cast("long") if "timeframe" in bars.columns else F.lit(60).cast("long")
    cut = bars.withColumn("_stretch", F.floor(F.unix_micros("ts") / (width * (1_000_000 * rows))))
    sizes = cut.groupBy(*by, "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    offsets = sizes.select(*by, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy("ts"))
    return cut.join(offsets, [*by, "_stretch"]).withColumn("_i", F.col("_offset") + place - 1).drop("_stretch", "_offset")


def with_halo(own: DataFrame, rows: int, before: int, after: int = 0) -> DataFrame:
    """Rows with _i, each also in the groups that look back or ahead to it, with _chunk and _own."""
    if rows < before + after:
        raise ValueError(f"chunks of {rows} rows are shorter than what windows reach, {before + after}")
    at = lambda x: F.floor(x / rows).cast("long")
    home = at(F.col("_i"))
    groups = F.array_distinct(F.array(home, at(F.col("_i") + before), at(F.greatest(F.col("_i") - after, F.lit(0)))))
    return own.withColumn("_chunk", F.explode(groups)).withColumn("_own", home == F.col("_chunk"))


def owned(df: DataFrame) -> DataFrame:
    """The chunks' own rows, as they were before with_halo."""
    return df.where("_own").drop("_chunk", "_own")


_CARRIES: ContextVar[Carries | None] = ContextVar("carries", default=None)


class Carries:
    """Running values of chunked rows; a kernel asks for one and gets an expression that reads what is carried into its group.

    What is added up may look back itself, and the first rows of a group don't
    see so far: a group's own running begins at its row `skip`, and what is
    carried is the total of all rows before that one.
    """

    def __init__(self, rows: int, before: int, skip: int, by: tuple[str, ...] = KEYS):
        self.rows, self.before, self.skip, self.by = rows, before, skip, by
        self.asked: list[tuple[str, Column]] = []

    def of(self, kind: str, x: Column) -> Column:
        """sum, max or last (not null) of x up to the row."""
        self.asked.append((kind, x))
        carried = F.col(f"_carried{len(self.asked) - 1}")
        counted = F.when(F.col("_i") >= F.col("_chunk") * self.rows - self.before + self.skip, x)
        so_far = Window.partitionBy(*self.by, "_chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        local = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[kind](counted).over(so_far)
        if kind == "sum":
            return F.coalesce(local + carried, local, carried)
        return F.greatest(local, carried) if kind == "max" else F.coalesce(local, carried)

    @property
    def columns(self) -> list[str]:
        return [f"_carried{i}" for i in range(len(self.asked))]

    def join(self, df: DataFrame) -> DataFrame:
        """df with what is carried into each row's group."""
        if not self.asked:
            return df
        total = {"sum": F.sum, "max": F.max, "last": lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("_i")))}
        names = [f"_x{i}" for i in range(len(self.asked))]
        out = df.withColumns({n: x for n, (_, x) in zip(names, self.asked, strict=True)})
        # a chunk's last rows are counted by the next group itself
        tail = (F.floor((F.col("_i") + self.before - self.skip) / self.rows) > F.col("_chunk")).cast("int")
        sums = out.where("_own").groupBy(*self.by, "_chunk", tail.alias("_tail")).agg(*(total[k](F.col(n)).alias(n) for n, (k, _) in zip(names, self.asked, strict=True)))
        so_far = Window.partitionBy(*self.by).orderBy("_chunk", "_tail").rowsBetween(Window.unboundedPreceding, 0)  # two rows a chunk
        over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
        carried = sums.select(*self.by, (F.col("_chunk") + 1).alias("_chunk"), "_tail", *(over[k](F.col(n)).over(so_far).alias(c) for c, n, (k, _) in zip(self.columns, names, self.asked, strict=True)))
        return df.join(carried.where("_tail = 0").drop("_tail"), [*self.by, "_chunk"], "left")


@contextmanager
def carrying(carries: Carries | None):
    token = _CARRIES.set(carries)
    try:
        yield carries
    finally:
        _CARRIES.reset(token)


def carries() -> Carries | None:
    return _CARRIES.get()


def per_chunk(df: DataFrame, told: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, by: tuple[str, ...] = KEYS) -> DataFrame:
    """run(rows of a group by _i, rows of told for it) for each chunk; told has by and _chunk, too."""

    def one(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return run(rows.sort_values("_i", kind="stable", ignore_index=True), known) if len(rows) else pd.DataFrame()

    return df.groupBy(*by, "_chunk").cogroup(told.groupBy(*by, "_chunk")).applyInPandas(one, schema)


def relay(df: DataFrame, run: Callable[[pd.DataFrame, dict[str, list[float] | None]], dict[str, tuple[list[float], list[float]]]], by: tuple[str, ...] = KEYS, close: Callable[[str], float] = lambda name: 0.0, known: DataFrame | None = None, most_rounds: int = 10_000) -> DataFrame:
    """by, _chunk, name, state: what each named fold has to start a chunk's group from, the first chunk's state included.

    run(rows, states) folds a group from the states given, or from guesses of
    its own where none is, and tells of each fold the state it started from
    and the one it hands to the next group. Two states are the same if their
    numbers differ by no more than close(name), relative to their size.
    `known` are further states (by, _chunk, name, state) that run is told of.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keys = ", ".join(f"{c} {types[c]}" for c in by)
    schema = f"{keys}, _chunk long, name string, state array<double>, next array<double>"

    def told(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        ran = run(rows, {n: None if s is None else list(s) for n, s in zip(known["name"], known["state"], strict=True)})
        head = {c: rows[c].iloc[0] for c in (*by, "_chunk")}
        return pd.DataFrame([{**head, "name": n, "state": s, "next": e} for n, (s, e) in ran.items()], columns=[*by, "_chunk", "name", "state", "next"])

    spark = df.sparkSession
    known = known if known is not None else spark.createDataFrame([], f"{keys}, _chunk long, name string, state array<double>")
    found = kept(per_chunk(df, known, told, schema, by))
    keyed = [*by, "_chunk", "name"]
    before = Window.partitionBy(*by, "name").orderBy("_chunk")  # a row a chunk
    same = lambda a, b, name: F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda s: s["a"].eqNullSafe(s["b"]) | (F.abs(s["a"] - s["b"]) <= name * F.greatest(F.abs(s["a"]), F.abs(s["b"]))))
    names = [r.name for r in found.select("name").distinct().collect()]  # the folds asked for
    tolerance = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for n in names for x in (n, float(close(n))))), F.col("name")), F.lit(0.0)) if names else F.lit(0.0)
    for _ in range(most_rounds):
        handed = found.withColumn("_handed", F.lag("next").over(before))
        wrong = kept(handed.where(F.col("_handed").isNotNull() & ~F.coalesce(same(F.col("state"), F.col("_handed"), tolerance), F.lit(False))).select(*keyed, F.col("_handed").alias("state")))
        if not wrong.head(1):
            return found.select(*keyed, "state")
        chunks = wrong.select(*by, "_chunk").distinct()
        again = per_chunk(df.join(chunks, [*by, "_chunk"], "left_semi"), wrong.unionByName(known.join(chunks, [*by, "_chunk"], "left_semi")), told, schema, by)
        again = again.join(wrong.select(*keyed), keyed, "left_semi")
        found = kept(found.join(wrong.select(*keyed), keyed, "left_anti").unionByName(again))
    raise RuntimeError("states did not settle")
