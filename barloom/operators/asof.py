"""As-of joins: the latest earlier row of another series, without a range join.

Both sides are united and ordered once by (key, time, side); a running `last`
carries the right side forward. One shuffle on the key, no pairs. With `span`,
a key's rows are cut into stretches of time, each a task's work, and the last
row before a stretch is carried into it: a small pass over a row a stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import with_indicators
from ..sources.bars import with_minimum, width

#: Fixed value: what a longer timeframe hands to a shorter.
HIGHER_COLUMNS = "RSI_14 RSI_7 EMA_20 EMA_50 EMA_200 MACD_hist MACD ADX_14 BB_pct_20 BB_width_20 ATR_14 NATR_14 STOCH_K SUPERT_dir CCI_20 MFI_14 volume_ratio EMA50_slope HIGH_VOL_REGIME PRICE_RANGE_PCT ema_20_50_cross ema_50_200_cross".split()


def asof(left: DataFrame, right: DataFrame, columns: list[str], by: tuple[str, ...] = ("symbol",), on: str = "ts", fill: bool = False, prefix: str = "", span: int | None = None) -> DataFrame:
    """left with `columns` of the latest right row at or before it. fill: column by column the latest value that isn't NULL.

    span: the length of a stretch, in seconds where `on` is a time, else in its own units.
    """
    names = [f"{prefix}{c}" for c in columns]
    carried = right.select(*by, on, F.lit(0).alias("_side"), F.struct(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))).alias("_right"))
    rest = [c for c in left.columns if c not in (*by, on)]
    own = left.select(*by, on, F.lit(1).alias("_side"), F.struct(*rest).alias("_left") if rest else F.lit(None).alias("_left"))
    both = own.unionByName(carried, allowMissingColumns=True)
    keys = [*by]
    if span is not None:
        time = both.schema[on].dataType.typeName().startswith("timestamp")
        both = both.withColumn("_stretch", F.floor(F.unix_micros(on) / (1_000_000 * span) if time else F.col(on) / span))
        keys = [*by, "_stretch"]
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    told = {n: F.col(f"_right.{n}") for n in names} if fill else {"_found": F.col("_right")}
    found = {n: F.last(x, ignorenulls=True).over(w) for n, x in told.items()}
    if span is not None:
        last = both.groupBy(*keys).agg(*(F.max_by(x, F.when(x.isNotNull(), F.col(on))).alias(f"_last_{n}") for n, x in told.items()))
        before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
        into = last.select(*keys, *(F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_before_{n}") for n in told))
        both = both.join(into, keys)
        found = {n: F.coalesce(x, F.col(f"_before_{n}")) for n, x in found.items()}
    picked = both.withColumns(found).where("_side = 1")
    values = [F.col(n) if fill else F.col(f"_found.{n}").alias(n) for n in names]
    return picked.select(*(F.col(c) if c in (*by, on) else F.col(f"_left.{c}").alias(c) for c in left.columns), *values)


def inject_higher(bars: DataFrame, higher: DataFrame, timeframe: str, columns: list[str] | None = None, completed_only: bool = False, span: int | None = None) -> DataFrame:
    """bars with HTF_{timeframe}_* columns of the longer timeframe, and trend_dir (close against EMA_50) and regime (EMA50_slope), told there.

    A bar is stamped with its beginning, so by default a bar sees the longer
    bar that is still forming; completed_only waits for its end.
    """
    columns, prefix = columns or HIGHER_COLUMNS, f"HTF_{timeframe}_"
    enriched = with_indicators(with_minimum(higher, "higher"), [c for c in columns if c not in higher.columns])
    if completed_only:
        enriched = enriched.withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") + width(timeframe)))
    derived = {}
    if "EMA_50" in enriched.columns:
        derived["trend_dir"] = F.when(F.col("close") >= F.col("EMA_50"), 1).otherwise(-1)
    if "EMA50_slope" in enriched.columns:
        derived["regime"] = F.when(F.col("EMA50_slope") > 0.05, 1).when(F.col("EMA50_slope") < -0.05, -1).otherwise(0)
    return asof(bars, enriched.withColumns(derived), [*columns, *derived], fill=True, prefix=prefix, span=span)


def execution_signals(fine: DataFrame, signals: DataFrame) -> DataFrame:
    """Bars of a finer timeframe with the latest entry and exit signals (0 before the first) and ATR_14."""
    out = asof(fine, signals, ["entry_signal", "exit_signal", "ATR_14"])
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("entry_signal", "exit_signal")})


def nearest(points: DataFrame, bars: DataFrame, columns: list[str], on: str = "ts", span: int | None = None) -> DataFrame:
    """points (symbol, on, ...) with the columns of the bar nearest in time, its time as bar_ts; of equally near ones the earlier."""
    at = [*columns, on]
    before = asof(points, bars, at, prefix="_b_", span=span)
    mirrored = lambda df: df.withColumn("_t", -F.unix_micros(F.col(on).cast("timestamp")))
    both = asof(mirrored(before), mirrored(bars), at, on="_t", prefix="_a_", span=None if span is None else 1_000_000 * span)
    gap = lambda c: F.abs(F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col(on).cast("timestamp")))
    use_before = F.col(f"_b_{on}").isNotNull() & (F.col(f"_a_{on}").isNull() | (gap(f"_b_{on}") <= gap(f"_a_{on}")))
    picked = [F.when(use_before, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(n) for c, n in zip(at, [*columns, "bar_ts"], strict=True)]
    return both.select(*points.columns, *picked)


def context(points: DataFrame, bars: DataFrame, columns: list[str], before: int = 10, after: int = 10) -> DataFrame:
    """points (symbol, ts of a bar) with the bars around as an array, cut at the ends of the series.

    A window over the bars alone; the points then join on their own bar.
    """
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-before, after)
    around = bars.select("symbol", "ts", F.collect_list(F.struct("ts", *columns)).over(w).alias("context"))
    return points.join(around, ["symbol", "ts"], "left")


def outcomes(bars: DataFrame, hold: int, fee: float, slippage: float, min_profit: float = 0.0) -> DataFrame:
    """Entries (entry_signal = 1) held for so many bars: entry_price, exit_price, pnl_pct, is_winner; those past the end are left out."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("ts")
    out = bars.withColumn("_exit", F.lead("close", hold).over(w)).where((F.col("entry_signal") == 1) & F.col("_exit").isNotNull())
    entry, leave = F.col("close") * (1 + slippage), F.col("_exit") * (1 - slippage)
    pnl = (F.try_divide(leave, F.nullif(entry, F.lit(0.0))) - 1) * 100 - fee * 200
    return out.withColumns({"entry_price": entry, "exit_price": leave, "pnl_pct": pnl}).withColumn("is_winner", F.coalesce(F.col("pnl_pct") > min_profit, F.lit(False))).drop("_exit")
