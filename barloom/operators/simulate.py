"""The trade simulator: a fold over a series in time, and what is measured of its trades.

The fold is sequential within a series and a parameter set, and parallel over
them: groups of (symbol, timeframe[, fold]) go to `applyInPandas`. Long series
are cut into chunks, whose open positions are relayed. All measures of trades
are DataFrame aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import KEYS, Carries, kept, numbered, per_chunk, relay, with_halo
from ..functions.recursive import UNITS, compute_split, smoothed
from .stats import benchmark

TRADE_FIELDS = "entry_idx int, exit_idx int, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, pnl_pct double, is_winner boolean, duration_bars int, exit_reason string, position_size double, capital double, capital_in double, final_capital double"


@dataclass(frozen=True)
class Risk:
    """The simulator's knobs. Modes: stop none/fixed/atr, target none/fixed/atr/rr, trail none/fixed/atr, sizing fixed/kelly/atr_risk."""

    capital: float = 10_000.0
    fee: float = 0.001
    slippage: float = 0.0005
    size: float = 0.1
    sizing: str = "fixed"
    kelly_fraction: float = 0.25
    risk: float = 0.01
    sl_mode: str = "fixed"
    sl_pct: float = 0.03
    sl_atr: float = 2.0
    tp_mode: str = "fixed"
    tp_pct: float = 0.06
    tp_atr: float = 4.0
    tp_rr: float = 2.0
    trail_mode: str = "none"
    trail_pct: float = 0.02
    trail_atr: float = 1.5
    sl_atr_period: int = 14
    tp_atr_period: int = 14
    trail_atr_period: int = 14
    size_atr_period: int = 14

    def periods(self) -> list[int]:
        return sorted({self.sl_atr_period, self.tp_atr_period, self.trail_atr_period, self.size_atr_period})

    @classmethod
    def of(cls, params: dict) -> Risk:
        """From loose parameters; legacy percentages switch their mode on, or off at 0."""
        known = {k: v for k, v in params.items() if k in cls.__dataclass_fields__}
        for old, mode, new in (("stop_loss_pct", "sl_mode", "sl_pct"), ("take_profit_pct", "tp_mode", "tp_pct"), ("trailing_pct", "trail_mode", "trail_pct")):
            if old in params and mode not in known:
                known |= {mode: "fixed" if params[old] else "none", new: params[old] or 0.0}
        return cls(**known)


def wilder(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    """Average true range for series that bring none; 0 before it begins."""
    before = np.concatenate([close[:1], close[:-1]])
    tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    out = np.zeros(len(tr))
    if len(tr) >= n:
        out[n - 1] = tr[:n].mean()
        for i in range(n, len(tr)):
            out[i] = out[i - 1] + (tr[i] - out[i - 1]) / n
    return out


def _range(n: int) -> str:
    """The name under which `wilder` of n is known to compute_split."""
    name = f"_RANGE_{n}"

    def unit(d: dict[str, pd.Series]) -> tuple[pd.Series]:
        high, low, close = (d[c].to_numpy(float) for c in ("high", "low", "close"))
        before = np.concatenate([close[:1], close[:-1]])
        return (pd.Series(smoothed(np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before))), n, n - 1)),)

    UNITS.setdefault(name, (unit, 0))
    return name


def kelly(results: list[float], fraction: float, share: float) -> float:
    """Fraction of Kelly's share by the last 20 results (percent), between 0.01 and 0.5.

    0.05 where losses are nothing; the share so far where all won or all lost.
    """
    last = results[-20:]
    wins, losses = [x for x in last if x > 0], [-x for x in last if x <= 0]
    if not wins or not losses:
        return share
    if not sum(losses):
        return 0.05
    odds, p = np.mean(wins) / np.mean(losses), len(wins) / len(last)
    return float(np.clip((p - (1 - p) / odds) * fraction, 0.01, 0.5))


#: A position: first and last bar's place and time, price paid and got, result in percent, why it ended, range at entry for sizing. One still open has no end.
Position = tuple[int, int | None, object, object, float, float | None, float | None, str | None, float]
_POSITION = "entry_idx long, exit_idx long, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, pnl_pct double, exit_reason string, wide double"


def positions(rows: pd.DataFrame, r: Risk, begin: int = 1, first: int = 0, last: int | None = None, state: list | None = None) -> tuple[list[Position], list]:
    """The positions that end in the rows from the begin-th on, and what is open behind them ([]: nothing).

    A signal enters at the next bar's close; one position at a time. A bar
    without a positive close is passed over. `first` is the first row's place
    in its series, `last` the place of the series' last row. An open position:
    place and microseconds of its entry, paid, stop, target, trail, range, peak.
    """
    close, ts = rows["close"].to_numpy(float), rows["ts"].tolist()
    enter, leave = rows["entry_signal"].fillna(0).to_numpy() == 1, rows["exit_signal"].fillna(0).to_numpy() == 1
    last = len(close) - 1 if last is None else last

    def ranges(n: int) -> np.ndarray:
        name = f"ATR_{n}"
        return np.nan_to_num(rows[name].to_numpy(float)) if name in rows else wilder(rows["high"].to_numpy(float), rows["low"].to_numpy(float), close, n)

    atr = {n: ranges(n) for n in r.periods()}
    sl_atr, tp_atr, trail_atr, size_atr = (atr[n] for n in (r.sl_atr_period, r.tp_atr_period, r.trail_atr_period, r.size_atr_period))
    found: list[Position] = []
    start, at, paid, stop, target, trail, size_wide, peak = (-1, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) if not state else (int(state[0]), pd.Timestamp(int(state[1]), unit="us"), *state[2:])
    for i in range(begin, len(close)):
        price = close[i]
        if not price > 0:
            continue
        if start < 0:
            if enter[i - 1]:
                paid = price * (1 + r.slippage)
                wide = sl_atr[i]
                stop = 0.0 if r.sl_mode == "none" else paid - r.sl_atr * wide if r.sl_mode == "atr" and wide > 0 else paid * (1 - r.sl_pct)
                wide = tp_atr[i]
                if r.tp_mode == "none" or r.tp_mode == "rr" and not stop > 0:
                    target = 0.0
                elif r.tp_mode == "rr":
                    target = paid + (paid - stop) * r.tp_rr
                else:
                    target = paid + r.tp_atr * wide if r.tp_mode == "atr" and wide > 0 else paid * (1 + r.tp_pct)
                wide = trail_atr[i]
                trail = 0.0 if r.trail_mode == "none" else r.trail_atr * wide if r.trail_mode == "atr" and wide > 0 else paid * r.trail_pct
                start, at, peak, size_wide = first + i, ts[i], paid, float(size_atr[i])
            continue
        peak = max(peak, price)
        reason = (
            "stop_loss" if stop > 0 and price <= stop
            else "take_profit" if target > 0 and price >= target
            else "trailing_stop" if trail > 0 and peak - price >= trail
            else "exit_signal" if leave[i - 1]
            else "end_of_data" if first + i == last
            else ""
        )
        if reason:
            got = price * (1 - r.slippage)
            found.append((start, first + i, at, ts[i], paid, got, (got / paid - 1) * 100, reason, size_wide))
            start = -1
    return found, [] if start < 0 else [float(start), float(at.value // 1000), *map(float, (paid, stop, target, trail, size_wide, peak))]


def funded(found: list[Position], r: Risk) -> list[tuple]:
    """The positions of a series, in order, with their share of the capital and what becomes of it: its trades. An open one costs its fee."""
    capital, share, trades, results = r.capital, r.size, [], []
    for start, end, entered, left, paid, got, pnl, reason, wide in found:
        used = share if r.sizing == "kelly" else min(capital * r.risk / wide, 0.5) if r.sizing == "atr_risk" and wide > 0 else r.size
        capital -= capital * used * r.fee
        if reason is None:
            continue
        after_fee = capital
        capital += capital * used * pnl / 100
        capital -= capital * used * r.fee
        results.append(pnl)
        trades.append((start, end, entered, left, paid, got, pnl, pnl > 0, end - start, reason, used, capital, after_fee))
        if len(results) % 10 == 0:
            share = kelly(results, r.kelly_fraction, share)
    return [(*t, capital) for t in trades]


def fold(rows: pd.DataFrame, r: Risk) -> list[tuple]:
    """The trades of one series, by time."""
    found, still = positions(rows, r)
    return funded([*found, *(_open(still) if still else ())], r)


def _open(state: list) -> list[Position]:
    return [(int(state[0]), None, pd.Timestamp(int(state[1]), unit="us"), None, state[2], None, None, None, state[6])]


def trades(signals: DataFrame, risk: Risk, by: tuple[str, ...] = ("symbol", "timeframe"), rows: int | None = None) -> DataFrame:
    """The trades of each series of signals (bars with entry_signal, exit_signal and, if there, ATR).

    With `rows`, a series is the work of several tasks (`split_positions`).
    """
    needed = ("ts", "open", "high", "low", "close", "entry_signal", "exit_signal", *(f"ATR_{n}" for n in risk.periods()))
    own = signals.select(*by, *(c for c in needed if c in signals.columns and c not in by))
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    names, keys = [f.split(" ")[0] for f in TRADE_FIELDS.split(", ")], ", ".join(f"{c} {types[c]}" for c in by)

    def table(found: list[tuple], rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=names)
        for k, c in enumerate(by):
            out.insert(k, c, rows[c].iloc[0] if len(rows) else None)
        return out

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return table(fold(rows.sort_values("ts", kind="stable", ignore_index=True), risk), rows)

    if rows is None:
        return own.groupBy(*by).applyInPandas(run, f"{keys}, {TRADE_FIELDS}")
    columns = [f.split(" ")[0] for f in _POSITION.split(", ")]

    def fund(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("entry_idx", kind="stable")
        found = [(int(t[0]), None if pd.isna(t[1]) else int(t[1]), *t[2:7], t[7] if isinstance(t[7], str) else None, t[8]) for t in rows[columns].itertuples(index=False, name=None)]
        return table(funded(found, risk), rows)

    return split_positions(own, risk, rows, by).groupBy(*by).applyInPandas(fund, f"{keys}, {TRADE_FIELDS}")


def split_positions(signals: DataFrame, risk: Risk, rows: int, by: tuple[str, ...] = ("symbol", "timeframe")) -> DataFrame:
    """by and the positions of each series, the last one's end NULL if it is still open; the work of tasks of `rows` bars each.

    Whenever it is flat, the fold has forgotten what was before. So chunks
    begin flat, and those that the chunk before reaches with an open position
    are run again with that one, until all agree; a round or two do for most.
    What capital makes of positions is left to `funded`, a series at a time.
    Runs jobs when called.
    """
    missing = [f"ATR_{n}" for n in risk.periods() if f"ATR_{n}" not in signals.columns]
    if missing and "atr" in (risk.sl_mode, risk.tp_mode, risk.trail_mode) or missing and risk.sizing == "atr_risk":
        if tuple(by) != KEYS:
            raise ValueError(f"signals of parts of series need {missing}")
        named = {_range(n): f"ATR_{n}" for n in risk.periods() if f"ATR_{n}" in missing}
        signals = compute_split(signals.withColumn("volume", F.lit(None).cast("double")), list(named), rows).drop("volume", "_i").withColumnsRenamed(named)
        missing = []
    own = signals.withColumns({n: F.lit(0.0) for n in missing})
    placed = kept(numbered(own, rows, by))
    ends = placed.groupBy(*by).agg(F.max("_i").alias("_last"))
    df = with_halo(placed, rows, 1).join(ends, list(by))

    def walked(group: pd.DataFrame, state: list) -> tuple[list[Position], list]:
        begin = 1 if group["_chunk"].iloc[0] == 0 else int((~group["_own"]).sum())
        return positions(group, risk, begin, int(group["_i"].iloc[0]), int(group["_last"].iloc[0]), state)

    def run(group: pd.DataFrame, states: dict[str, list[float] | None]) -> dict[str, tuple[list[float], list[float]]]:
        state = states.get("position") or []
        return {"position": (state, walked(group, state)[1])} if group["_own"].any() else {}

    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    keys = ", ".join(f"{c} {types[c]}" for c in by)

    def last(group: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not group["_own"].any():
            return pd.DataFrame()
        found, still = walked(group, list(states["state"].iloc[0]) if len(states) else [])
        if still and group.loc[group["_own"], "_i"].iloc[-1] == group["_last"].iloc[0]:
            found = [*found, *_open(still)]
        out = pd.DataFrame(found, columns=[f.split(" ")[0] for f in _POSITION.split(", ")])
        for k, c in enumerate(by):
            out.insert(k, c, group[c].iloc[0])
        return out.astype({"entry_idx": "Int64", "exit_idx": "Int64"})

    return per_chunk(df, relay(df, run, by), last, f"{keys}, {_POSITION}", by)


def profit_factor(pnl: Column) -> Column:
    """Gains over losses; over 1e-9 where nothing was lost."""
    lost = F.sum(F.when(pnl <= 0, -pnl).otherwise(0.0))
    return F.try_divide(F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.when(F.count_if(pnl <= 0) == 0, 1e-9).otherwise(lost))


#: Measures of trades that are 0 where a series has none.
MEASURES = ("total_trades", "winning_trades", "win_rate", "profit_factor", "expectancy", "avg_duration", "total_return", "sharpe", "sortino")


def metrics(found: DataFrame, by: tuple[str, ...], capital: float = 10_000.0, series: DataFrame | None = None) -> DataFrame:
    """By group: trades, win rate, profit factor, expectancy, average duration, return, Sharpe and Sortino by trade.

    series: rows with the groups, each of which gets a row, of zeros if it has no trades.
    """
    pnl = F.col("pnl_pct")
    r = pnl / 100 * F.col("position_size")
    won, lost = F.avg(F.when(pnl > 0, pnl)), F.avg(F.when(pnl <= 0, -pnl))
    rate = F.avg(F.when(pnl > 0, 1.0).otherwise(0.0))
    out = found.groupBy(*by).agg(
        F.count("*").alias("total_trades"), F.count_if(pnl > 0).alias("winning_trades"), rate.alias("win_rate"), profit_factor(pnl).alias("profit_factor"),
        (rate * F.coalesce(won, F.lit(0.0)) - (1 - rate) * F.coalesce(lost, F.lit(0.0))).alias("expectancy"), F.avg("duration_bars").alias("avg_duration"),
        ((F.max("final_capital") / capital - 1) * 100).alias("total_return"), (F.avg(r) / (F.stddev_pop(r) + 1e-9) * 252**0.5).alias("sharpe"),
        (F.avg(r) / (F.stddev_pop(F.when(r < 0, r)) + 1e-9) * 252**0.5).alias("sortino"),
    )
    if series is None:
        return out
    every = series.select(*by).distinct().join(out, list(by), "left")
    return every.select(*by, *(F.when(F.col("total_trades").isNull(), F.lit(0).cast(out.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in MEASURES))


def equity(signals: DataFrame, found: DataFrame, by: tuple[str, ...] = ("symbol", "timeframe"), capital: float = 10_000.0, rows: int | None = None) -> DataFrame:
    """by, ts, equity, highest so far and drawdown in percent at every bar: capital changes by the fee where a trade begins and by its result where it ends.

    With `rows`, a series is the work of several tasks, of so many bars each.
    """
    return _equity(signals, found, by, capital, rows).select(*by, "ts", "equity", "highest", ((F.col("highest") - F.col("equity")) / (F.col("highest") + 1e-12) * 100).alias("drawdown"))


def _equity(signals: DataFrame, found: DataFrame, by: tuple[str, ...], capital: float, rows: int | None) -> DataFrame:
    """by, ts, _i, equity and highest at every bar."""
    if rows is None:
        ordered = Window.partitionBy(*by).orderBy("ts")
        bars = signals.select(*by, "ts", (F.row_number().over(ordered) - 1).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    else:
        bars = with_halo(numbered(signals.select(*by, "ts"), rows, by), rows, 0)
        bars = bars.join(bars.groupBy(*by).agg(F.count("*").alias("_n")), list(by))
    events = F.array(F.struct(F.col("entry_idx").alias("_i"), F.col("capital_in").alias("_c")), F.struct(F.col("exit_idx").alias("_i"), F.col("capital").alias("_c")))
    changes = found.select(*by, F.explode(events).alias("_e")).select(*by, "_e._i", "_e._c")
    last = found.groupBy(*by).agg(F.max("final_capital").alias("_last"))
    out = bars.join(changes, [*by, "_i"], "left").join(last, list(by), "left")
    so_far = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)

    def running(df: DataFrame, name: str, kind: str, x: Column, made) -> DataFrame:
        """df with made(the running value of x) under the name."""
        if rows is None:
            return df.withColumn(name, made((F.max(x) if kind == "max" else F.last(x, ignorenulls=True)).over(so_far)))
        carried = Carries(rows, 0, 0, by)
        value = made(carried.of(kind, x))
        return carried.join(df).withColumn(name, value).drop(*carried.columns)

    out = running(out, "equity", "last", F.col("_c"), lambda c: F.coalesce(F.when(F.col("_i") == F.col("_n") - 1, F.col("_last")), c, F.lit(capital)))
    return running(out, "highest", "max", F.col("equity"), lambda c: c).select(*by, "ts", "_i", "equity", "highest")


def equity_metrics(signals: DataFrame, found: DataFrame, by: tuple[str, ...] = ("symbol", "timeframe"), capital: float = 10_000.0, rows: int | None = None) -> DataFrame:
    """By group: deepest drawdown, Sharpe, Sortino, Calmar and recovery of the equity at every bar; zeros where there are no trades."""
    out, keys = _equity(signals, found, by, capital, rows), [*by]
    if rows is not None:
        out, keys = with_halo(out, rows, 1), [*by, "_chunk"]
    before = F.lag("equity").over(Window.partitionBy(*keys).orderBy("ts"))
    out = out.withColumns({"_r": (F.col("equity") - before) / (before + 1e-12), "drawdown": (F.col("highest") - F.col("equity")) / (F.col("highest") + 1e-12) * 100})
    if rows is not None:
        out = out.where("_own")
    falls = F.coalesce(F.stddev_pop(F.when(F.col("_r") < 0, F.col("_r"))), F.lit(0.0))
    made = out.groupBy(*by).agg(
        F.max("drawdown").alias("max_drawdown"), (F.avg("_r") / (F.stddev_pop("_r") + 1e-9) * (252 * 24) ** 0.5).alias("bar_sharpe"),
        (F.avg("_r") / (falls + 1e-9) * (252 * 24) ** 0.5).alias("bar_sortino"), ((F.max_by("equity", "ts") / capital - 1) * 100).alias("_ret"),
    )
    traded = found.select(*by).distinct().withColumn("_t", F.lit(True))
    deep = F.col("max_drawdown") > 0
    ratios = {"calmar": F.when(deep, F.col("_ret") / F.col("max_drawdown")), "recovery": F.when(deep, F.abs("_ret") / F.col("max_drawdown"))}
    full = made.withColumns(ratios).join(traded, list(by), "left")
    return full.select(*by, *(F.when(F.col("_t"), F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in ("max_drawdown", "bar_sharpe", "bar_sortino", "calmar", "recovery")))


def walk_forward(signals: DataFrame, splits: int = 5, ratio: float = 0.7, anchored: bool = False, by: tuple[str, ...] = ("symbol", "timeframe")) -> DataFrame:
    """Rows by fold and part (is, oos): equal stretches, the last with the rest; anchored ones begin at the start.

    Folds with fewer than 50 rows in or 20 out are left out. Signals restart
    in each part: its first row has no predecessor.
    """
    w = Window.partitionBy(*by)
    out = signals.withColumns({"_i": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count("*").over(w)})
    size = F.floor(F.col("_n") / splits)
    own = F.least(F.when(size > 0, F.floor(F.col("_i") / size)).otherwise(0), F.lit(splits - 1))
    if anchored:
        # row i is in every fold that ends after it
        out = out.withColumn("fold", F.explode(F.sequence(own.cast("int"), F.lit(splits - 1))))
        start, end = F.lit(0), F.when(F.col("fold") == splits - 1, F.col("_n")).otherwise((F.col("fold") + 1) * size)
    else:
        out = out.withColumn("fold", own.cast("int"))
        start, end = F.col("fold") * size, F.when(F.col("fold") == splits - 1, F.col("_n")).otherwise((F.col("fold") + 1) * size)
    inside = F.floor((end - start) * ratio)
    out = out.withColumns({"_in": inside, "_out": end - start - inside, "part": F.when(F.col("_i") - start < inside, "is").otherwise("oos")})
    return out.where("_in >= 50 and _out >= 20").drop("_i", "_n", "_in", "_out")


def without_holdout(bars: DataFrame, share: float = 0.2, least: int = 20, by: tuple[str, ...] = ("symbol", "timeframe")) -> DataFrame:
    """The rows that `holdout` leaves."""
    w = Window.partitionBy(*by)
    out = bars.withColumns({"_i": F.row_number().over(w.orderBy("ts")), "_n": F.count("*").over(w)})
    return out.where(F.col("_i") <= F.col("_n") - F.greatest(F.lit(least), F.floor(F.col("_n") * share))).drop("_i", "_n")


def holdout(bars: DataFrame, share: float = 0.2, least: int = 20, by: tuple[str, ...] = ("symbol", "timeframe")) -> DataFrame:
    """The last rows of each series: the share of them, at least so many. Indicators on them start anew."""
    w = Window.partitionBy(*by)
    out = bars.withColumns({"_i": F.row_number().over(w.orderBy("ts")), "_n": F.count("*").over(w)})
    return out.where(F.col("_i") > F.col("_n") - F.greatest(F.lit(least), F.floor(F.col("_n") * share))).drop("_i", "_n")


def fold_means(per_fold: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """By group: the means over its folds, by part (is_, oos_), and the sums of trades; of measures, one row a (by, fold, part)."""
    means = {"return": "total_return", "win_rate": "win_rate", "sharpe": "sharpe", "sortino": "sortino", "profit_factor": "profit_factor", "expectancy": "expectancy"}
    own = lambda part, c: F.when(F.col("part") == part, F.col(c))
    return per_fold.groupBy(*by).agg(*(F.coalesce(F.avg(own(p, c)), F.lit(0.0)).alias(f"{p}_{n}") for p in ("is", "oos") for n, c in means.items()), *(F.coalesce(F.sum(own(p, "total_trades")), F.lit(0)).alias(f"{p}_trades") for p in ("is", "oos")))


def full_run(signals: DataFrame, risk: Risk, splits: int = 5, ratio: float = 0.7, anchored: bool = False, share: float = 0.2, least: int = 100, by: tuple[str, ...] = ("symbol", "timeframe")) -> tuple[DataFrame, DataFrame]:
    """A whole backtest: a row a series, and one row for the run.

    The last bars are held out and simulated once; on the others there is one
    simulation of all and the walk-forward's. Series with fewer than `least`
    bars before the holdout are left out. Signals are as given, so they may
    look back over the border of a part, never ahead. The run's row averages
    the series, but for trades, which it measures together; alpha is the
    in-sample return over buying and holding. Signals and trades are computed
    once, by jobs that run when this is called, and kept in the shared folder.
    """
    needed = ("ts", "open", "high", "low", "close", "entry_signal", "exit_signal", *(f"ATR_{n}" for n in risk.periods()))
    signals = kept(signals.select(*by, *(c for c in needed if c in signals.columns and c not in by)))
    bars = without_holdout(signals, share, by=by)
    enough = bars.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*by)
    keys = list(by)
    bars, away = bars.join(enough, keys, "left_semi"), holdout(signals, share, by=by).join(enough, keys, "left_semi")
    found = kept(trades(bars, risk, by))
    full = metrics(found, by, risk.capital, bars).join(equity_metrics(bars, found, by, risk.capital), keys)
    parts = walk_forward(bars, splits, ratio, anchored, by)
    in_fold = (*by, "fold", "part")
    folds = fold_means(metrics(trades(parts, fast(risk), in_fold), in_fold, risk.capital, parts), by)
    late = kept(trades(away, risk, by))
    held = metrics(late, by, risk.capital, away).join(equity_metrics(away, late, by, risk.capital), keys)
    held = held.select(*by, *(F.col(c).alias(f"holdout_{n}") for n, c in (("return", "total_return"), ("sharpe", "bar_sharpe"), ("trades", "total_trades"), ("win_rate", "win_rate"), ("max_drawdown", "max_drawdown"), ("profit_factor", "profit_factor"))))
    held_against = benchmark(signals.join(enough, keys, "left_semi"), by).select(*by, "benchmark_return", "benchmark_sharpe", "benchmark_max_drawdown")
    series = full.join(folds, keys, "left").join(held, keys, "left").join(held_against, keys, "left")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    one = series.agg(
        F.count("*").alias("series"), F.count_if(F.col("total_return") > 0).alias("series_profitable"), mean("is_return"), mean("oos_return"), mean("oos_win_rate"), mean("is_sharpe"), mean("is_sortino"), mean("oos_profit_factor"), mean("oos_expectancy"),
        mean("holdout_return"), mean("holdout_sharpe"), F.coalesce(F.sum("holdout_trades"), F.lit(0)).alias("holdout_trades"), mean("holdout_win_rate"), mean("holdout_max_drawdown"), mean("benchmark_return"), mean("benchmark_sharpe"),
    )
    all_trades = metrics(found.withColumn("_all", F.lit(1)), ("_all",), risk.capital).select("total_trades", "win_rate", "profit_factor", "expectancy", "avg_duration")
    run = one.withColumns({"coverage": F.try_divide("series_profitable", "series"), "alpha": F.col("is_return") - F.col("benchmark_return")})
    return series, run.join(F.broadcast(all_trades), how="left")  # a row on either side


def fast(risk: Risk) -> Risk:
    """For walk-forward parts and trials: no sizing by results so far."""
    return replace(risk, sizing="fixed")
