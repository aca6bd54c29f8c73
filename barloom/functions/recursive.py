"""Indicators that depend on their own past: one pass over a series computes all that are asked for.

A series goes to `applyInPandas` as a whole, and series run in parallel; or
series are cut into chunks of rows (`compute_split`), and one series is the
work of many tasks. What remembers is taken from steps.py, which knows both
ways. Plain exponential means are pandas' compiled ones, path-dependent
recursions are loops over NumPy values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import steps
from .chunks import KEYS, kept, numbered, per_chunk, relay, with_halo
from .steps import Part, advanced, ewm, first, fold, taken

Frame = dict[str, pd.Series]
#: Name to (columns it reads besides the prices, function of them).
RECURSIVE: dict[str, Callable[[Frame], pd.Series]] = {}
#: Name to the function that makes it, as a tuple of series, and its place there.
UNITS: dict[str, tuple[Callable[[Frame], tuple[pd.Series, ...]], int]] = {}


def recursive(*names: str):
    """Registers a function that returns a series or, for several names, a tuple of them."""

    def put(f):
        many = f if len(names) > 1 else lambda d: (f(d),)
        for i, name in enumerate(names):
            RECURSIVE[name] = (lambda d, i=i: _shared(f, d)[i]) if len(names) > 1 else f
            UNITS[name] = many, i
        return f

    return put


def _shared(f, d: Frame):
    made = d.setdefault("_made", {})
    if f not in made:
        made[f] = f(d)
    return made[f]


def of(d: Frame, name: str) -> pd.Series:
    if name not in d:
        d[name] = RECURSIVE[name](d)
    return d[name]


def over(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def true_range(d: Frame, first: bool = True) -> pd.Series:
    before = d["close"].shift(1)
    parts = pd.concat([d["high"] - d["low"], (d["high"] - before).abs(), (d["low"] - before).abs()], axis=1)
    return parts.max(axis=1) if first else parts.max(axis=1).where(before.notna())


for _n in (8, 13, 20, 21, 50, 100, 200):
    recursive(f"EMA_{_n}")(lambda d, n=_n: ewm(d["close"], span=n, full=n))


def _multiple(x: pd.Series, n: int, order: int, full: int = 0) -> pd.Series:
    parts, y = [], x
    for _ in range(order):
        y = ewm(y, span=n, full=full)
        parts.append(y)
    return 2 * parts[0] - parts[1] if order == 2 else 3 * parts[0] - 3 * parts[1] + parts[2]


for _n in (9, 21, 50):
    recursive(f"DEMA_{_n}")(lambda d, n=_n: _multiple(d["close"], n, 2, n))
    recursive(f"TEMA_{_n}")(lambda d, n=_n: _multiple(d["close"], n, 3, n))
for _n in (9, 21):
    recursive(f"DEMA_ext_{_n}")(lambda d, n=_n: _multiple(d["close"], n, 2))
    recursive(f"TEMA_ext_{_n}")(lambda d, n=_n: _multiple(d["close"], n, 3))


@recursive("MACD", "MACD_signal", "MACD_hist")
def _macd(d):
    line = ewm(d["close"], span=12, full=12) - ewm(d["close"], span=26, full=26)
    signal = ewm(line, span=9, full=9)
    return line, signal, line - signal


@recursive("PPO", "PPO_signal", "PPO_hist")
def _ppo(d):
    slow = ewm(d["close"], span=26, full=26)
    line = over(ewm(d["close"], span=12, full=12) - slow, slow) * 100
    signal = ewm(line, span=9, full=9)
    return line, signal, line - signal


def rsi(x: pd.Series, n: int) -> pd.Series:
    step = x.diff()
    up, down = ewm(step.clip(lower=0), alpha=1 / n, full=n), ewm(-step.clip(upper=0), alpha=1 / n, full=n)
    return (100 - 100 / (1 + over(up, down))).where(down != 0, 100.0).where(up.notna() & down.notna())


for _n in (7, 14, 21):
    recursive(f"RSI_{_n}")(lambda d, n=_n: rsi(d["close"], n))


@recursive("STOCHRSI_K", "STOCHRSI_D", "STOCHRSI_K_smooth")
def _stochrsi(d):
    r = of(d, "RSI_14")
    low, high = r.rolling(14).min(), r.rolling(14).max()
    k = over(r - low, high - low).rolling(3).mean()
    return k, k.rolling(3).mean(), k.rolling(3).mean()


def smoothed(x: np.ndarray, n: int, start: int) -> np.ndarray:
    """From the series' row `start` on: the mean of n values, then smoothed by 1 / n; 0 before."""

    def run(lo, hi, state):
        out, i, begin = np.zeros(len(x)), lo, start - first()
        if state is None:
            if not lo <= begin < hi:
                return (out,), None
            y = out[begin] = x[max(0, begin - n + 1) : begin + 1].mean()
            i = begin + 1
        else:
            y = state[0]
        for i in range(i, hi):
            y = out[i] = (y * (n - 1) + x[i]) / n
        return (out,), [float(y)]

    return fold(run, [x])[0]


def wilder_atr(d: Frame, n: int) -> np.ndarray:
    """Mean of the first n true ranges, then smoothed by 1 / n; 0 before."""
    return smoothed(true_range(d).to_numpy(float), n, n - 1)


for _n in (7, 14, 21):
    recursive(f"ATR_{_n}")(lambda d, n=_n: pd.Series(wilder_atr(d, n)))


def _wilder_sum(x: np.ndarray, n: int) -> np.ndarray:
    def run(lo, hi, state):
        out, i, begin = np.zeros(len(x)), lo, n - first()
        if state is None:
            if not lo <= begin < hi:
                return (out,), None
            y = out[begin] = x[max(0, begin - n + 1) : begin + 1].sum()
            i = begin + 1
        else:
            y = state[0]
        for i in range(i, hi):
            y = out[i] = y - y / n + x[i]
        return (out,), [float(y)]

    return fold(run, [x])[0]


def adx(d: Frame, n: int):
    """Average directional index and its two lines; 0 before they begin."""
    up, down = d["high"].diff(), -d["low"].diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    size = _wilder_sum(true_range(d).to_numpy(float), n)
    lines = [np.divide(100 * _wilder_sum(x.fillna(0).to_numpy(float), n), size, out=np.zeros(len(size)), where=size > 0) for x in (plus, minus)]
    both = lines[0] + lines[1]
    dx = np.divide(100 * np.abs(lines[0] - lines[1]), both, out=np.zeros(len(both)), where=both > 0)
    return pd.Series(smoothed(dx, n, 2 * n - 1)), pd.Series(lines[0]), pd.Series(lines[1])


for _n in (7, 14, 21):
    recursive(f"ADX_{_n}", f"DMP_{_n}", f"DMN_{_n}")(lambda d, n=_n: adx(d, n))


@recursive("TRIX_15")
def _trix(d):
    y = d["close"]
    for _ in range(3):
        y = ewm(y, span=15, full=15)
    before = y.shift(1).fillna(steps.mean(y))
    return over(y - before, before) * 100


@recursive("MASS_INDEX")
def _mass(d):
    one = ewm(d["high"] - d["low"], span=9, full=9)
    return over(one, ewm(one, span=9, full=9)).rolling(25).sum()


@recursive("PSAR_up", "PSAR_down", "PSAR_dir")
def _psar(d, step: float = 0.02, most: float = 0.2):
    high, low, close = (d[c].to_numpy(float) for c in ("high", "low", "close"))
    n = len(close)

    def run(lo, hi, state):
        value, rising, i = close.copy(), np.zeros(n), lo
        if state is None:
            up, pace, top, bottom, at = True, step, high[lo] if lo < n else 0.0, low[lo] if lo < n else 0.0, close[min(lo + 1, n - 1)] if n else 0.0
            i = lo + 2
        else:
            at, up, pace, top, bottom = state
            up = up > 0
        for i in range(i, hi):
            at = at + pace * ((top if up else bottom) - at)
            turned = False
            if up:
                if low[i] < at:
                    turned, at, bottom, pace = True, top, low[i], step
                else:
                    if high[i] > top:
                        top, pace = high[i], min(pace + step, most)
                    at = min(at, low[i - 1], low[i - 2])
            elif high[i] > at:
                turned, at, top, pace = True, bottom, high[i], step
            else:
                if low[i] < bottom:
                    bottom, pace = low[i], min(pace + step, most)
                at = max(at, high[i - 1], high[i - 2])
            up = up != turned
            value[i], rising[i] = at, up
        return (value, rising), [float(at), float(up), float(pace), float(top), float(bottom)]

    value, rising = fold(run, [high, low, close], linear=False)
    ready = np.arange(n) + first() >= 2
    above, below = np.where(ready & (rising > 0), value, np.nan), np.where(ready & ~(rising > 0), value, np.nan)
    return pd.Series(above), pd.Series(below), pd.Series(np.where(close > value, 1.0, -1.0))


def supertrend(d: Frame, n: int, factor: float, centre: pd.Series | None = None):
    """Line and direction. The line is the band that prices are held by; a band only moves towards prices while it holds them."""
    if centre is not None:
        d = {**d, "close": centre}
    close = d["close"].to_numpy(float)
    reach, middle = factor * ewm(true_range(d), span=n).to_numpy(float), ((d["high"] + d["low"]) / 2).to_numpy(float)

    def run(lo, hi, state):
        line, way = np.full(len(close), np.nan), np.zeros(len(close))
        at, rising = (math.nan, False) if state is None else (state[0], state[1] > 0)
        for i in range(lo + 1 if state is None else lo, hi):
            floor, ceiling = middle[i] - reach[i], middle[i] + reach[i]
            if not math.isnan(at):
                floor = floor if close[i - 1] < at else max(floor, at)
                ceiling = ceiling if close[i - 1] > at else min(ceiling, at)
            rising = not close[i] < floor if rising else bool(close[i] > ceiling)
            at = floor if rising else ceiling
            line[i], way[i] = at, 1 if rising else -1
        return (line, way), [float(at), float(rising)]

    return tuple(map(pd.Series, fold(run, [close, middle, reach], linear=False, close=1e-12)))


for _n, _f in ((10, 3), (14, 2), (7, 3), (10, 2), (14, 3), (20, 2)):
    recursive(f"SUPERT_{_n}_{_f}", f"SUPERT_dir_{_n}_{_f}")(lambda d, n=_n, f=_f: supertrend(d, n, f))
recursive("SUPERT_dir")(lambda d: of(d, "SUPERT_dir_10_3"))
recursive("PMAX_dir")(lambda d: supertrend(d, 10, 3, over((d["close"] * d["volume"]).rolling(10).sum(), d["volume"].rolling(10).sum()).fillna(d["close"]))[1])


@recursive("KAMA")
def _kama(d, n: int = 10, fast: int = 2, slow: int = 30):
    x = d["close"].to_numpy(float)
    moved, pace = np.abs(np.diff(x, prepend=x[:1])), np.zeros(len(x))
    for i in range(len(x)):
        path = moved[max(1, i - n + 1) : i + 1].sum()
        share = abs(x[i] - x[max(0, i - n)]) / path if path else 0.0
        pace[i] = (share * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2

    def run(lo, hi, state):
        out, i, begin = np.full(len(x), np.nan), lo, n - 1 - first()
        if state is None:
            if not lo <= begin < hi:
                return (out,), None
            y = out[begin] = x[begin]
            i = begin + 1
        else:
            y = state[0]
        for i in range(i, hi):
            y = out[i] = y + pace[i] * (x[i] - y)
        return (out,), [float(y)]

    return pd.Series(fold(run, [x, pace])[0])


recursive("OBV_EMA_12")(lambda d: ewm(obv(d), span=12))
recursive("FI_13")(lambda d: ewm(d["close"].diff() * d["volume"], span=13, full=13))
recursive("APO_12_26")(lambda d: ewm(d["close"], span=12) - ewm(d["close"], span=26))
recursive("EMA50_slope")(lambda d: (lambda e: over(e - e.shift(5), e.shift(5)) * 100)(ewm(d["close"], span=50)))


def obv(d: Frame) -> pd.Series:
    return steps.total(d["volume"].where(~(d["close"] < d["close"].shift(1)), -d["volume"]))


for _name, _n in (("ALLIGATOR_JAW", 13), ("ALLIGATOR_TEETH", 8), ("ALLIGATOR_LIPS", 5)):
    recursive(_name)(lambda d, n=_n: ewm((d["high"] + d["low"]) / 2, alpha=1 / n))
for _n in (3, 5, 8, 10, 12, 15):
    recursive(f"GMMA_S{_n}")(lambda d, n=_n: ewm(d["close"], span=n))
for _n in (30, 35, 40, 45, 50, 60):
    recursive(f"GMMA_L{_n}")(lambda d, n=_n: ewm(d["close"], span=n))


@recursive("CRSI")
def _crsi(d):
    def plain(x, n):
        step = x.diff()
        up, down = step.clip(lower=0).rolling(n).mean(), (-step.clip(upper=0)).rolling(n).mean()
        return 100 - 100 / (1 + over(up, down))

    way = np.sign(d["close"].diff().fillna(0))
    same = (way == way.shift(1)).to_numpy()

    def count(lo, hi, state):
        out, y = np.zeros(len(same)), 0.0 if state is None else state[0]
        for i in range(lo, hi):
            y = out[i] = y + 1 if same[i] else 1.0
        return (out,), [float(y)]

    run = pd.Series(fold(count, [same])[0])
    rank = d["close"].pct_change(fill_method=None).rolling(100).rank(pct=True) * 100
    return (plain(d["close"], 3) + plain(run * way, 2) + rank) / 3


@recursive("KDJ_K", "KDJ_D", "KDJ_J")
def _kdj(d):
    low, high = d["low"].rolling(9).min(), d["high"].rolling(9).max()
    k = ewm(over(d["close"] - low, high - low) * 100, com=2)
    dd = ewm(k, com=2)
    return k, dd, 3 * k - 2 * dd


def _twice(x: pd.Series, a: int, b: int) -> pd.Series:
    return ewm(ewm(x, span=a), span=b)


recursive("TSI_13_25")(lambda d: 100 * over(_twice(d["close"].diff(), 25, 13), _twice(d["close"].diff().abs(), 25, 13)))


@recursive("STC")
def _stc(d):
    def stochastic(x):
        low, high = x.rolling(10).min(), x.rolling(10).max()
        return ewm(over(x - low, high - low) * 100, span=3)

    return stochastic(stochastic(ewm(d["close"], span=23) - ewm(d["close"], span=50)))


@recursive("MCGD_14")
def _mcginley(d, n: int = 14):
    x = d["close"].to_numpy(float)

    def run(lo, hi, state):
        out, i = x.copy(), lo
        if state is None:
            before, i = x[lo] if lo < len(x) else math.nan, lo + 1
        else:
            before = state[0]
        for i in range(i, hi):
            part = n * (x[i] / before) ** 4 if before else math.nan
            value = before + (x[i] - before) / part if part > 1e-300 else before if part == 0 else math.nan
            before = out[i] = value if math.isfinite(value) and abs(value) < 1e150 else x[i]  # what runs away starts anew
        return (out,), [float(before)]

    return pd.Series(fold(run, [x], linear=False, close=1e-12)[0])


for _n in (6, 14, 26):
    recursive(f"BIAS_{_n}")(lambda d, n=_n: (over(d["close"], ewm(d["close"], span=n)) - 1) * 100)


def accumulation(d: Frame) -> pd.Series:
    return steps.total(over(2 * d["close"] - d["low"] - d["high"], d["high"] - d["low"]) * d["volume"])


recursive("ADOSC")(lambda d: ewm(accumulation(d), span=3) - ewm(accumulation(d), span=10))


@recursive("PVO", "PVO_signal")
def _pvo(d):
    slow = ewm(d["volume"], span=26)
    line = over(ewm(d["volume"], span=12) - slow, slow) * 100
    return line, ewm(line, span=9)


recursive("BULL_POWER_13")(lambda d: d["high"] - ewm(d["close"], span=13))
recursive("BEAR_POWER_13")(lambda d: d["low"] - ewm(d["close"], span=13))


def open_rsi(x: pd.Series, n: int) -> pd.Series:
    """RSI without a warm-up; undefined while nothing was lost."""
    up, down = ewm(x.diff().clip(lower=0), alpha=1 / n), ewm(-x.diff().clip(upper=0), alpha=1 / n)
    return 100 - 100 / (1 + over(up, down))


@recursive("QQE_LINE", "QQE_HIST")
def _qqe(d):
    line = ewm(open_rsi(d["close"], 14), span=5)
    return line, 4.236 * ewm(line.diff().abs(), span=5)


@recursive("SMI", "SMI_signal")
def _smi(d):
    step = d["close"].diff()
    line = 100 * over(_twice(step, 5, 20), _twice(step.abs(), 5, 20))
    return line, ewm(line, span=5)


recursive("RSX_14")(lambda d: ewm(open_rsi(d["close"], 14), span=7))
recursive("VOL_OSC")(lambda d: (lambda s: over(ewm(d["volume"], span=5) - s, s) * 100)(ewm(d["volume"], span=10)))
for _n in (20, 50):
    recursive(f"ZLEMA_{_n}")(lambda d, n=_n: ewm(2 * d["close"] - d["close"].shift((n - 1) // 2), span=n))


def _t3(x: pd.Series, n: int, v: float = 0.7) -> pd.Series:
    e = [x]
    for _ in range(6):
        e.append(ewm(e[-1], span=n))
    return -(v**3) * e[6] + 3 * v * v * (1 + v) * e[5] - 3 * v * (1 + v) ** 2 * e[4] + (1 + v) ** 3 * e[3]


for _n in (5, 10):
    recursive(f"T3_{_n}")(lambda d, n=_n: _t3(d["close"], n))


def cmo(x: pd.Series, n: int) -> pd.Series:
    up, down = x.diff().clip(lower=0).rolling(n).sum(), (-x.diff().clip(upper=0)).rolling(n).sum()
    return over(up - down, up + down) * 100


@recursive("VIDYA_14")
def _vidya(d, n: int = 14, smooth: int = 12):
    x, pace = d["close"].to_numpy(float), cmo(d["close"], n).abs().to_numpy(float) / 100 * 2 / (smooth + 1)

    def run(lo, hi, state):
        out, i = x.copy(), lo
        if state is None:
            y, i = x[lo] if lo < len(x) else math.nan, lo + 1
        else:
            y = state[0]
        for i in range(i, hi):
            y = out[i] = x[i] if math.isnan(pace[i]) else pace[i] * x[i] + (1 - pace[i]) * y
        return (out,), [float(y)]

    return pd.Series(fold(run, [x, pace])[0])


@recursive("KVO")
def _klinger(d):
    way = np.sign((d["high"] + d["low"] + d["close"]).diff()).to_numpy(float)
    size = (d["high"] - d["low"]).to_numpy(float)

    def summed(lo, hi, state):
        out, i, y = np.zeros(len(size)), lo, 0.0
        if state is None:
            i = lo + 1
        else:
            y = state[0]
        for i in range(i, hi):
            y = out[i] = size[i] + (y if way[i] == way[i - 1] else size[i - 1])
        return (out,), [float(y)]

    run = fold(summed, [way, size])[0]
    force = pd.Series(way) * d["volume"] * (2 * over(pd.Series(size), pd.Series(run)) - 1).abs()
    return ewm(force, span=34) - ewm(force, span=55)


@recursive("HWMA")
def _holt_winter(d, na: float = 0.2, nb: float = 0.1, nc: float = 0.1):
    x = d["close"].to_numpy(float)

    def run(lo, hi, state):
        out, i = np.full(len(x), np.nan), lo
        if state is None:
            if hi - lo < 2:
                return (out,), None
            y, speed, i = x[lo], x[lo + 1] - x[lo], lo + 1
            out[lo] = y
        else:
            y, speed = state
        for i in range(i, hi):
            level = (1 - na) * (y + speed) + na * x[i]
            speed += nb * (level - y - speed)
            y = out[i] = level + nc * (x[i] - level)
        return (out,), [float(y), float(speed)]

    return pd.Series(fold(run, [x])[0])


recursive("AMAT_fast")(lambda d: (ewm(d["close"], span=8) > ewm(d["close"], span=21)).astype(float))


PRICES = ("open", "high", "low", "close", "volume")
#: A series' first rows, in which every fold begins; the first chunk holds them all.
BEGIN = 64


def compute(bars: DataFrame, names: list[str]) -> DataFrame:
    """bars with the named recursive columns; all in one pass over each series."""
    if not names:
        return bars
    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable", ignore_index=True)
        d: Frame = {c: rows[c].astype(float) for c in PRICES}
        return pd.concat([rows, pd.DataFrame({n: np.asarray(of(d, n), float) for n in names}, index=rows.index)], axis=1)

    made = bars.groupBy("symbol", "timeframe").applyInPandas(run, schema)
    return made.withColumns({n: F.nullif(F.col(n), F.lit(float("nan"))) for n in names})


def compute_split(bars: DataFrame, names: list[str], rows: int) -> DataFrame:
    """`compute` for series of any length: the work of tasks of `rows` rows each, or of twice what the indicators look back, if that is more.

    bars may have _i (see chunks.numbered); the result has it. A pass over the
    chunks for each level of steps tells their maps, which are composed in
    order, a few numbers a chunk; the last pass gives the columns. Runs jobs
    when called. Other than in `compute`, only the last digits differ.
    """
    units = list(dict.fromkeys(UNITS[n][0] for n in names))
    shapes = [steps.shape(u) for u in units]
    before = max([BEGIN, *(b for _, b in shapes)])
    rows = max(rows, 2 * before)
    bars = bars if "_i" in bars.columns else kept(numbered(bars, rows))
    if not names:
        return bars
    calls = {f"{u} {j}": step for u, (found, _) in enumerate(shapes) for j, step in enumerate(found)}
    highest = max((c.level for c in calls.values()), default=0)
    types = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    keys = ", ".join(f"{c} {types[c]}" for c in KEYS)
    schema = f"{keys}, _chunk long, name string, state array<double>"

    def taken_by(group: pd.DataFrame, known: dict[str, list[float]], level: int) -> tuple[list[Part], list[tuple[pd.Series, ...]]]:
        """Each unit's steps over the group, as far as `level`, and what the unit makes."""
        parts, made = [], []
        for u, (unit, (found, _)) in enumerate(zip(units, shapes, strict=True)):
            states = {j: list(known[f"{u} {j}"]) or None for j in range(len(found)) if f"{u} {j}" in known}
            parts.append(Part(int(group["_chunk"].iloc[0]), rows, before, found, states, level))
            if level > highest or any(s.level == level for s in found):
                with taken(parts[-1]), np.errstate(all="ignore"):
                    made.append(unit({c: group[c].astype(float) for c in PRICES}))
        return parts, made

    def names_of(parts: list[Part], what: str) -> dict[str, object]:
        return {f"{u} {j}": x for u, p in enumerate(parts) for j, x in getattr(p, what).items()}

    def told(level: int):
        def run(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            found = {}
            if group["_own"].any():
                found = names_of(taken_by(group, dict(zip(known["name"], known["state"], strict=True)), level)[0], "told")
            head = {c: group[c].iloc[0] for c in (*KEYS, "_chunk")} if found else {}
            return pd.DataFrame([{**head, "name": n, "state": x} for n, x in found.items()], columns=[*KEYS, "_chunk", "name", "state"])

        return run

    def composed(told: pd.DataFrame) -> pd.DataFrame:
        """The state that each chunk begins with, by the maps of the chunks before it; of a mean, the whole series' sum and count."""
        told, out = told.sort_values("_chunk", kind="stable"), []
        for name, own in told.groupby("name", sort=False):
            kind, state = calls[name].kind, None
            whole = np.sum(np.array(own["state"].tolist()), axis=0).tolist() if kind == "mean" else None
            for chunk, x in zip(own["_chunk"], own["state"], strict=True):
                out.append({**{c: told[c].iloc[0] for c in KEYS}, "_chunk": chunk, "name": name, "state": whole or state or []})
                state = state if kind == "mean" else advanced(kind, state, list(x))
        return pd.DataFrame(out, columns=[*KEYS, "_chunk", "name", "state"])

    halo = with_halo(bars, rows, before)
    prices = halo.select(*KEYS, "_chunk", "_own", "_i", *PRICES)
    known = bars.sparkSession.createDataFrame([], schema)
    for level in range(1, highest + 1):
        kinds = {c.kind for c in calls.values() if c.level == level}
        found = known
        if kinds - {"path"}:
            found = found.unionByName(per_chunk(prices, known, told(level), schema).groupBy(*KEYS).applyInPandas(composed, schema))
        if "path" in kinds:

            def run(group: pd.DataFrame, states: dict[str, list[float] | None], level=level) -> dict[str, tuple[list[float], list[float]]]:
                parts = taken_by(group, states, level)[0] if group["_own"].any() else []
                return {n: (s or [], e or []) for n, (s, e) in names_of(parts, "relayed").items()}

            found = found.unionByName(relay(prices, run, close=lambda name: calls[name].close, known=known))
        known = kept(found)

    fields = [f for f in halo.schema.fields if f.name not in ("_chunk", "_own")]
    full = T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def last(group: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not group["_own"].any():
            return pd.DataFrame()
        made = taken_by(group, dict(zip(states["name"], states["state"], strict=True)), highest + 1)[1]
        columns = {n: np.asarray(made[units.index(UNITS[n][0])][UNITS[n][1]], float) for n in names}
        return pd.concat([group[[f.name for f in fields]], pd.DataFrame(columns, index=group.index)], axis=1)[group["_own"].to_numpy()]

    out = per_chunk(halo, known, last, full)
    return out.withColumns({n: F.nullif(F.col(n), F.lit(float("nan"))) for n in names})
