"""The steps of recursive indicators that remember: exponential means, running totals, folds.

A function of a series takes them from here, and where it runs decides how
they are done: over a whole series at once, or over a chunk of one, from the
state that the rows before left. Each step over a chunk can tell what it makes
of any such state, in a few numbers: an exponential mean and a linear fold are
affine maps of it, totals add. These maps are composed over the chunks of a
series, a level of steps at a time (a step's level counts the steps that its
input comes from, one after another). Folds that aren't linear are relayed.

`shape` finds out, by trying a function on made-up prices, which steps it
takes, which depend on which, and how many rows back each looks.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd

State = list[float] | None
#: A fold over rows lo to hi - 1 from a state (None: anew), which reads its inputs at a row and LOOK rows before: arrays as long as the series, and the state it ends with (None: not begun).
Fold = Callable[[int, int, State], tuple[tuple[np.ndarray, ...], State]]
#: Rows that a fold which isn't linear is given to find its state by itself.
WARM_UP = 512
#: Rows of its inputs before the one at hand that a fold may read.
LOOK = 2


def _smooth(x: np.ndarray, alpha: float, full: int) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=full).mean().to_numpy()


class Whole:
    """Steps over a whole series."""

    first = 0

    def ewm(self, x: pd.Series, alpha: float, full: int) -> pd.Series:
        return pd.Series(_smooth(x.to_numpy(float), alpha, full))

    def total(self, x: pd.Series) -> pd.Series:
        return x.cumsum()

    def mean(self, x: pd.Series) -> float:
        return float(x.mean())

    def fold(self, run: Fold, inputs: list[np.ndarray], linear: bool, close: float) -> tuple[np.ndarray, ...]:
        return run(0, len(inputs[0]), None)[0]


_STEPS: ContextVar[Whole] = ContextVar("steps", default=Whole())


@contextmanager
def taken(how: Whole):
    token = _STEPS.set(how)
    try:
        yield how
    finally:
        _STEPS.reset(token)


def first() -> int:
    """The series' number of the first row at hand."""
    return _STEPS.get().first


def ewm(x: pd.Series, *, span: float | None = None, alpha: float | None = None, com: float | None = None, full: int = 0) -> pd.Series:
    """y = a x + (1 - a) y before, from the first value on; with full, NaN before so many values. A row without a value ages what is before it."""
    return _STEPS.get().ewm(x, alpha if alpha is not None else 2 / (span + 1) if span is not None else 1 / (1 + com), full)


def total(x: pd.Series) -> pd.Series:
    """Running sum; NaN where x is, and passed over."""
    return _STEPS.get().total(x)


def mean(x: pd.Series) -> float:
    """Mean of the whole series."""
    return _STEPS.get().mean(x)


def fold(run: Fold, inputs: list[np.ndarray], linear: bool = True, close: float = 0.0) -> tuple[np.ndarray, ...]:
    """What run makes of all rows. linear: its states are affine in the one it begins with. Otherwise states that differ by no more than `close`, relative to their size, are the same."""
    return _STEPS.get().fold(run, inputs, linear, close)


def _ewm_summary(x: np.ndarray, alpha: float) -> list[float]:
    """alpha, rows, place and value of the first value, slope and constant of the map from the mean there to the last, rows since the last value, values."""
    valid = np.flatnonzero(~np.isnan(x))
    if not len(valid):
        return [alpha, len(x), -1, 0.0, 1.0, 0.0, 0.0, 0]
    rest = x[valid[0] :].copy()
    rest[0] = 0.0
    one = np.where(np.isnan(rest), np.nan, 0.0)
    one[0] = 1.0
    return [alpha, len(x), int(valid[0]), float(x[valid[0]]), float(_smooth(one, alpha, 0)[-1]), float(_smooth(rest, alpha, 0)[-1]), len(x) - 1 - int(valid[-1]), len(valid)]


def _ewm_from(x: np.ndarray, alpha: float, full: int, state: State) -> np.ndarray:
    """The means of x after a state: the mean so far, rows since the last value, values."""
    if state is None:
        return _smooth(x, alpha, full)
    value, age, n = state
    out = np.full(len(x), value)
    valid = ~np.isnan(x)
    if valid.any():
        p = int(np.argmax(valid))
        rest = x[p:].copy()
        weight = (1 - alpha) ** (age + p + 1)
        rest[0] = (weight * value + alpha * rest[0]) / (weight + alpha)
        out[p:] = _smooth(rest, alpha, 0)
    return np.where(n + np.cumsum(valid) >= full, out, np.nan)


def advanced(kind: str, state: State, told: list[float]) -> State:
    """The state after a chunk that told this."""
    if kind == "total":
        return [told[0] + (state[0] if state else 0.0)]
    if kind == "ewm":
        alpha, rows, p, x, slope, constant, age, n = told
        if p < 0:
            return state and [state[0], state[1] + rows, state[2]]
        if state is not None:
            weight = (1 - alpha) ** (state[1] + p + 1)
            x = (weight * state[0] + alpha * x) / (weight + alpha)
        return [slope * x + constant, age, n + (state[2] if state else 0)]
    size = int(told[0])  # a linear fold: its size, whether it begins by itself and as what, then constant and matrix
    own, rest = told[2 : 2 + size], np.array(told[2 + size :])
    if state is None:
        return list(own) if told[1] else None
    return (rest[:size] + rest[size:].reshape(size, size) @ np.array(state)).tolist()


@dataclass(frozen=True)
class Step:
    """A step as `shape` found it. skip: rows at the beginning of a group whose input isn't what it would be in the whole series."""

    kind: str
    level: int
    skip: int
    close: float


class Part(Whole):
    """Steps over the group of chunk k of `rows` rows with `before` rows ahead of it.

    A step's state is that at its row `skip` of the group, and what it tells
    is for the same row of the next group. Steps of `level` tell; those of
    lower levels have their states in known; what comes later is NaN.
    """

    def __init__(self, k: int, rows: int, before: int, shape: tuple[Step, ...], known: dict[int, State], level: int):
        self.k, self.rows, self.before, self.shape, self.known, self.level = k, rows, before, shape, known, level
        self.first = max(0, k * rows - before)
        self.told: dict[int, list[float]] = {}
        self.relayed: dict[int, tuple[State, State]] = {}
        self.at = -1

    def _next(self, n: int) -> tuple[Step, int, int]:
        self.at += 1
        step = self.shape[self.at]
        return step, step.skip if self.k else 0, max(0, min(n, (self.k + 1) * self.rows - self.before + step.skip - self.first))

    def ewm(self, x, alpha, full):
        step, lo, hi = self._next(len(x))
        out, x = np.full(len(x), np.nan), x.to_numpy(float)
        if step.level == self.level:
            self.told[self.at] = _ewm_summary(x[lo:hi], alpha)
        elif step.level < self.level:
            out[lo:] = _ewm_from(x[lo:], alpha, full, self.known.get(self.at))
        return pd.Series(out)

    def total(self, x):
        step, lo, hi = self._next(len(x))
        out = np.full(len(x), np.nan)
        if step.level == self.level:
            self.told[self.at] = [float(x[lo:hi].sum())]
        elif step.level < self.level:
            state = self.known.get(self.at)
            out[lo:] = x[lo:].cumsum() + (state[0] if state else 0.0)
        return pd.Series(out)

    def mean(self, x):
        step, _, _ = self._next(len(x))
        if step.level == self.level:
            own = x[self.k * self.rows - self.first : (self.k + 1) * self.rows - self.first]
            self.told[self.at] = [float(own.sum()), float(own.count())]
        state = self.known.get(self.at) if step.level < self.level else None
        return state[0] / state[1] if state and state[1] else np.nan

    def fold(self, run, inputs, linear, close):
        n = len(inputs[0])
        step, lo, hi = self._next(n)
        made = None
        if step.level < self.level:
            made = run(lo, n, self.known.get(self.at))[0]
        elif step.level == self.level and step.kind == "linear":
            own = run(lo, hi, None)[1]
            size = len(own or run(lo, hi, [0.0])[1])
            constant = np.array(run(lo, hi, [0.0] * size)[1])
            unit = max(1.0, float(np.abs(constant).max()))  # of the constant's size, so that the difference keeps its digits
            columns = [(np.array(run(lo, hi, [unit * (i == j) for i in range(size)])[1]) - constant) / unit for j in range(size)]
            self.told[self.at] = [size, float(own is not None), *(own or [0.0] * size), *constant, *np.array(columns).T.reshape(-1)]
        elif step.level == self.level:
            state = self.known[self.at] if self.at in self.known else run(max(0, lo - WARM_UP), lo, None)[1] if self.k else None
            self.relayed[self.at] = (state, run(lo, hi, state)[1])
        arrays = made if made is not None else run(0, 0, None)[0]
        return tuple(np.where(np.arange(n) >= (lo if made is not None else n), a, np.nan) for a in arrays)


class _Probe(Whole):
    """Records the steps and their inputs; outputs can be given instead."""

    def __init__(self, given: dict[int, tuple] | None = None):
        self.given, self.kinds, self.inputs, self.outputs = given or {}, [], [], []

    def _put(self, kind, inputs, close, make):
        self.kinds.append((kind, close))
        self.inputs.append([np.array(x, float) for x in inputs])
        made = self.given[len(self.kinds) - 1] if len(self.kinds) - 1 in self.given else make()
        self.outputs.append(made)
        return made

    def ewm(self, x, alpha, full):
        return pd.Series(self._put("ewm", [x], 0.0, lambda: (Whole.ewm(self, x, alpha, full).to_numpy(),))[0])

    def total(self, x):
        return pd.Series(self._put("total", [x], 0.0, lambda: (x.cumsum().to_numpy(),))[0])

    def mean(self, x):
        return self._put("mean", [x], 0.0, lambda: (float(x.mean()),))[0]

    def fold(self, run, inputs, linear, close):
        return self._put("linear" if linear else "path", inputs, close, lambda: run(0, len(inputs[0]), None)[0])


@lru_cache(maxsize=1024)
def shape(function: Callable[[dict[str, pd.Series]], tuple[pd.Series, ...]]) -> tuple[tuple[Step, ...], int]:
    """The steps that function takes of a frame of prices, and how many rows a group needs ahead of the chunk."""
    n, tries, rng = 800, (300, 411, 467, 590), np.random.default_rng(7)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    gap = np.abs(rng.normal(0, 0.01, (3, n)))
    prices = {"open": close * (1 + gap[0] - gap[1]), "high": close * (1 + gap[0] + gap[2]), "low": close * (1 - gap[1] - gap[2]), "close": close, "volume": rng.integers(1, 1000, n).astype(float)}

    def tried(frame, given):
        with taken(_Probe(given)) as probe:
            ends = function({c: pd.Series(x) for c, x in frame.items()})
        return probe, [np.array(e, float) for e in ends]

    def reach(a: list[np.ndarray], b: list[np.ndarray], at: int) -> int:
        """Rows from the changed one to the last that differs by more than rounding; -1 where none does."""
        places = [np.flatnonzero(~(np.isclose(x, y, rtol=1e-7, atol=1e-7 * np.nanmax(np.abs(x), initial=0)) | (np.isnan(x) & np.isnan(y)))) for x, y in zip(a, b, strict=True)]
        return max((int(p[-1]) - at for p in places if len(p)), default=-1)

    base, ends = tried(prices, {})
    frozen = dict(enumerate(base.outputs))
    looks, last = [0] * len(base.kinds), 0
    columns = [tuple(prices)] + [(c,) for c in prices]
    for at, factor in ((at, factor) for at in tries for factor in (5.0, 0.2)):
        for changed in columns:
            frame = {c: np.where((np.arange(n) == at) & (c in changed), x * factor, x) for c, x in prices.items()}
            probe, made = tried(frame, frozen)
            looks = [max(old, reach(a, b, at)) for old, a, b in zip(looks, base.inputs, probe.inputs, strict=True)]
            last = max(last, reach(ends, made, at))
    steps: list[Step] = []
    needs = [(0, look) for look in looks]  # level and rows, by step
    for j, (kind, close_) in enumerate(base.kinds):
        level, skip = needs[j]
        skip += {"path": WARM_UP, "linear": LOOK}.get(kind, 0)
        steps.append(Step(kind, level + 1, skip, close_))
        scalar = kind == "mean"
        for at, factor in ((at, factor) for at in tries for factor in (5.0, 0.2)):
            changed = tuple(x * factor if scalar else np.where(np.arange(n) == at, x * factor + (factor > 1), x) for x in base.outputs[j])
            probe, made = tried(prices, frozen | {j: changed})
            for i in range(j + 1, len(base.kinds)):
                look = reach(base.inputs[i], probe.inputs[i], at)
                if look >= 0 or scalar and any(not np.array_equal(a, b, equal_nan=True) for a, b in zip(base.inputs[i], probe.inputs[i], strict=True)):
                    needs[i] = (max(needs[i][0], level + 1), needs[i][1] if scalar else max(needs[i][1], skip + look))
            if not scalar and (look := reach(ends, made, at)) >= 0:
                last = max(last, skip + look)
    return tuple(steps), max([last, *(s.skip for s in steps)]) + 1
