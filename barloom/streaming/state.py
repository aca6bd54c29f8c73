"""Indicators and positions over a stream of bars: what remembers is the stream's state, a series each.

A series' state is what a chunk hands to the next in batch (steps.py,
simulate.py): of an exponential mean its value, age and count; of the simulator
the open position and the last bar's signals. So a stream gives what the whole
series gives, batch by batch, also after a restart from its checkpoint. Bars
come in order of time, a micro-batch's in any order; a bar that isn't later
than the last one of its series is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.steps import _ewm_from, _ewm_summary, advanced
from ..operators.simulate import Risk, positions

KEYS = ("symbol", "timeframe")


def _later(frames: Iterator[pd.DataFrame], last: int) -> pd.DataFrame:
    """The rows by time, those after `last` (nanoseconds), one a time."""
    rows = pd.concat(list(frames), ignore_index=True).astype({"ts": "datetime64[ns]"}).sort_values("ts", kind="stable").drop_duplicates("ts", ignore_index=True)
    return rows[rows["ts"].astype("int64") > last].reset_index(drop=True)


def _nanoseconds(ts: pd.Series) -> int:
    return int(pd.Timestamp(ts.iloc[-1]).value)


def stream_means(bars: DataFrame, spans: dict[str, int], column: str = "close") -> DataFrame:
    """symbol, timeframe, ts, the column, and an exponential mean of it by name and span; NULL before so many values."""
    names = list(spans)

    def run(key, frames, state):
        last, flat = state.get if state.exists else (-(1 << 62), [float("nan")] * (3 * len(names)))
        rows = _later(frames, last)
        if not len(rows):
            return
        x, flat, made = rows[column].to_numpy(float), list(flat), {}
        for i, name in enumerate(names):
            alpha, before = 2 / (spans[name] + 1), None if np.isnan(flat[3 * i]) else flat[3 * i : 3 * i + 3]
            made[name] = _ewm_from(x, alpha, spans[name], before)
            after = advanced("ewm", before, _ewm_summary(x, alpha))
            if after is not None:
                flat[3 * i : 3 * i + 3] = map(float, after)
        state.update((_nanoseconds(rows["ts"]), flat))
        out = pd.DataFrame({"symbol": key[0], "timeframe": key[1], "ts": rows["ts"], column: x, **made})
        yield out.astype(object).where(out.notna(), None)

    schema = f"symbol string, timeframe string, ts timestamp, {column} double, " + ", ".join(f"{n} double" for n in names)
    return bars.select(*KEYS, "ts", column).groupBy(*KEYS).applyInPandasWithState(run, schema, "last long, means array<double>", "append", "NoTimeout")


def stream_trades(signals: DataFrame, risk: Risk) -> DataFrame:
    """The trades of a stream of bars with entry_signal and exit_signal, each told when it ends: places, times, prices, result in percent, reason. Ranges, where the risk's modes want them, come with the bars as ATR columns."""
    ranges = [f"ATR_{n}" for n in risk.periods() if f"ATR_{n}" in signals.columns]
    wanted = ("atr" in (risk.sl_mode, risk.tp_mode, risk.trail_mode)) or risk.sizing == "atr_risk"
    if wanted and len(ranges) < len(risk.periods()):
        raise ValueError("the risk's modes need ATR columns")
    columns = ["close", "entry_signal", "exit_signal", *ranges]

    def run(key, frames, state):
        last, n, before, position = state.get if state.exists else (-(1 << 62), 0, [], [])
        rows = _later(frames, last)
        if not len(rows):
            return
        end = rows.iloc[-1]
        after = [float(end[c]) if pd.notna(end[c]) else float("nan") for c in columns]
        newest = _nanoseconds(rows["ts"])
        if n:  # the bar before tells whether to enter or leave
            rows = pd.concat([pd.DataFrame([{"ts": pd.Timestamp(last), **dict(zip(columns, before, strict=True))}]), rows], ignore_index=True)
        for c in (f"ATR_{p}" for p in risk.periods() if f"ATR_{p}" not in ranges):
            rows[c] = 0.0
        found, still = positions(rows, risk, 1, n - 1 if n else 0, -1, list(position))
        state.update((newest, n + len(rows) - (1 if n else 0), after, still))
        yield pd.DataFrame([(*key, *t[:8], t[3] is not None and t[6] > 0) for t in found], columns=["symbol", "timeframe", "entry_idx", "exit_idx", "entry_ts", "exit_ts", "entry_price", "exit_price", "pnl_pct", "exit_reason", "is_winner"])

    schema = "symbol string, timeframe string, entry_idx long, exit_idx long, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, pnl_pct double, exit_reason string, is_winner boolean"
    own = signals.select(*KEYS, "ts", *columns)
    return own.groupBy(*KEYS).applyInPandasWithState(run, schema, "last long, n long, before array<double>, position array<double>", "append", "NoTimeout")
