"""Search over the thresholds of filters that an entry analysis suggests: the entry rule stays, its filters and the exit are tuned.

All trials run in one plan: bars hold the entry rule's flag and the columns
that filters and exits read, and a task runs the fold for each trial of a lot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.simulate import TRADE_FIELDS, Risk, fold, metrics, walk_forward
from .rules import expression
from .search import IN_FOLD, rank_key

PERIODS = (7, 14, 21)
#: The range of the RSI that ends a trade.
EXIT_RSI = (60.0, 85.0)
_PRIMES = (2, 3, 5, 7, 11, 13)


def proposals(ranges: list[tuple[str, str, float, float]], n: int, first: int = 0) -> list[dict]:
    """n trials for filters (column, operator, low, high): a threshold each, an RSI's period and level to leave at; evenly over their ranges."""

    def halton(i: int, base: int) -> float:
        f, r = 1.0, 0.0
        while i:
            f /= base
            r += f * (i % base)
            i //= base
        return r

    out = []
    for trial in range(first, first + n):
        found = {c: low + (high - low) * halton(trial + 1, base) for (c, _, low, high), base in zip(ranges, _PRIMES, strict=False)}
        out.append({"trial": trial, "thresholds": found, "period": PERIODS[trial % 3], "level": EXIT_RSI[0] + (EXIT_RSI[1] - EXIT_RSI[0]) * halton(trial + 1, 13)})
    return out


def evaluate(enriched: DataFrame, entry: str, ranges: list[tuple[str, str, float, float]], trials: list[dict], splits: int = 3, risk: Risk = Risk(), lot: int = 10) -> DataFrame:
    """trial, mean_sharpe, mean_return, mean_trades and score, out of sample: means over the series of those over their folds."""
    columns = [c for c, *_ in ranges]
    held = [f"RSI_{p}" for p in PERIODS if f"RSI_{p}" in enriched.columns]
    cross = F.col("ema_20_50_cross") if "ema_20_50_cross" in enriched.columns else F.lit(0)
    own = enriched.withColumns({"_enter": F.coalesce(expression(entry, enriched.columns), F.lit(False)), "_leave": F.coalesce(cross == -1, F.lit(False))})
    parts = walk_forward(own, splits).where("part = 'oos'")
    kept = list(dict.fromkeys(["ts", "high", "low", "close", "_enter", "_leave", *columns, *held, *(c for c in ("ATR_14",) if c in own.columns)]))
    lots = [trials[i : i + lot] for i in range(0, len(trials), lot)]
    dealt = parts.select(*IN_FOLD, *kept).withColumn("_lot", F.explode(F.array(*map(F.lit, range(len(lots))))))
    names, signs = [f.split(" ")[0] for f in TRADE_FIELDS.split(", ")], {c: op for c, op, *_ in ranges}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable", ignore_index=True)
        keys, found = [rows[c].iloc[0] for c in IN_FOLD], []
        for t in lots[rows["_lot"].iloc[0]]:
            enter, leave = rows["_enter"].to_numpy(bool), rows["_leave"].to_numpy(bool)
            for c, x in t["thresholds"].items():  # an unknown value fails
                value = rows[c].to_numpy(float)
                enter = enter & (value < x if signs[c] == "<" else value > x)
            if f"RSI_{t['period']}" in rows:
                leave = leave | (rows[f"RSI_{t['period']}"].to_numpy(float) > t["level"])
            found += [(t["trial"], *keys, *x) for x in fold(rows.assign(entry_signal=enter.astype(int), exit_signal=leave.astype(int)), risk)]
        return pd.DataFrame(found, columns=["trial", *IN_FOLD, *names])

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = "trial int, " + ", ".join(f"{c} {kinds[c]}" for c in IN_FOLD) + ", " + TRADE_FIELDS
    series = parts.select(*IN_FOLD).distinct().withColumn("trial", F.explode(F.array(*(F.lit(t["trial"]) for t in trials))))
    measured = metrics(dealt.groupBy(*IN_FOLD, "_lot").applyInPandas(run, schema), ("trial", *IN_FOLD), series=series)
    per = measured.groupBy("trial", "symbol", "timeframe").agg(F.avg("sharpe").alias("sharpe"), F.avg("total_return").alias("ret"), F.sum("total_trades").alias("n"))
    out = per.groupBy("trial").agg(F.avg("sharpe").alias("mean_sharpe"), F.avg("ret").alias("mean_return"), F.avg("n").alias("mean_trades"))
    return out.withColumn("score", rank_key(F.col("mean_sharpe"), F.col("mean_return"), F.col("mean_trades")))
