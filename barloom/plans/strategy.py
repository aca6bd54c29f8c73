"""Strategies as objects: what indicators they need, when they enter, when they leave.

A strategy gives Columns, so many strategies over one table share a scan, a
sort and the indicators; none is run row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import with_indicators
from . import rules

Signal = Callable[[list[str]], Column]


class Strategy(Protocol):
    name: str

    def indicators(self) -> list[str]: ...

    def entry(self, columns: list[str]) -> Column: ...

    def exit(self, columns: list[str]) -> Column: ...


@dataclass(frozen=True)
class FromFunctions:
    """A strategy of two functions that, given the names of the columns, give conditions."""

    name: str
    into: Signal
    out: Signal
    needs: tuple[str, ...] = ()

    def indicators(self) -> list[str]:
        return list(self.needs)

    def entry(self, columns: list[str]) -> Column:
        return self.into(columns)

    def exit(self, columns: list[str]) -> Column:
        return self.out(columns)


def of_slots(params: dict[str, str], name: str = "slots") -> FromFunctions:
    def into(columns: list[str]) -> Column:
        found = F.lit(True)
        for s in ("trend", "setup", "trigger", "context"):
            found = found & rules.slot(s, params.get(s, "none"), columns)
        return found

    return FromFunctions(name, into, lambda columns: rules.slot("exit", params.get("exit", "rsi_gt_70"), columns), tuple(rules.needed(params)))


def of_expressions(entry: str, leave: str, needs: Iterable[str], name: str = "expressions") -> FromFunctions:
    """Of two texts in the expression language, which are parsed, never run."""
    return FromFunctions(name, lambda columns: rules.expression(entry, columns), lambda columns: rules.expression(leave, columns), tuple(needs))


#: For bars that bring their signals along.
PASS_THROUGH = FromFunctions("pass through", lambda columns: F.col("entry_signal") == 1, lambda columns: F.col("exit_signal") == 1)


def run(bars: DataFrame, strategy: Strategy) -> DataFrame:
    """bars with the strategy's indicators, entry_signal and exit_signal (0/1; unknown is 0)."""
    return run_all(bars, [strategy]).withColumnsRenamed({f"{strategy.name}_entry": "entry_signal", f"{strategy.name}_exit": "exit_signal"})


def run_all(bars: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """bars with all indicators once, and for each strategy NAME_entry and NAME_exit."""
    own = with_indicators(bars, [i for s in strategies for i in s.indicators()])
    told = {}
    for s in strategies:
        told[f"{s.name}_entry"] = rules.known(s.entry(own.columns)).cast("int")
        told[f"{s.name}_exit"] = rules.known(s.exit(own.columns)).cast("int")
    brought = [c for c in ("entry_signal", "exit_signal") if c in own.columns and len(strategies) == 1]
    return own.withColumns(told).drop(*brought)
