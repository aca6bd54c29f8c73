"""User-defined aggregates that merge: states are made where rows are read, and only states are shuffled.

An aggregate has four parts: a fresh state, a state updated by a batch of
rows, two states merged, and a state finished. A task keeps a state for each
group it sees, hands on its states when there are too many, and each group's
states meet in the task that merges them, in no particular order: merging must
not depend on it. A group that holds most of all rows costs one state a task.
"""

from __future__ import annotations

import math
import pickle
from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import DataFrame

#: States that a task keeps before it hands them on.
MOST = 100_000


class Mergeable(ABC):
    """schema: the finished columns, as DDL."""

    schema: str

    @abstractmethod
    def fresh(self): ...

    @abstractmethod
    def update(self, state, rows: pd.DataFrame):
        """The state with a group's rows of a batch."""

    @abstractmethod
    def merge(self, a, b): ...

    @abstractmethod
    def finish(self, state) -> tuple: ...


def aggregate(df: DataFrame, by: list[str], columns: list[str], how: Mergeable) -> DataFrame:
    """by and how's columns, a row a group; groups by NULL are groups, an empty table has none."""
    own = df.select(*by, *columns)
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    keys = ", ".join(f"{c} {types[c]}" for c in by)

    def partial(batches):
        states = {}

        def told():
            rows = [(*pickle.loads(k), pickle.dumps(s)) for k, s in states.items()]
            out = pd.DataFrame(rows, columns=[*by, "_state"])
            states.clear()
            return out

        for rows in batches:
            for key, group in rows.groupby(by, dropna=False, sort=False):
                k = pickle.dumps(tuple(None if pd.isna(x) else x for x in key))
                states[k] = how.update(states[k] if k in states else how.fresh(), group)
            if len(states) > MOST:
                yield told()
        if states:
            yield told()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        state = None
        for blob in rows["_state"]:
            other = pickle.loads(blob)
            state = other if state is None else how.merge(state, other)
        return pd.DataFrame([(*rows[by].iloc[0], *how.finish(state))], columns=[*by, *names])

    names = [f.split(" ")[0] for f in how.schema.split(", ")]
    made = own.mapInPandas(partial, f"{keys}, _state binary")
    return made.groupBy(*by).applyInPandas(merged, f"{keys}, {how.schema}")


class Moments(Mergeable):
    """n, mean, variance (of a sample), skewness and excess kurtosis of a column: central moments, merged by the difference of means."""

    schema = "n long, mean double, variance double, skewness double, kurtosis double"

    def __init__(self, column: str):
        self.column = column

    def fresh(self):
        return (0, 0.0, 0.0, 0.0, 0.0)

    def update(self, state, rows):
        x = rows[self.column].dropna().to_numpy(float)
        if not len(x):
            return state
        d = x - x.mean()
        return self.merge(state, (len(x), float(x.mean()), float((d**2).sum()), float((d**3).sum()), float((d**4).sum())))

    def merge(self, a, b):
        (n, m, a2, a3, a4), (k, l, b2, b3, b4) = a, b
        if not n or not k:
            return b if not n else a
        t, d = n + k, l - m
        return (
            t, m + d * k / t, a2 + b2 + d * d * n * k / t, a3 + b3 + d**3 * n * k * (n - k) / t**2 + 3 * d * (n * b2 - k * a2) / t,
            a4 + b4 + d**4 * n * k * (n * n - n * k + k * k) / t**3 + 6 * d * d * (n * n * b2 + k * k * a2) / t**2 + 4 * d * (n * b3 - k * a3) / t,
        )

    def finish(self, state):
        n, m, a2, a3, a4 = state
        none = None
        return (n, m if n else none, a2 / (n - 1) if n > 1 else none, math.sqrt(n) * a3 / a2**1.5 if n and a2 > 0 else none, n * a4 / a2**2 - 3 if n and a2 > 0 else none)
