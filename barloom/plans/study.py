"""A stored search: proposals learn from what is stored, losing trials are dropped fold by fold, and a search goes on where it stopped.

A batch of trials is proposed by the driver, which knows a row a trial; its
folds run one after another as Spark jobs, each over all series and all trials
still in the race. Every batch is a folder of the study: its folds' measures,
then its trials. A batch counts once its trials are stored, so a search that
ends anywhere is run again from the first batch that doesn't, with the same
proposals, since these depend on the seed, the batch and the trials stored.

Proposals for one measure come from two Parzen estimates, of the good trials
and of the others (`parzen`); for two measures, from parents that survive a
sort by fronts and by room around them (`offspring`).
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import SLOTS
from .search import MODES, RANGES, evaluate, propose, scores

#: Values of the parameters that aren't numbers.
CHOICES = {**{s: list(o) for s, o in SLOTS.items()}, **MODES}


@dataclass
class Trial:
    params: dict
    state: str = "complete"
    steps: list[float] = field(default_factory=list)
    score: float | None = None
    values: tuple[float, float] | None = None

    @property
    def number(self) -> int:
        return self.params["trial"]


def _density(x: float, points: list[float], low: float, high: float) -> float:
    """A Parzen estimate on [low, high]: a bell for each point, cut at the ends and as wide as their number allows, and one flat part."""
    width = (high - low) / min(len(points) + 1, 20)
    below = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    inside = lambda p: below((high - p) / width) - below((low - p) / width)
    return (1 / (high - low) + sum(math.exp(-((x - p) ** 2) / (2 * width * width)) / (width * math.sqrt(2 * math.pi) * inside(p)) for p in points)) / (len(points) + 1)


def parzen(history: list[Trial], n: int, first: int, seed: int = 42, startup: int = 10, candidates: int = 24) -> list[dict]:
    """n proposals: of `candidates` drawn from the estimate of the good trials, a tenth of all, the value by which good ones differ most from the rest; parameter by parameter."""
    done = sorted((t for t in history if t.score is not None), key=lambda t: (-t.score, t.number))
    if len(done) < startup:
        return propose(n, seed, first)
    cut = max(1, min(math.ceil(0.1 * len(done)), 25))
    good, rest = [t.params for t in done[:cut]], [t.params for t in done[cut:]]
    out = []
    for trial in range(first, first + n):
        rng, p = random.Random(f"{seed} {trial}"), {}
        for name, options in CHOICES.items():
            share = lambda own, o, name=name, options=options: (1 + sum(q[name] == o for q in own)) / (len(options) + len(own))
            drawn = rng.choices(options, [share(good, o) for o in options], k=candidates)
            p[name] = max(drawn, key=lambda o: share(good, o) / share(rest, o))
        for name, (low, high) in RANGES.items():
            points, others = [q[name] for q in good], [q[name] for q in rest]
            width = (high - low) / min(len(points) + 1, 20)
            drawn = [rng.uniform(low, high) if (k := rng.randrange(len(points) + 1)) == len(points) else min(high, max(low, rng.gauss(points[k], width))) for _ in range(candidates)]
            p[name] = max(drawn, key=lambda x: _density(x, points, low, high) / _density(x, others, low, high))
        out.append(p | {"trial": trial})
    return out


def fronts(values: list[tuple[float, float]]) -> list[int]:
    """For each pair of values its front: 0 if no other is as good in both and better in one, 1 if only those of front 0 are, and so on."""
    order, best, out = sorted(range(len(values)), key=lambda i: (-values[i][0], -values[i][1])), [], [0] * len(values)
    for i in order:
        # best[k]: the highest second value of front k so far, with the first value it came with
        x, y = values[i]
        k = next((k for k, (a, b) in enumerate(best) if not (b > y or b == y and a > x)), len(best))
        if k == len(best):
            best.append((x, y))
        elif y > best[k][1]:
            best[k] = (x, y)
        out[i] = k
    return out


def crowding(values: list[tuple[float, float]], members: list[int]) -> dict[int, float]:
    """The room around each member of a front: the spread of its neighbours in both values; the ends have endless room."""
    room = dict.fromkeys(members, 0.0)
    for axis in (0, 1):
        order = sorted(members, key=lambda i: (values[i][axis], i))
        spread = values[order[-1]][axis] - values[order[0]][axis]
        room[order[0]] = room[order[-1]] = math.inf
        for before, i, after in zip(order, order[1:], order[2:], strict=False):
            room[i] += (values[after][axis] - values[before][axis]) / spread if spread else 0.0
    return room


def offspring(history: list[Trial], n: int, first: int, seed: int = 42, population: int = 50) -> list[dict]:
    """n proposals: each takes every parameter from one of two parents, now and then a new value.

    Parents win a comparison of two of the `population` best: the better
    front, or, within a front, more room.
    """
    done = [t for t in history if t.values is not None and all(map(math.isfinite, t.values))]
    if len(done) < 4:
        return propose(n, seed, first)
    values = [t.values for t in done]
    front = fronts(values)
    room: dict[int, float] = {}
    for k in set(front):
        room |= crowding(values, [i for i, f in enumerate(front) if f == k])
    ranked = sorted(range(len(done)), key=lambda i: (front[i], -room[i], done[i].number))[:population]
    out = []
    for trial in range(first, first + n):
        rng, p = random.Random(f"{seed} {trial}"), {}
        fresh = propose(1, seed, trial)[0]
        mother, father = (done[ranked[min(rng.randrange(len(ranked)), rng.randrange(len(ranked)))]].params for _ in range(2))
        for name in (*CHOICES, *RANGES):
            p[name] = fresh[name] if rng.random() < 1 / len(fresh) else (mother if rng.random() < 0.5 else father)[name]
        out.append(p | {"trial": trial})
    return out


def falls_behind(trial: Trial, history: list[Trial], startup: int = 10) -> bool:
    """Whether a trial's best value so far is below the median that complete trials had at this step."""
    step = len(trial.steps) - 1
    known = sorted(t.steps[step] for t in history if t.state == "complete" and len(t.steps) > step)
    if len(known) < startup:
        return False
    middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    return max(trial.steps) < middle


class Study:
    """A search whose trials are stored in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, both: bool = False, splits: int = 3, n_series: int = 1, least_trades: float = 5, seed: int = 42, startup: int = 10):
        """both: mean Sharpe and mean return are sought together, and nothing is dropped early; else the score is."""
        self.spark, self.folder, self.both, self.splits, self.n_series, self.least_trades, self.seed, self.startup = spark, folder.rstrip("/"), both, splits, n_series, least_trades, seed, startup

    def _done(self, batch: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch}/trials/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def trials(self) -> list[Trial]:
        """What is stored, in order; a row a trial."""
        out, batch = [], 0
        while self._done(batch):
            rows = self.spark.read.parquet(f"{self.folder}/batch={batch}/trials").orderBy("trial").collect()
            out += [Trial(json.loads(r.params), r.state, list(r.steps), r.score, None if r.mean_sharpe is None else (r.mean_sharpe, r.mean_return)) for r in rows]
            batch += 1
        return out

    def table(self) -> DataFrame:
        """trial, state, folds run, score, mean_sharpe, mean_return, params (JSON) of what is stored."""
        kinds = "trial int, params string, state string, steps array<double>, score double, mean_sharpe double, mean_return double"
        batch = 0
        while self._done(batch):
            batch += 1
        found = self.spark.read.schema(kinds).parquet(*(f"{self.folder}/batch={b}/trials" for b in range(batch))) if batch else self.spark.createDataFrame([], kinds)
        return found.select("trial", "state", F.size("steps").alias("folds"), "score", "mean_sharpe", "mean_return", "params")

    def run(self, enriched: DataFrame, batches: int, per_batch: int, told: Callable[[int, list[Trial]], None] | None = None) -> DataFrame:
        """Runs the batches that aren't stored yet, of so many in all; gives `table`."""
        history = self.trials()
        for batch in range(batches):
            if self._done(batch):
                continue
            make = offspring if self.both else parzen
            new = [Trial(p) for p in make(history, per_batch, batch * per_batch, self.seed)]
            self._batch(enriched, batch, new, history)
            history += new
            if told:
                told(batch, new)
        return self.table()

    def _batch(self, enriched: DataFrame, batch: int, new: list[Trial], history: list[Trial]) -> None:
        paths, alive = [], list(new)
        for fold in range(self.splits):
            if not alive:
                break
            path = f"{self.folder}/batch={batch}/fold={fold}"
            evaluate(enriched, [t.params for t in alive], self.splits, folds=[fold]).write.mode("overwrite").parquet(path)
            measures = self.spark.read.parquet(path)
            paths.append(path)
            means = {r.trial: r.value for r in measures.groupBy("trial").agg(F.avg("sharpe").alias("value")).collect()}  # a row a trial of the batch
            for t in alive:
                t.steps.append(float(means.get(t.number, -999.0)))
                if not self.both and fold < self.splits - 1 and falls_behind(t, history, self.startup):
                    t.state = "pruned"
            alive = [t for t in alive if t.state == "complete"]
        if alive:
            every = self.spark.read.parquet(*paths).where(F.col("trial").isin([t.number for t in alive]))
            found = {r.trial: r for r in scores(every, self.n_series, self.least_trades).collect()}  # a row a trial of the batch
            for t in alive:
                if t.number in found:
                    r = found[t.number]
                    t.score, t.values = r.score, (r.mean_sharpe, r.mean_return)
        rows = [(t.number, json.dumps(t.params), t.state, t.steps, t.score, *(t.values or (None, None))) for t in new]
        kinds = "trial int, params string, state string, steps array<double>, score double, mean_sharpe double, mean_return double"
        self.spark.createDataFrame(rows, kinds).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}/trials")

    def best(self, top: int = 10) -> list[Trial]:
        """The best trials stored: by score, or, for both measures, those of the first front, by mean Sharpe and a hundredth of the return."""
        done = [t for t in self.trials() if t.values is not None]
        if not self.both:
            return sorted((t for t in done if t.score > -999), key=lambda t: (-t.score, t.number))[:top]
        front = fronts([t.values for t in done])
        return sorted((t for t, f in zip(done, front, strict=True) if f == 0), key=lambda t: (-(t.values[0] + 0.01 * t.values[1]), t.number))[:top]

