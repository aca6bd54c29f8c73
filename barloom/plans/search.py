"""Parameter search: trials as rows, evaluated in parallel in one plan; the driver only proposes.

Every slot option is told once for each bar, as a bit of one integer. Bars go
to the trials in lots: a task holds one part of one series and runs the fold
for each trial of its lot. So the plan's size doesn't depend on the number of
trials, and indicators and rules are computed once, not once a trial.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import asof
from ..operators.simulate import TRADE_FIELDS, Risk, fold, metrics, walk_forward
from ..operators.stats import false_discovery, permutation, ranges
from .rules import SLOTS, rule_text, slot

#: Ranges of the risk parameters, (low, high).
RANGES = {"sl_pct": (0.01, 0.08), "sl_atr": (1.0, 4.0), "tp_pct": (0.02, 0.15), "tp_atr": (2.0, 8.0), "tp_rr": (1.0, 4.0), "trail_pct": (0.005, 0.05), "trail_atr": (0.5, 3.0)}
#: The modes.
MODES = {"sl_mode": ["none", "fixed", "atr"], "tp_mode": ["none", "fixed", "atr", "rr"], "trail_mode": ["none", "fixed", "atr"]}


def propose(n: int, seed: int = 42, first: int = 0, like: list[dict] | None = None, guide: dict[str, float] | None = None) -> list[dict]:
    """n parameter sets: slots and modes at random, risks by a Halton sequence, which covers their ranges evenly.

    like: sets that did well; slots and modes are then drawn by how often those have them, each option once besides.
    guide: sizes of coefficients by column (ic.lookup); options are drawn up to five times as often the more their columns tell.
    """
    rng, out = random.Random(seed + first), []
    primes = (2, 3, 5, 7, 11, 13, 17)

    def halton(i: int, base: int) -> float:
        f, r = 1.0, 0.0
        while i:
            f /= base
            r += f * (i % base)
            i //= base
        return r

    def choose(name: str, options: list[str]) -> str:
        if guide and name in SLOTS and not like:
            told = lambda o: max((guide.get(str(x).removeprefix("H:"), 0.0) for x in SLOTS[name][o][::2]), default=0.0)
            return rng.choices(options, [1 + 4 * told(o) / (max(guide.values()) or 1.0) for o in options])[0]
        if not like:
            return rng.choice(options)
        seen = Counter(p[name] for p in like)
        return rng.choices(options, [1 + len(options) * seen[o] for o in options])[0]

    for trial in range(first, first + n):
        p = {s: choose(s, list(o)) for s, o in SLOTS.items()} | {m: choose(m, o) for m, o in MODES.items()}
        out.append(p | {k: lo + (hi - lo) * halton(trial + 1, b) for (k, (lo, hi)), b in zip(RANGES.items(), primes, strict=True)} | {"trial": trial})
    return out


IN_FOLD = ("symbol", "timeframe", "fold")
#: The signals' slots; exit stands by itself.
ENTRY = ("trend", "setup", "trigger", "context")


def flagged(enriched: DataFrame, proposals: list[dict]) -> tuple[DataFrame, dict[tuple[str, str], int]]:
    """The bars with `_flags`, a bit for each slot option that some proposal has, and the bits' places."""
    chosen = sorted({(s, p.get(s, "none")) for p in proposals for s in SLOTS})
    bits = {o: i for i, o in enumerate(chosen)}  # SLOTS has fewer options than a long has bits
    flags = F.lit(0).cast("long")
    for (s, o), i in bits.items():
        flags = flags.bitwiseOR(F.when(slot(s, o, enriched.columns), F.lit(1 << i)).otherwise(0).cast("long"))
    return enriched.withColumn("_flags", flags), bits


def trial_trades(enriched: DataFrame, proposals: list[dict], splits: int = 3, lot: int = 10, fine: DataFrame | None = None, part: str = "oos", folds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The trades of all trials in the walk-forward's parts, and the keys (trial, symbol, timeframe, fold) of all parts.

    fine: bars of the execution timeframe, on which the signals of `enriched` are carried forward and traded.
    folds: only these of the parts.
    """
    own, bits = flagged(enriched, proposals)
    if fine is not None:
        carried = asof(fine, own, [c for c in ("_flags", "ATR_14") if c in own.columns], fill=True)
        own = carried.withColumn("_flags", F.coalesce("_flags", F.lit(0).cast("long")))
    parts = walk_forward(own, splits).where(F.col("part") == part)
    if folds is not None:
        parts = parts.where(F.col("fold").isin(folds))
    columns = [c for c in ("ts", "high", "low", "close", "ATR_14", "_flags") if c in parts.columns]
    lots = [proposals[i : i + lot] for i in range(0, len(proposals), lot)]
    dealt = parts.select(*IN_FOLD, *columns).withColumn("_lot", F.explode(F.array(*map(F.lit, range(len(lots))))))
    names = [f.split(" ")[0] for f in TRADE_FIELDS.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable", ignore_index=True)
        flags, keys, found = rows["_flags"].to_numpy(np.int64), [rows[c].iloc[0] for c in IN_FOLD], []
        for p in lots[rows["_lot"].iloc[0]]:
            wanted = sum(1 << bits[s, p.get(s, "none")] for s in ENTRY)
            signals = rows.assign(entry_signal=(flags & wanted == wanted).astype(int), exit_signal=flags >> bits["exit", p["exit"]] & 1)
            found += [(p["trial"], *keys, *t) for t in fold(signals, Risk.of(p))]
        return pd.DataFrame(found, columns=["trial", *IN_FOLD, *names])

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = "trial int, " + ", ".join(f"{c} {kinds[c]}" for c in IN_FOLD) + ", " + TRADE_FIELDS
    keys = parts.select(*IN_FOLD).distinct().withColumn("trial", F.explode(F.array(*(F.lit(p["trial"]) for p in proposals))))
    return dealt.groupBy(*IN_FOLD, "_lot").applyInPandas(run, schema), keys


def evaluate(enriched: DataFrame, proposals: list[dict], splits: int = 3, lot: int = 10, fine: DataFrame | None = None, part: str = "oos", folds: list[int] | None = None) -> DataFrame:
    """trial, symbol, timeframe, fold and the measures of the parts; zeros where there are no trades."""
    found, keys = trial_trades(enriched, proposals, splits, lot, fine, part, folds)
    return metrics(found, ("trial", *IN_FOLD), series=keys)


def successive(enriched: DataFrame, batches: int = 4, per_batch: int = 25, keep: int = 5, n_series: int = 1, seed: int = 42, **options) -> tuple[list[dict], DataFrame]:
    """Batches of trials, each proposed like the `keep` best so far; gives all proposals and their scores.

    Scores, a row a trial, are checkpointed batch by batch: a search can be resumed from them.
    """
    tried, told = [], None
    for batch in range(batches):
        best = {r.trial for r in told.orderBy(F.desc("score"), "trial").limit(keep).collect()} if told is not None else set()
        new = propose(per_batch, seed, batch * per_batch, [p for p in tried if p["trial"] in best])
        tried += new
        own = scores(evaluate(enriched, new, **options), n_series).checkpoint()
        told = own if told is None else told.unionByName(own)
    return tried, told


def best_trials(told: DataFrame, top: int = 10) -> DataFrame:
    """The first trials: those no other beats in both mean Sharpe and mean return come first, then by score."""
    front = pareto(told.where("score > -999").select("trial", "mean_sharpe", "mean_return"), "mean_sharpe", "mean_return").select("trial", F.lit(True).alias("on_front"))
    out = told.join(front, "trial", "left").withColumn("on_front", F.coalesce("on_front", F.lit(False)))
    return out.orderBy(F.desc("on_front"), F.desc("score"), "trial").limit(top)


def top_strategies(enriched: DataFrame, proposals: list[dict], told: DataFrame, top: int = 10, draws: int = 500, splits: int = 3, fine: DataFrame | None = None) -> DataFrame:
    """The best trials with their rules, in- and out-of-sample means, a permutation test of their trades, and what stands after false discovery."""
    ranked = best_trials(told, top)
    numbers = [r.trial for r in ranked.select("trial").collect()]  # at most `top`
    chosen = [p for p in proposals if p["trial"] in numbers]
    spark = enriched.sparkSession
    rules = spark.createDataFrame([(p["trial"], rule_text(p)) for p in chosen], "trial int, rules string")
    found, keys = trial_trades(enriched, chosen, splits, fine=fine)
    oos = metrics(found, ("trial", *IN_FOLD), series=keys)
    inside = evaluate(enriched, chosen, splits, fine=fine, part="is")
    mean = lambda df, p: df.groupBy("trial").agg(F.avg("total_return").alias(f"{p}_return"), *(F.avg(c).alias(f"{p}_{c}") for c in ("win_rate", "sharpe", "profit_factor", "expectancy")), F.sum("total_trades").alias(f"{p}_trades"))
    returns = found.withColumn("r", F.col("pnl_pct") / 100 * F.col("position_size"))
    tested = rules.select("trial").join(permutation(returns, "trial", draws=draws, flip_signs=True), "trial", "left").withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))
    out = ranked.join(rules, "trial").join(mean(oos, "oos"), "trial").join(mean(inside, "is"), "trial")
    return out.join(false_discovery(tested, order=("trial",)), "trial")


def scores(results: DataFrame, n_series: int, least_trades: float = 5) -> DataFrame:
    """trial, mean_sharpe, mean_return, coverage, score: -999 where the mean number of trades a series is too small."""
    per = results.groupBy("trial", "symbol", "timeframe").agg(F.avg("sharpe").alias("sharpe"), F.avg("total_return").alias("ret"), F.avg("profit_factor").alias("pf"), F.sum("total_trades").alias("n"))
    one = per.groupBy("trial").agg(F.avg("sharpe").alias("mean_sharpe"), F.avg("ret").alias("mean_return"), F.avg(F.least("pf", F.lit(5.0))).alias("_pf"), F.avg("n").alias("mean_trades"), (F.count_if(F.col("ret") > 0) / n_series).alias("coverage"))
    return one.withColumn("score", composite(F.col("mean_sharpe"), F.col("mean_return"), F.col("_pf"), F.col("coverage"), F.col("mean_trades"), least_trades)).drop("_pf")


def composite(sharpe: Column, ret: Column, profit_factor: Column, coverage: Column, n: Column, least: float) -> Column:
    value = sharpe + 0.1 * F.log1p(F.greatest(F.lit(0.0), ret)) + 0.2 * (profit_factor - 1) + F.when(coverage >= 0.5, 0.3).otherwise(0.0)
    return F.when(n < least, -999.0).otherwise(value)


def _unbeaten(results: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(first), F.desc(second)).rowsBetween(Window.unboundedPreceding, -1)
    better = F.max(second).over(w)
    same = F.max(F.struct(second, first)).over(w)
    # equal rows don't beat each other
    tie = (same[second] == F.col(second)) & (same[first] == F.col(first))
    return results.withColumns({"_b": better, "_t": tie}).where("_b is null or _b < " + f"`{second}` or _t").drop("_b", "_t")


def pareto(results: DataFrame, first: str, second: str, parts: int = 256) -> DataFrame:
    """The rows that no other beats in one measure without loss in the other: by order, no pairs.

    Rows are dealt by hash over parts first, and those unbeaten in theirs,
    mostly few, by ranges of the first measure. A range is ordered by itself;
    of the ranges above it the best second measure is all that counts.
    """
    dealt = results.withColumn("_part", F.pmod(F.xxhash64(first, second), F.lit(parts)))
    left = ranges(_unbeaten(dealt, first, second, ["_part"]).drop("_part"), first)
    # equal first measures may lie in two ranges: of such rows only those with the best second measure count
    tops = left.groupBy("_slice").agg(F.max(first).alias("_high"), F.max(second).alias("_b"), F.max_by(second, F.struct(first, second)).alias("_at_high"))
    above = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    carried = tops.select("_slice", F.max("_b").over(above).alias("_above"))
    own = _unbeaten(left, first, second, ["_slice"]).join(F.broadcast(carried), "_slice")  # a row a shuffle partition
    few = own.where(F.col("_above").isNull() | (F.col(second) >= F.col("_above")))
    ties = few.groupBy(second).agg(F.max(first).alias("_most"))  # as good in the second measure: the best first one counts
    best = few.groupBy(first).agg(F.max(second).alias("_best"))
    return few.join(ties, second).where(F.col(first) == F.col("_most")).join(best, first).where(F.col(second) == F.col("_best")).select(*results.columns)


def rank_key(sharpe: Column, ret: Column, n: Column) -> Column:
    """The score of a threshold strategy."""
    return F.when(n < 5, -999.0).otherwise(sharpe + 0.01 * ret)


def proposals_table(spark: SparkSession, proposals: list[dict]) -> DataFrame:
    """The parameter sets as a table, with a hash for a name."""
    rows = [(p["trial"], {k: str(v) for k, v in p.items()}) for p in proposals]
    out = spark.createDataFrame(rows, "trial int, params map<string,string>")
    return out.withColumn("name", F.substring(F.md5(F.to_json("params")), 1, 8))
