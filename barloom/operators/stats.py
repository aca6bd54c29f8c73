"""Statistics of trades and returns: resampling, false discovery, benchmark, portfolio, correlation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import kept, numbered, with_halo
from ..functions.kernels import pearson

SAMPLES_PER_TASK = 100


def sharpe(r: np.ndarray) -> float:
    return float(r.mean() / (r.std() + 1e-9) * math.sqrt(252)) if len(r) > 1 else 0.0


def drawdown(equity: np.ndarray) -> float:
    """The deepest fall below the highest value so far, in percent."""
    top = np.maximum.accumulate(equity)
    return float(((top - equity) / (top + 1e-12)).max() * 100) if len(equity) else 0.0


def _measures(r: np.ndarray) -> tuple[float, float, float, float, float]:
    """Sharpe, return %, win rate, drawdown %, profit factor of returns in order."""
    curve = np.concatenate([[1.0], np.cumprod(1 + r)])
    gain, loss = r[r > 0].sum(), -r[r < 0].sum()
    return sharpe(r), (curve[-1] - 1) * 100, float((r > 0).mean()), drawdown(curve), gain / loss if loss else 2.0 if gain > 0 else 0.0


def resamples(found: DataFrame, by: str, value: str, order: str, draws: int, seed: int = 42) -> DataFrame:
    """by, draw, sharpe, return_pct, win_rate, max_drawdown, profit_factor: the returns of a group drawn again with replacement.

    Each group's returns become one array; draws are dealt in lots, so that a
    group's draws run in parallel. A draw's seed is (seed, draw).
    """
    own = found.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("r"))
    lots = own.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(SAMPLES_PER_TASK))))

    def run(batches):
        for rows in batches:
            out = []
            for key, r, first in zip(rows[by], rows["r"], rows["first"], strict=True):
                r = np.asarray(r, float)
                for draw in range(first, min(first + SAMPLES_PER_TASK, draws)):
                    out.append((key, draw, *_measures(np.random.default_rng([seed, draw]).choice(r, len(r)))))
            yield pd.DataFrame(out, columns=[by, "draw", "sharpe", "return_pct", "win_rate", "max_drawdown", "profit_factor"])

    kind = own.schema[by].dataType.simpleString()
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lots.repartition(parts).mapInPandas(run, f"{by} {kind}, draw int, sharpe double, return_pct double, win_rate double, max_drawdown double, profit_factor double")


def monte_carlo(found: DataFrame, by: str, value: str = "r", order: str = "exit_idx", draws: int = 2000, seed: int = 42) -> DataFrame:
    """Percentiles 5, 25, 50, 75, 95 of the draws' measures, and the shares of ruin (below -50 %) and of profit."""
    drawn = resamples(found, by, value, order, draws, seed)
    wanted = [0.05, 0.25, 0.5, 0.75, 0.95]
    return drawn.groupBy(by).agg(*(F.percentile(c, F.array(*map(F.lit, wanted))).alias(f"{c}_percentiles") for c in ("sharpe", "return_pct", "win_rate", "max_drawdown")), F.avg((F.col("return_pct") < -50).cast("double")).alias("prob_ruin"), F.avg((F.col("return_pct") > 0).cast("double")).alias("prob_profitable"))


def bootstrap(found: DataFrame, by: str, value: str = "r", order: str = "exit_idx", draws: int = 1000, seed: int = 42) -> DataFrame:
    """95 % intervals of the measures."""
    drawn = resamples(found, by, value, order, draws, seed)
    ends = F.array(F.lit(0.025), F.lit(0.975))
    return drawn.groupBy(by).agg(*(F.percentile(c, ends).alias(f"{c}_ci") for c in ("sharpe", "win_rate", "max_drawdown", "return_pct", "profit_factor")))


def permutation(found: DataFrame, by: str, value: str = "r", draws: int = 1000, seed: int = 42, flip_signs: bool = False) -> DataFrame:
    """by, p_value: the share of permuted Sharpe ratios at least as high as the observed; 1 below ten returns.

    Sharpe doesn't depend on order, so shuffling (the default) says nothing;
    flip_signs tests against symmetric returns instead.
    """
    kind = found.schema[by].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows[value].sort_values().to_numpy(float)
        if len(r) < 10:
            return pd.DataFrame({by: [rows[by].iloc[0]], "p_value": [1.0]})
        rng, seen = np.random.default_rng(seed), sharpe(r)
        new = [sharpe(r * rng.choice([-1, 1], len(r)) if flip_signs else rng.permutation(r)) for _ in range(draws)]
        return pd.DataFrame({by: [rows[by].iloc[0]], "p_value": [float(np.mean(np.array(new) >= seen - 1e-12))]})

    return found.select(by, value).groupBy(by).applyInPandas(run, f"{by} {kind}, p_value double")


def ranges(df: DataFrame, *order: str) -> DataFrame:
    """df with _slice: consecutive ranges of the order, cut where a sample of the rows says that they are equal in size; written once, in the shared folder.

    Rows that are equal in the order are told apart by a hash of the row, _h, so values of which there are very many are cut, too.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_h", F.xxhash64(*df.columns)).repartitionByRange(n, *order, "_h")
    return kept(dealt.withColumn("_slice", F.spark_partition_id()))


def false_discovery(tests: DataFrame, p: str = "p_value", alpha: float = 0.05, order: tuple[str, ...] = ()) -> DataFrame:
    """Benjamini-Hochberg: rank, adjusted_p, is_significant, fdr_threshold.

    p-values are dealt by ranges of equal size and ranked within; counts and
    minima of the ranges, a row each, give each range its offset and what the
    ranks above it allow. A job runs when it is called.
    """
    w = Window.partitionBy("_slice").orderBy(p, *order, "_h")
    own = ranges(tests, p, *order)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # over slices
    sizes = own.groupBy("_slice").agg(F.count("*").alias("_c")).select("_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    ranked = own.join(F.broadcast(sizes), "_slice").withColumn("fdr_rank", (F.row_number().over(w) + F.col("_before")).cast("int"))  # a row a shuffle partition
    ranked = ranked.withColumns({"_raw": F.col(p) * F.col("_n") / F.col("fdr_rank"), "_limit": F.col("fdr_rank") / F.col("_n") * alpha})
    after = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)  # over slices
    ends = ranked.groupBy("_slice").agg(F.min("_raw").alias("_m"), F.max(F.when(F.col(p) <= F.col("_limit"), F.col("_limit"))).alias("_t"))
    ends = ends.select("_slice", F.min("_m").over(after).alias("_least"), F.coalesce(F.max("_t").over(Window.partitionBy()), F.lit(0.0)).alias("fdr_threshold"))
    inside = F.min("_raw").over(Window.partitionBy("_slice").orderBy(F.desc("fdr_rank")).rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.join(F.broadcast(ends), "_slice").withColumn("adjusted_p", F.least(F.lit(1.0), inside, "_least"))
    return out.withColumn("is_significant", F.col("adjusted_p") <= alpha).select(*tests.columns, "fdr_rank", "adjusted_p", "fdr_threshold", "is_significant")


#: Places of a path that one task orders.
PART = 1 << 16


def parted(df: DataFrame, at: str) -> DataFrame:
    """df with _part: stretches of PART places (whole numbers)."""
    return df.withColumn("_part", F.floor(F.col(at) / PART).cast("long"))


def running_total(df: DataFrame, at: str, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df, which has _part, with the running total of value over the places: in each part by itself, and the totals of the parts before."""
    sums = df.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    carried = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_carried"))
    local = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(carried, [*by, "_part"]).withColumn(name, F.coalesce(local, F.lit(0.0)) + F.col("_carried")).drop("_carried")


def path_parts(df: DataFrame, at: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, _part, first, last, peak, trough, fall: what a path's part has to tell of the whole path; fall is the deepest one below the highest value before, as a share."""
    top = F.max(value).over(Window.partitionBy(*by, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_top", top).groupBy(*by, "_part").agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.max(value).alias("peak"), F.min(value).alias("trough"), F.max((F.col("_top") - F.col(value)) / (F.col("_top") + 1e-12)).alias("fall"))


def joined(parts: DataFrame, by: tuple[str, ...] = (), start: str | None = None) -> DataFrame:
    """by, first, last, peak, trough, fall of whole paths from their parts; the column start, if named, is a value before the first part.

    Parts of parts can be joined first, in any grouping of neighbours: a fall
    of two neighbours is the deeper of theirs and of the one from the first's
    peak to the second's trough.
    """
    before = F.max("peak").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    before = F.greatest(before, F.col(start)) if start else before
    across = parts.withColumn("_before", before).withColumn("fall", F.greatest("fall", (F.col("_before") - F.col("trough")) / (F.col("_before") + 1e-12)))
    return across.groupBy(*by).agg(F.min_by("first", "_part").alias("first"), F.max_by("last", "_part").alias("last"), F.max("peak").alias("peak"), F.min("trough").alias("trough"), F.max("fall").alias("fall"))


def benchmark(bars: DataFrame, by: tuple[str, ...] = ("symbol", "timeframe"), rows: int | None = None) -> DataFrame:
    """Buy and hold: total_return, sharpe, max_drawdown, first and last close; zeros below two bars.

    With `rows`, a series is the work of several tasks, of so many bars each.
    """
    own = bars.where(F.col("close").isNotNull() & ~F.isnan("close") & (F.abs("close") < float("inf")))
    if rows is None:
        own = own.withColumns({"_part": F.lit(0), "_own": F.lit(True)})
    else:
        own = with_halo(numbered(own, rows, by), rows, 1).withColumnRenamed("_chunk", "_part")
    before = F.lag("close").over(Window.partitionBy(*by, "_part").orderBy("ts"))
    own = own.withColumn("_r", F.try_divide(F.col("close") - before, F.nullif(before, F.lit(0.0)))).where("_own")
    r = own.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_r").alias("_mean"), F.stddev_pop("_r").alias("_sd"))
    enough, zero = F.col("_n") >= 2, F.lit(0.0)
    told = joined(path_parts(own, "ts", "close", by), by).join(r, list(by))
    return told.select(
        *by, F.when(enough, (F.try_divide(F.col("last"), F.nullif(F.col("first"), zero)) - 1) * 100).otherwise(zero).alias("benchmark_return"),
        F.when(enough, F.col("_mean") / (F.col("_sd") + 1e-9) * 252**0.5).otherwise(zero).alias("benchmark_sharpe"),
        F.when(enough, F.col("fall") * 100).otherwise(zero).alias("benchmark_max_drawdown"), F.col("first").alias("first_close"), F.col("last").alias("last_close"),
    )


def steps(found: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """by, step, r: the returns of each pair by their place."""
    return found.select(by, (F.row_number().over(Window.partitionBy(by).orderBy(order))).alias("step"), F.col(value).alias("r"))


def portfolio(found: DataFrame, by: str, n_pairs: int, value: str = "r", order: str = "exit_idx", capital: float = 10_000.0) -> DataFrame:
    """One row: Sharpe and Sortino of all returns, and return and drawdown of the summed curves.

    Capital is split over all n_pairs; only pairs with trades have a curve,
    which keeps its last value where others go on.
    """
    own = steps(found, by, value, order)
    w = Window.partitionBy(by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    size = F.exp(F.sum(F.ln(F.abs(F.nullif(1 + F.col("r"), F.lit(0.0))))).over(w))
    sign = F.when(F.sum(F.when(1 + F.col("r") < 0, 1).otherwise(0)).over(w) % 2 == 1, -1.0).otherwise(1.0)
    curve = own.withColumn("equity", capital / n_pairs * sign * size)
    # a pair adds its change at each step; the running total of changes is the sum of the padded curves
    before = F.coalesce(F.lag("equity").over(Window.partitionBy(by).orderBy("step")), F.lit(capital / n_pairs))
    change = curve.withColumn("change", F.col("equity") - before).groupBy("step").agg(F.sum("change").alias("change"))
    start = own.agg(F.countDistinct(by).alias("traded")).select((F.col("traded") * (capital / n_pairs)).alias("start"))
    path = running_total(parted(change, "step"), "step", "change", "_total").join(F.broadcast(start)).withColumn("equity", F.col("start") + F.col("_total"))
    whole = joined(path_parts(path, "step", "equity").join(F.broadcast(start)), start="start")
    ends = whole.join(F.broadcast(start)).select(((F.col("last") / F.col("start") - 1) * 100).alias("portfolio_return"), (F.greatest(F.col("fall"), F.lit(0.0)) * 100).alias("portfolio_max_drawdown"))
    r = F.col("r")
    risk = own.agg(F.when(F.count("*") < 2, 0.0).otherwise(F.avg(r) / (F.stddev_pop(r) + 1e-9) * 252**0.5).alias("portfolio_sharpe"), F.when(F.count("*") < 2, 0.0).otherwise(F.avg(r) / (F.coalesce(F.stddev_pop(F.when(r < 0, r)), F.lit(0.0)) + 1e-9) * 252**0.5).alias("portfolio_sortino"), F.count("*").alias("n_returns"))
    return risk.join(F.broadcast(ends))


def ranked(df: DataFrame, by: tuple[str, ...], columns: list[str], prefix: str = "rank_") -> DataFrame:
    """df with average ranks of the columns within the groups."""
    out = df
    for c in columns:
        out = out.withColumn(f"{prefix}{c}", F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2)
    return out


def mean_spearman(found: DataFrame, by: str, value: str = "r", order: str = "exit_idx") -> DataFrame:
    """One row: the mean rank correlation of all pairs' returns, shorter ones padded with 0; 0 below two pairs.

    No pair is formed: with ranks as unit vectors z, the mean of all products
    is (|sum of z|^2 - m) / (m (m - 1)), and the sum needs one value a step.
    Padding is the same at each step a series lacks, so it is summed by length.
    """
    own = steps(found, by, value, order)
    longest = own.agg(F.max("step").cast("double").alias("_s"))
    r = F.col("r")
    # ranks among all steps: zeros, padded ones among them, lie between the negative and the positive
    told = own.groupBy(by).agg(F.count("*").alias("_n"), F.count_if(r < 0).alias("_below"), F.count_if(r == 0).alias("_zeros")).crossJoin(F.broadcast(longest))  # one row
    told = told.withColumns({"_pad": F.col("_s") - F.col("_n"), "_none": F.col("_below") + (F.col("_zeros") + F.col("_s") - F.col("_n") + 1) / 2})
    r = ranked(own, (by,), ["r"]).join(told, by).withColumn("_rank", F.when(F.col("r") < 0, F.col("rank_r")).when(F.col("r") > 0, F.col("rank_r") + F.col("_pad")).otherwise(F.col("_none")) - (F.col("_s") + 1) / 2)
    none = F.col("_none") - (F.col("_s") + 1) / 2
    size = r.groupBy(by).agg(F.sqrt(F.sum(F.col("_rank") ** 2) + F.first("_pad") * F.first(none) ** 2).alias("_size")).where("_size > 1e-9")
    unit = r.join(size, by)
    at = unit.groupBy("step").agg(F.sum(F.col("_rank") / F.col("_size")).alias("_z"), F.lit(0.0).alias("_later"))
    padding = told.join(size, by).where("_pad > 0").groupBy((F.col("_n") + 1).cast("int").alias("step")).agg(F.lit(0.0).alias("_z"), F.sum(none / F.col("_size")).alias("_later"))
    both = at.unionByName(padding).groupBy("step").agg(F.sum("_z").alias("_z"), F.sum("_later").alias("_later"))
    so_far = running_total(parted(both, "step"), "step", "_later", "_so_far")
    total = so_far.select((F.col("_z") + F.col("_so_far")).alias("_t")).agg(F.sum(F.col("_t") ** 2).alias("_t"))
    m = F.col("_m")
    out = total.crossJoin(size.agg(F.count("*").cast("double").alias("_m")))  # a row on either side
    return out.select(F.when(m < 2, 0.0).otherwise((F.col("_t") - m) / F.nullif(m * (m - 1), F.lit(0.0))).alias("avg_correlation"), (m * (m - 1) / 2).cast("long").alias("n_pairs"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, low, high, n over the column's range; equal widths."""
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(column) - F.col("_low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).cast("int")
    out = df.where(F.col(column).isNotNull()).join(F.broadcast(ends)).withColumns({"bin": place, "_width": width})
    return out.groupBy("bin").agg((F.first("_low") + F.col("bin") * F.first("_width")).alias("low"), (F.first("_low") + (F.col("bin") + 1) * F.first("_width")).alias("high"), F.count("*").alias("n"))


def t_sf(t: float, df: float) -> float:
    """Two-sided p-value of Student's t by the incomplete beta function's continued fraction."""
    if not df > 0 or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                c = 1 + top / c
                d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * fraction(a, b, x) / a)
    return max(0.0, 1 - front * fraction(b, a, 1 - x) / b)
