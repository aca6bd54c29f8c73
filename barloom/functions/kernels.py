"""Window kernels over a bar series: every indicator that is no recursion is made of these.

All use one partitioning and order, so that Catalyst puts them into one sort.
Where a series is cut into chunks (chunks.py), that is a chunk with the rows
ahead of it, and running values begin with what is carried into it. A trailing frame is NULL until it is full and free of NULLs. Divisions by zero
give NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .chunks import KEYS, carries


def series():
    """The window of a series, or of a chunk's group where there are chunks; needs a session, so it is made when asked for."""
    return Window.partitionBy(*KEYS, *(["_chunk"] if carries() else [])).orderBy("ts")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(n: int):
    return series().rowsBetween(1 - n, 0)


def lag(x, n: int = 1) -> Column:
    return F.lag(col(x), n).over(series())


def lead(x, n: int = 1) -> Column:
    return F.lead(col(x), n).over(series())


def diff(x, n: int = 1) -> Column:
    return col(x) - lag(x, n)


def ratio(a, b) -> Column:
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0.0)))


def pct_change(x, n: int = 1) -> Column:
    return ratio(x, lag(x, n)) - 1


def full(x, n: int, value: Column) -> Column:
    """value where the trailing frame of n rows holds n values of x."""
    return F.when(F.count(col(x)).over(frame(n)) == n, value)


def rolling(x, n: int, aggregate) -> Column:
    return full(x, n, aggregate(col(x)).over(frame(n)))


def sma(x, n: int) -> Column:
    return rolling(x, n, F.avg)


def total(x, n: int) -> Column:
    return rolling(x, n, F.sum)


def highest(x, n: int) -> Column:
    return rolling(x, n, F.max)


def lowest(x, n: int) -> Column:
    return rolling(x, n, F.min)


def deviation(x, n: int) -> Column:
    return rolling(x, n, F.stddev_samp)


def quantile(x, n: int, q: float) -> Column:
    return rolling(x, n, lambda c: F.percentile(c, F.lit(q)))


def skewness(x, n: int) -> Column:
    """Bias-corrected."""
    return rolling(x, n, F.skewness) * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurtosis(x, n: int) -> Column:
    """Bias-corrected excess."""
    return ((n + 1) * rolling(x, n, F.kurtosis) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def window_values(x, n: int) -> Column:
    return F.collect_list(col(x)).over(frame(n))


def percent_rank(x, n: int) -> Column:
    """Share of the frame that is smaller, ties at their mean rank."""
    values, c = window_values(x, n), col(x)
    below = F.size(F.filter(values, lambda v: v < c))
    same = F.size(F.filter(values, lambda v: v == c))
    return full(x, n, (below + (same + 1) / 2) / n)


def mean_deviation(x, n: int) -> Column:
    """Mean absolute deviation from the frame's mean."""
    mean = F.avg(col(x)).over(frame(n))
    return full(x, n, F.aggregate(window_values(x, n), F.lit(0.0), lambda s, v: s + F.abs(v - mean)) / n)


def pearson(a, b, over=lambda x: x) -> Column:
    """Pearson's correlation of the rows in which both have values; NULL where a side is constant.

    `corr` itself divides by zero there. `over` puts the aggregates over a frame.
    """
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    moves = (over(F.max(x)) > over(F.min(x))) & (over(F.max(y)) > over(F.min(y)))
    spread = over(F.stddev_pop(x)) * over(F.stddev_pop(y))
    return F.when(moves, F.try_divide(over(F.covar_pop(x, y)), F.nullif(spread, F.lit(0.0))))


def correlation(a, b, n: int) -> Column:
    both = F.when(col(a).isNotNull() & col(b).isNotNull(), 1)
    return F.when(F.count(both).over(frame(n)) == n, pearson(a, b, lambda x: x.over(frame(n))))


def weighted(x, weights: list[float]) -> Column:
    """Sum of the trailing values by fixed weights, oldest first."""
    n = len(weights)
    return reduce(lambda a, b: a + b, (F.lit(float(w)) * (lag(x, n - 1 - i) if i < n - 1 else col(x)) for i, w in enumerate(weights)))


def wma(x, n: int) -> Column:
    return weighted(x, [2 * (i + 1) / (n * (n + 1)) for i in range(n)])


def linreg(x, n: int) -> tuple[Column, Column]:
    """Slope and the line's value at the frame's first row, over places 0 to n - 1."""
    middle = (n - 1) / 2
    spread = sum((i - middle) ** 2 for i in range(n))
    slope = weighted(x, [(i - middle) / spread for i in range(n)])
    return slope, sma(x, n) - slope * middle


def running_sum(x) -> Column:
    return carries().of("sum", col(x)) if carries() else F.sum(col(x)).over(series().rowsBetween(Window.unboundedPreceding, 0))


def running_max(x) -> Column:
    return carries().of("max", col(x)) if carries() else F.max(col(x)).over(series().rowsBetween(Window.unboundedPreceding, 0))


def last_value(x) -> Column:
    """The last value so far that isn't NULL."""
    return carries().of("last", col(x)) if carries() else F.last(col(x), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))


def row_number() -> Column:
    return F.col("_i") + 1 if carries() else F.row_number().over(series())


def flag(condition: Column) -> Column:
    """1 or 0; unknown is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def crossed_above(a, b) -> Column:
    """a was not above b and is now; a number has no past of its own."""
    before = F.lit(float(b)) if isinstance(b, (int, float)) else lag(b)
    now = F.lit(float(b)) if isinstance(b, (int, float)) else col(b)
    return F.coalesce((lag(a) <= before) & (col(a) > now), F.lit(False))


def crossed_below(a, b) -> Column:
    before = F.lit(float(b)) if isinstance(b, (int, float)) else lag(b)
    now = F.lit(float(b)) if isinstance(b, (int, float)) else col(b)
    return F.coalesce((lag(a) >= before) & (col(a) < now), F.lit(False))


def bars_since(hit: Column) -> Column:
    """Rows since the last row where hit holds; NULL before the first."""
    n = row_number()
    return (n - running_max(F.when(hit, n))).cast("int")
