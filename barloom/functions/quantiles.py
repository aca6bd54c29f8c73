"""Exact quantiles of groups of any size, by counting.

`percentile` keeps all distinct values of a group in one aggregation buffer.
Here each wanted rank has an interval that holds its value; a pass counts the
group's values in BINS equal parts of it, and the part in which the rank falls,
from its smallest to its largest value, is the next interval. It ends where
all values of the interval are one, after a few passes for most data. A pass
shuffles BINS counts a rank and task at most, however large the group.

The intervals of groups with more than LARGE values are sent to the rows, so no
group's rows come together in a task; rows of smaller groups meet theirs by a
shuffle. Of the large groups there is one in LARGE rows at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept

BINS = 1024
#: Values of a group above which its rows are counted where they are.
LARGE = 100_000


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], most_passes: int = 400) -> DataFrame:
    """by, n, quantiles (array, in the order of shares; between two values in proportion), a row a group; NULL and NaN are left out.

    Groups without a value, or by NULL, have no row. Runs a job a pass when called.
    """
    rows = kept(df.select(*by, F.nullif(F.col(value).cast("double"), F.lit(float("nan"))).alias("_v")).where("_v is not null"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.array(*(f(place(p)).cast("long") for p in shares for f in (F.floor, F.ceil))))
    sizes = ends.select(*by, "n")
    large = F.broadcast(kept(sizes.where(F.col("n") > LARGE).select(*by)))
    of_small = rows.join(large, by, "left_anti")
    open_ = kept(ends.select(*by, (F.col("n") > LARGE).alias("_large"), F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "low", "high"))
    found = open_.where("low = high").select(*by, "rank", F.col("low").alias("x"))
    for _ in range(most_passes):
        open_ = open_.where("low < high")
        kinds = {r[0] for r in open_.select("_large").distinct().collect()}
        if not kinds:
            break
        met = [rows.join(F.broadcast(open_.where("_large")), by)] if True in kinds else []
        met += [of_small.join(open_.where("not _large").hint("shuffle_merge"), by)] if False in kinds else []
        inside = reduce(DataFrame.unionByName, met).where((F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high")))
        # halves, so that the width of an interval is a number, too
        part = F.least(F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1)).cast("int")
        counts = inside.groupBy(*by, "rank", part.alias("part")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.first("below").alias("below"), F.first("_large").alias("_large"))
        before = Window.partitionBy(*by, "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows
        told = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        open_ = kept(told.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("c"))).select(*by, "_large", "rank", "below", "low", "high"))
        found = found.unionByName(open_.where("low = high").select(*by, "rank", F.col("low").alias("x")))
    else:
        raise RuntimeError("quantiles did not settle")
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_x"))  # two ranks a share
    at = lambda f, p: F.col("_x")[f(place(p)).cast("long")]
    between = [at(F.floor, p) + (at(F.ceil, p) - at(F.floor, p)) * (place(p) - F.floor(place(p))) for p in shares]
    return sizes.join(values, by).select(*by, "n", F.array(*between).alias("quantiles"))
