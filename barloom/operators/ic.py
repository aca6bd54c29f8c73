"""Information coefficients: rank correlation of indicators and conditions with what prices do next."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import pearson
from .stats import ranked, t_sf

#: The horizons in bars.
HORIZONS = (1, 5, 10, 20, 40)
BY = ("symbol", "timeframe")


def forward_return(n: int, by: tuple[str, ...] = BY) -> Column:
    w = Window.partitionBy(*by).orderBy("ts")
    return F.try_divide(F.lead("close", n).over(w), F.nullif(F.col("close"), F.lit(0.0))) - 1


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """symbol, timeframe, ts, close, col, value."""
    return df.unpivot([*BY, "ts", "close"], [F.col(c).cast("double").alias(c) for c in columns], "col", "value")


def strength(x: Column) -> Column:
    return F.when(F.abs(x) >= 0.2, "strong").when(F.abs(x) >= 0.1, "moderate").when(F.abs(x) >= 0.05, "weak").otherwise("noise")


def _p(rho: pd.Series, n: pd.Series) -> pd.Series:
    safe = rho.clip(-1 + 1e-15, 1 - 1e-15)
    return pd.Series([t_sf(float(r) * np.sqrt((k - 2) / (1 - float(r) ** 2)), float(k - 2)) if k > 2 and not np.isnan(r) else np.nan for r, k in zip(safe, n, strict=True)])


def p_value(rho: Column, n: Column) -> Column:
    return F.pandas_udf(_p, "double")(rho, n)


def information(df: DataFrame, columns: list[str], horizons: tuple[int, ...] = HORIZONS, least: int = 30, series: tuple[str, ...] = BY) -> DataFrame:
    """The keys of the series, col, horizon, n, ic: Spearman's correlation of each column with each forward return.

    Pairs with a NULL are left out before ranking; below `least` pairs the
    coefficient is NULL. Columns and horizons become rows, so a wide request is
    parallel over (series, column, horizon).
    """
    w = [forward_return(h, series).alias(f"_f{h}") for h in horizons]
    base = df.select(*series, "ts", *columns, *w)
    future = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("future")) for h in horizons)))
    value = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in columns)))
    rows = base.withColumn("_v", value).where("_v.value is not null").withColumn("_f", future).select(*series, "ts", "_v.col", "_v.value", "_f.horizon", "_f.future").where("future is not null")
    by = (*series, "col", "horizon")
    r = ranked(rows, by, ["value", "future"])
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, pearson("rank_value", "rank_future")).alias("ic"))


def summary(per_series: DataFrame) -> DataFrame:
    """By column: the mean coefficient of each horizon, the best horizon, direction and strength."""
    mean = per_series.groupBy("col", "horizon").agg(F.avg("ic").alias("ic"), F.count("ic").alias("n_series"))
    best = F.max_by(F.struct("horizon", "ic"), F.struct(F.abs("ic").alias("size"), -F.col("horizon")))
    out = mean.where("ic is not null").groupBy("col").agg(best.alias("b"), F.max(F.abs("ic")).alias("max_abs_ic"), F.max("n_series").alias("n_series"))
    return out.select("col", F.col("b.horizon").alias("best_period"), F.col("b.ic").alias("best_ic"), "max_abs_ic", F.when(F.col("b.ic") >= 0, "bullish").otherwise("bearish").alias("direction"), strength(F.col("b.ic")).alias("strength"), "n_series")


def stability(df: DataFrame, columns: list[str], horizon: int = 10, least: int = 60) -> DataFrame:
    """symbol, timeframe, col, ic_mean, ic_std, icir, positive_share of rolling coefficients of global ranks; icir is mean over deviation.

    The window is max(30, n // 5) rows, every max(1, n // 20)th value counts.
    All are NULL for series of fewer than `least` rows or three values.
    """
    rows = unpivot(df.withColumn("_f", forward_return(horizon)).withColumn("close", F.col("_f")), columns).where("value is not null and close is not null")
    r = ranked(rows, (*BY, "col"), ["value", "close"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts", kind="stable")
        n = len(g)
        w = max(30, n // 5)
        x = g["rank_value"].rolling(w, min_periods=max(20, w // 2)).corr(g["rank_close"]).iloc[:: max(1, n // 20)]
        x = x[np.isfinite(x)]
        sd = float(x.std(ddof=0)) if len(x) else 0.0
        told = n >= least and len(x) >= 3
        keys = {c: [g[c].iloc[0]] for c in (*BY, "col")}
        if not told:
            return pd.DataFrame(keys | {c: [None] for c in ("ic_mean", "ic_std", "icir", "positive_share")})
        return pd.DataFrame(keys | {"ic_mean": [float(x.mean())], "ic_std": [sd], "icir": [float(x.mean() / sd) if sd > 1e-6 else 0.0], "positive_share": [float((x > 0).mean())]})

    return r.groupBy(*BY, "col").applyInPandas(run, "symbol string, timeframe string, col string, ic_mean double, ic_std double, icir double, positive_share double")


def report(per_series: DataFrame, stable: DataFrame | None = None, top: int = 20) -> DataFrame:
    """The `top` columns by the size of their coefficient: `summary`, the mean at each horizon and, if given, the mean stability."""
    wide = per_series.groupBy("col").agg(*(F.avg(F.when(F.col("horizon") == h, F.col("ic"))).alias(f"ic_{h}") for h in HORIZONS))
    out = summary(per_series).join(wide, "col")
    if stable is not None:
        out = out.join(stable.groupBy("col").agg(F.avg("icir").alias("icir"), F.avg("positive_share").alias("ic_positive_pct")), "col", "left")
    return out.orderBy(F.desc("max_abs_ic"), "col").limit(top)


def lookup(found: DataFrame, top: int = 20) -> dict[str, float]:
    """For a search: of the `top` columns of a report, the size of the coefficient by name."""
    rows = found.select("col", "max_abs_ic").orderBy(F.desc("max_abs_ic"), "col").limit(top).collect()  # `top` rows
    return {r["col"]: r["max_abs_ic"] or 0.0 for r in rows if r["col"]}


def conditions(df: DataFrame, columns: list[str], horizon: int = 10, least: int = 30) -> DataFrame:
    """By condition (0/1 columns): mean coefficient and hit rate over the series in which it holds in 0.5 % to 99 % of the rows."""
    rate = df.groupBy(*BY).agg(*(F.avg(c).alias(c) for c in columns)).unpivot([*BY], columns, "col", "hit_rate")
    found = information(df, columns, (horizon,), least).join(rate, [*BY, "col"]).where("hit_rate >= 0.005 and hit_rate <= 0.99 and ic is not null")
    out = found.groupBy("col").agg(F.avg("ic").alias("ic"), F.avg("hit_rate").alias("hit_rate"), F.count("*").alias("n_series"))
    return out.select("col", "ic", F.abs("ic").alias("abs_ic"), "hit_rate", F.when(F.col("ic") >= 0, "bullish").otherwise("bearish").alias("direction"), strength(F.col("ic")).alias("strength"), "n_series")


def combinations_of(df: DataFrame, columns: list[str], single: DataFrame, horizon: int = 10, top: int = 15) -> DataFrame:
    """Two conditions at once: mean coefficient, hit rate, synergy (over the better of the two). single: `conditions` of them.

    The `top` conditions by absolute coefficient are paired: at most top * (top - 1) / 2 columns.
    """
    best = single.orderBy(F.desc("abs_ic"), "col").limit(top)
    names = sorted(r.col for r in best.select("col").collect())  # at most `top` names
    pairs = list(combinations([n for n in columns if n in names], 2))
    if not pairs:
        return single.select(F.col("col").alias("label_a"), F.col("col").alias("label_b"), "ic", "hit_rate", F.lit(0.0).alias("synergy"), F.lit(False).alias("synergistic")).limit(0)
    both = df.select(*BY, "ts", "close", *((F.col(a) * F.col(b)).alias(f"{a}&{b}") for a, b in pairs))
    joint = conditions(both, [f"{a}&{b}" for a, b in pairs], horizon).where("n_series >= 2").withColumn("_s", F.split("col", "&"))
    a, b = single.select(F.col("col").alias("label_a"), F.col("abs_ic").alias("_a")), single.select(F.col("col").alias("label_b"), F.col("abs_ic").alias("_b"))
    out = joint.withColumns({"label_a": F.col("_s")[0], "label_b": F.col("_s")[1]}).join(F.broadcast(a), "label_a").join(F.broadcast(b), "label_b")
    out = out.withColumn("synergy", F.try_divide(F.abs("ic"), F.nullif(F.greatest("_a", "_b"), F.lit(0.0))))
    return out.select("label_a", "label_b", "ic", "hit_rate", "synergy", ((F.col("synergy") > 1.05) & (F.abs("ic") > 0.03)).alias("synergistic"))


#: The five regimes.
REGIMES = ("bull", "bear", "ranging", "high_vol", "low_vol")


def regimes(df: DataFrame) -> DataFrame:
    """df (with EMA50_slope and NATR_14) once for each regime that a row is in, in the column regime."""
    ends = df.groupBy(*BY).agg(F.percentile("NATR_14", F.lit(0.75)).alias("_high"), F.percentile("NATR_14", F.lit(0.25)).alias("_low"))
    slope, natr = F.col("EMA50_slope"), F.col("NATR_14")
    tests = (slope > 0.05, slope < -0.05, F.abs(slope) <= 0.05, natr >= F.col("_high"), natr <= F.col("_low"))
    named = F.array_compact(F.array(*(F.when(t, n) for t, n in zip(tests, REGIMES, strict=True))))
    return df.join(ends, [*BY]).withColumn("regime", F.explode(named)).drop("_high", "_low")


def by_regime(df: DataFrame, columns: list[str], horizon: int = 10, least: int = 20, rows: int = 50) -> DataFrame:
    """symbol, timeframe, regime, col, n, ic; forward returns run over the regime's own rows, one after the other."""
    series = (*BY, "regime")
    enough = regimes(df).withColumn("_n", F.count("*").over(Window.partitionBy(*series))).where(F.col("_n") >= rows)
    return information(enough, columns, (horizon,), least, series).select(*series, "col", "n", "ic")


def regime_label(df: DataFrame, least: int = 50) -> DataFrame:
    """symbol, timeframe, regime by the medians: volatile, bull, bear or ranging; all below so many rows."""
    m = df.groupBy(*BY).agg(F.count("*").alias("n"), F.percentile("EMA50_slope", F.lit(0.5)).alias("slope"), F.percentile("NATR_14", F.lit(0.5)).alias("natr"))
    named = F.when(F.col("n") < least, "all").when(F.col("natr") > 4, "volatile").when(F.col("slope") > 0.05, "bull").when(F.col("slope") < -0.05, "bear").otherwise("ranging")
    return m.select(*BY, named.alias("regime"), "slope", "natr")


def informative(df: DataFrame, columns: list[str], keep: float = 0.01) -> list[str]:
    """The numeric columns that are worth a coefficient, by one pass: filled in over half of the rows and not all but constant.

    A column of at most two values counts if the rarer one has at least `keep` of its rows.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    own = [c for c in columns if kinds[c] in ("double", "float", "integer", "long", "short", "byte", "decimal")]
    if not own:
        return []
    row = df.agg(F.count("*").alias("_n"), *(f(c).alias(f"{n}{i}") for i, c in enumerate(own) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    ends = df.agg(F.lit(0).alias("_"), *(F.avg(F.col(c).isin(row[f"lo{i}"]).cast("double")).alias(f"a{i}") for i, c in enumerate(own)), *(F.avg(F.col(c).isin(row[f"hi{i}"]).cast("double")).alias(f"b{i}") for i, c in enumerate(own))).first()
    return [c for i, c in enumerate(own) if row[f"n{i}"] * 2 > row["_n"] and row[f"lo{i}"] != row[f"hi{i}"] and max(ends[f"a{i}"] or 0, ends[f"b{i}"] or 0) <= 1 - keep]
