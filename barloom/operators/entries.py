"""Why entries win: effect sizes, filter suggestions, snapshots of winners, importances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import pearson


def effect_sizes(entries: DataFrame, columns: list[str]) -> DataFrame:
    """col, n_winners, n_losers, winner_mean, loser_mean, winner_p25, winner_p75, cohens_d: winners against losers, by one pass."""
    value = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in columns)))
    rows = entries.select("is_winner", value.alias("s")).select("is_winner", "s.col", "s.value").where("value is not null")
    won, lost = F.when(F.col("is_winner"), F.col("value")), F.when(~F.col("is_winner"), F.col("value"))
    out = rows.groupBy("col").agg(
        F.count(won).alias("n_winners"), F.count(lost).alias("n_losers"), F.avg(won).alias("winner_mean"), F.avg(lost).alias("loser_mean"), F.percentile(won, F.lit(0.25)).alias("winner_p25"), F.percentile(won, F.lit(0.75)).alias("winner_p75"), F.var_samp(won).alias("_v1"), F.var_samp(lost).alias("_v2")
    )
    spread = F.sqrt((F.col("_v1") + F.col("_v2")) / 2)
    d = F.when((F.col("n_winners") < 2) | (F.col("n_losers") < 2) | (spread < 1e-10), 0.0).otherwise((F.col("winner_mean") - F.col("loser_mean")) / F.nullif(spread, F.lit(0.0)))
    return out.withColumn("cohens_d", d).drop("_v1", "_v2")


def suggestions(effects: DataFrame, least_effect: float = 0.1, least: int = 5, top: int = 15) -> DataFrame:
    """Filters that would have helped: col, operator, threshold, cohens_d, abs_d; the `top` by effect."""
    up = F.col("cohens_d") > 0
    out = effects.where((F.abs("cohens_d") >= least_effect) & (F.col("n_winners") >= least) & (F.col("n_losers") >= least))
    return out.select("col", F.when(up, ">").otherwise("<").alias("operator"), F.when(up, F.col("winner_p25")).otherwise(F.col("winner_p75")).alias("threshold"), "winner_mean", "loser_mean", "cohens_d", F.abs("cohens_d").alias("abs_d")).orderBy(F.desc("abs_d"), "col").limit(top)


def threshold_ranges(suggested: DataFrame, effects: DataFrame) -> DataFrame:
    """col, operator, low, high: where a search looks for a threshold; low is the smaller, and where both are one, 1 is between them."""
    e = effects.select("col", "winner_p25", "winner_p75", F.col("winner_mean").alias("_m"))
    out = suggested.join(F.broadcast(e), "col")  # a row an indicator
    low, high = F.least("winner_p25", "_m") * 0.5, F.greatest("winner_p75", "_m") * 1.5
    below = F.col("operator") == "<"
    one, other = F.when(below, high * 0.3).otherwise(low), F.when(below, high * 1.5).otherwise(high)
    least, most = F.least(one, other), F.greatest(one, other)
    return out.select("col", "operator", least.alias("low"), F.when(most - least < 1e-8, least + 1).otherwise(most).alias("high"))


def combined_scores(effects: DataFrame, importances: DataFrame) -> DataFrame:
    """col, score: mean of effect and importance, each over its highest; an absent importance is 0."""
    every = Window.partitionBy()
    out = effects.select("col", F.abs("cohens_d").alias("d")).join(F.broadcast(importances), "col", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.nullif(F.max(c).over(every), F.lit(0.0))), F.lit(0.0))
    return out.withColumn("score", (part("d") + part("importance")) / 2)


def forest_importances(entries: DataFrame, columns: list[str], top: int = 15, seed: int = 42) -> DataFrame:
    """col, importance by a random forest of 100 trees; needs 20 rows and 2 columns."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = entries.sparkSession
    schema = "col string, importance double"
    rows = entries.select(F.col("is_winner").cast("double").alias("label"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    counts = rows.agg(F.count("*"), F.countDistinct("label")).first()
    if counts[0] < 20 or counts[1] < 2 or len(columns) < 2:
        return spark.createDataFrame([], schema)
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=100, maxDepth=5, minInstancesPerNode=3, seed=seed).fit(vectors)
    found = [(c, float(x)) for c, x in zip(columns, model.featureImportances.toArray(), strict=True) if x > 0.001]
    return spark.createDataFrame(sorted(found, key=lambda r: (-r[1], r[0]))[:top], schema)


def snapshots(entries: DataFrame, columns: list[str]) -> DataFrame:
    """entries with indicator_snapshot, a map of the columns that have a value."""
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in columns)), lambda s: s.v.isNotNull())
    return entries.withColumn("indicator_snapshot", F.map_from_entries(pairs))


def snapshot_stats(winners: DataFrame, least: int = 3) -> DataFrame:
    """indicator, mean, std, min, max, p25, p50, p75, count over the winners' snapshots, rounded half to even."""
    rows = winners.select(F.explode("indicator_snapshot").alias("indicator", "value"))
    out = rows.groupBy("indicator").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile("value", F.lit(0.25)).alias("p25"), F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.75)).alias("p75"), F.count("*").alias("count"))
    return out.where(F.col("count") >= least).select("indicator", *(F.bround(c, 4).alias(c) for c in ("mean", "std", "min", "max", "p25", "p50", "p75")), "count")


#: Conditions of winners, by name; a missing value counts as given.
WINNER_CONDITIONS: dict[str, tuple[str, float]] = {"RSI < 30": ("RSI_14", 50.0), "RSI 30-50": ("RSI_14", 50.0), "RSI 50-70": ("RSI_14", 50.0), "ADX > 25": ("ADX_14", 0.0), "MACD hist > 0": ("MACD_hist", 0.0), "BB% < 0.2": ("BB_pct_20", 0.5), "Volume > 1.5x": ("volume_ratio", 1.0), "Price > EMA50": ("EMA_50", 0.0)}


def condition_frequency(winners: DataFrame, least: int = 5) -> DataFrame:
    """condition, n, frequency among the winners' snapshots (which hold no close, so the last never holds)."""
    value = {n: F.coalesce(F.col("indicator_snapshot")[c], F.lit(d)) for n, (c, d) in WINNER_CONDITIONS.items()}
    tests: dict[str, Column] = {
        "RSI < 30": value["RSI < 30"] < 30, "RSI 30-50": (value["RSI 30-50"] >= 30) & (value["RSI 30-50"] < 50), "RSI 50-70": (value["RSI 50-70"] >= 50) & (value["RSI 50-70"] < 70), "ADX > 25": value["ADX > 25"] > 25,
        "MACD hist > 0": value["MACD hist > 0"] > 0, "BB% < 0.2": value["BB% < 0.2"] < 0.2, "Volume > 1.5x": value["Volume > 1.5x"] > 1.5, "Price > EMA50": F.lit(False),
    }
    row = winners.agg(F.count("*").alias("_total"), *(F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests.values()))).where(F.col("_total") >= least)
    name = F.create_map(*(F.lit(x) for i, n in enumerate(tests) for x in (f"c{i}", n)))
    return row.unpivot(["_total"], [f"c{i}" for i in range(len(tests))], "c", "n").select(name[F.col("c")].alias("condition"), "n", (F.col("n") / F.col("_total")).alias("frequency"))


def correlation_matrix(df: DataFrame, columns: list[str], least: int = 5, share: float = 0.7) -> DataFrame:
    """a, b, correlation: Pearson over the rows in which both have values; columns filled in 70 % of the rows."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in columns)).first()
    own = [c for c in columns if counts["_n"] >= least and counts[c] >= share * counts["_n"]]
    if not own:
        return df.sparkSession.createDataFrame([], "a string, b string, correlation double")
    row = df.agg(*(pearson(a, b).alias(f"{i}|{j}") for i, a in enumerate(own) for j, b in enumerate(own)))
    long = row.unpivot([], list(row.columns), "pair", "correlation")
    name = F.array(*map(F.lit, own))
    at = F.split("pair", r"\|")
    return long.select(name[at[0].cast("int")].alias("a"), name[at[1].cast("int")].alias("b"), F.bround("correlation", 3).alias("correlation"))
