"""Ranks, fronts and paths by parts: no order of all rows in one task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import stats
from barloom.plans import search


def test_small_p_values_are_many_tasks(spark):
    """A million p-values below 0.001 and as many ties at 1."""
    tests = spark.range(1_000_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise(F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1)) / (1 << 30) / 1000).alias("p_value"))
    sizes = [r["count"] for r in stats.ranges(tests, "p_value").groupBy("_slice").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 500_000
    got = stats.false_discovery(tests, order=("id",)).orderBy("fdr_rank").toPandas()
    p = np.sort(tests.toPandas().p_value.to_numpy())
    raw = p * len(p) / np.arange(1, len(p) + 1)
    assert got.fdr_rank.tolist() == list(range(1, len(p) + 1))
    assert np.allclose(got.adjusted_p, np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1]))
    assert got.is_significant.sum() == 500_000


def test_fronts_by_ranges(spark):
    rng = np.random.default_rng(1)
    anti = rng.random(3000)
    frames = [rng.random((3000, 2)), np.column_stack([anti, 1 - anti]), rng.integers(0, 6, (500, 2)).astype(float), np.array([[1.0, 1.0]] * 5), np.zeros((0, 2))]
    for points in frames:
        rows = pd.DataFrame(points, columns=["a", "b"]).assign(k=range(len(points)))
        got = sorted(search.pareto(spark.createDataFrame(rows, "a double, b double, k long"), "a", "b").toPandas().k)
        x, y = points[:, 0], points[:, 1]
        best = [i for i in range(len(points)) if not ((x >= x[i]) & (y >= y[i]) & ((x > x[i]) | (y > y[i]))).any()]
        assert got == best


def plain_fall(values):
    top = np.maximum.accumulate(values)
    return ((top - values) / (top + 1e-12)).max()


@pytest.mark.parametrize("part", [7, 1 << 16])
def test_paths_by_parts(spark, monkeypatch, part):
    monkeypatch.setattr(stats, "PART", part)
    rng = np.random.default_rng(part)
    rows = pd.DataFrame([(k, i, float(v)) for k in ("x", "y") for i, v in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.05, 100))), 1)], columns=["k", "step", "v"])
    df = stats.parted(spark.createDataFrame(rows), "step")
    got = {r.k: r for r in stats.joined(stats.path_parts(df, "step", "v", ("k",)), ("k",)).collect()}
    sums = stats.running_total(df, "step", "v", "t", ("k",)).toPandas().sort_values(["k", "step"])
    for k, own in rows.groupby("k"):
        v = own.v.to_numpy()
        assert (got[k].first, got[k].last, got[k].peak, got[k].trough) == (v[0], v[-1], v.max(), v.min()) and got[k].fall == pytest.approx(plain_fall(v), abs=1e-12)
        assert np.allclose(sums[sums.k == k].t, np.cumsum(v))


def test_portfolio_and_correlation_by_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame([(f"s{k}", i, float(rng.normal(0.001, 0.03))) for k, n in enumerate((90, 60, 1)) for i in range(n)], columns=["symbol", "exit_idx", "r"])
    df = spark.createDataFrame(rows)
    whole = stats.portfolio(df, "symbol", 4).first(), stats.mean_spearman(df, "symbol").first()
    monkeypatch.setattr(stats, "PART", 16)
    parts = stats.portfolio(df, "symbol", 4).first(), stats.mean_spearman(df, "symbol").first()
    for a, b in zip(whole, parts, strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), rel=1e-9)
    curves = np.zeros(90)
    for _, own in rows.groupby("symbol"):
        curve = 2500 * np.cumprod(1 + own.r.to_numpy())
        curves += np.concatenate([curve, np.full(90 - len(curve), curve[-1])])
    assert whole[0].portfolio_max_drawdown == pytest.approx(100 * plain_fall(np.concatenate([[7500.0], curves])), rel=1e-9)


def test_benchmark_of_a_split_series(spark):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"symbol": "A", "timeframe": "1h", "ts": pd.date_range("2024-01-01", periods=500, freq="h"), "close": 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 500)))})
    rows.loc[[3, 100, 101], "close"] = [np.nan, np.inf, np.nan]
    one = pd.DataFrame({"symbol": "B", "timeframe": "1h", "ts": pd.date_range("2024-01-01", periods=1, freq="h"), "close": [4.0]})
    df = spark.createDataFrame(pd.concat([rows, one]))
    a, b = ({r.symbol: r.asDict() for r in stats.benchmark(df, rows=n).collect()} for n in (None, 40))
    assert set(a) == {"A", "B"} and a["B"]["benchmark_return"] == 0
    for k in a:
        assert {c: v for c, v in a[k].items() if isinstance(v, float)} == pytest.approx({c: v for c, v in b[k].items() if isinstance(v, float)}, rel=1e-9)


def test_user_aggregates_merge(spark, monkeypatch):
    """Any dealing of rows and any number of states handed on gives the same; nulls, empty groups and tables have results."""
    from barloom.functions import aggregates

    rng = np.random.default_rng(9)
    rows = [(None if k == 3 else f"g{k}", None if rng.random() < 0.1 else float(rng.gamma(2))) for k in range(5) for _ in range(60)] + [("empty", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    how = aggregates.Moments("x")
    want = df.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis")).toPandas().sort_values("g", ignore_index=True)
    for parts, most in ((1, 100_000), (7, 1)):
        monkeypatch.setattr(aggregates, "MOST", most)
        got = aggregates.aggregate(df.repartition(parts), ["g"], ["x"], how).toPandas().sort_values("g", ignore_index=True)
        assert got.g.tolist() == want.g.tolist() and got.n.tolist() == want.n.tolist()
        for c in ("mean", "variance"):
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)
        many = got.n > 1
        assert all(np.allclose(got[many][c].astype(float), want[many][c]) for c in ("skewness", "kurtosis"))
    assert aggregates.aggregate(df.where("false"), ["g"], ["x"], how).count() == 0


def test_quantiles_of_large_groups_stay_where_they_are(spark, monkeypatch):
    """A group above LARGE values is never shuffled by its key; smaller ones beside it are; both are exact."""
    from barloom.functions import quantiles

    monkeypatch.setattr(quantiles, "LARGE", 500)
    rng = np.random.default_rng(4)
    groups = {"big": rng.normal(0, 1, 4000), "edge": rng.normal(0, 1, 501), "most": rng.normal(5, 2, 500), "few": np.array([3.0, 4.0, 9.0])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, x double").repartition(4)
    plans, whole = [], quantiles.kept
    monkeypatch.setattr(quantiles, "kept", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or whole(d))
    for names in (list(groups), ["big", "edge"], ["most", "few"]):
        plans.clear()
        got = {r.g: r for r in quantiles.exact_quantiles(df.where(F.col("g").isin(names)), ["g"], "x", [0.0, 0.1, 0.5, 0.99]).collect()}
        assert got.keys() == set(names)
        for g in names:
            assert got[g].n == len(groups[g]) and np.allclose(got[g].quantiles, np.quantile(groups[g], [0.0, 0.1, 0.5, 0.99]), rtol=1e-12)
        passes = [p for p in plans if "Window" in p]
        assert passes and any("SortMergeJoin" in p for p in passes) == (names != ["big", "edge"])


def test_quantiles_by_counting(spark, monkeypatch):
    """Ties, tiny and huge values, infinities' neighbours, nulls; against percentiles over all values."""
    from barloom.functions import quantiles

    rng = np.random.default_rng(2)
    groups = {"ties": np.repeat([1.0, 2.0, 5.0], [50, 3, 40]), "one": np.array([7.0]), "two": np.array([-1.0, 3.0]), "wide": 10.0 ** rng.uniform(-300, 300, 200) * rng.choice([-1, 1], 200), "same": np.full(30, 0.1), "many": rng.normal(0, 1, 3000), "ends": np.array([-1.7e308, 1.7e308, 0.0, 1.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("ties", None), ("two", float("nan")), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    for bins in (1024, 3):
        monkeypatch.setattr(quantiles, "BINS", bins)
        sub = df if bins > 3 else df.where("g not in ('wide', 'ends')")
        got = {r.g: r for r in quantiles.exact_quantiles(sub, ["g"], "x", shares).collect()}
        for g in groups.keys() & got.keys():
            assert got[g].n == len(groups[g])
            if g == "ends":
                assert got[g].quantiles[0] == -1.7e308 and got[g].quantiles[-1] == 1.7e308
            else:
                assert np.allclose(got[g].quantiles, np.quantile(groups[g], shares), rtol=1e-9, atol=0 if g == "wide" else 1e-12)
        assert "none" not in got and len(got) >= 5
    assert quantiles.exact_quantiles(df.where("false"), ["g"], "x", shares).count() == 0
