"""Series cut into chunks give what whole series give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import chunks, recursive, steps
from barloom.functions.recursive import PRICES, RECURSIVE, UNITS, compute, compute_split


def made_up(n, seed, holes=True):
    """Prices with gaps in time, missing closes, flat stretches."""
    rng = np.random.default_rng(seed)
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), 2)
    close[n // 3 : n // 3 + 30] = close[n // 3]
    spread = np.abs(rng.normal(0, 0.5, (3, n)))
    frame = pd.DataFrame({"ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.cumsum(rng.choice([1, 1, 1, 5, 40], n)), "h"), "open": close + spread[0] - spread[1], "high": close + spread[0] + spread[2], "low": close - spread[1] - spread[2], "close": close, "volume": rng.integers(0, 500, n).astype(float)})
    if holes:
        frame.loc[rng.choice(np.arange(n // 2, n), min(12, n // 3), replace=False), ["close", "volume"]] = np.nan
    return frame


def bars_of(spark, *lengths, holes=False):
    rows = pd.concat([made_up(n, i, holes).assign(symbol=f"S{i}", timeframe="1h") for i, n in enumerate(lengths)])
    return chunks.kept(spark.createDataFrame(rows).withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in PRICES}).repartition(6))


def equal(whole, split, names, tolerance=1e-8):
    a, b = (df.select("symbol", "ts", *names).toPandas().sort_values(["symbol", "ts"], ignore_index=True) for df in (whole, split))
    assert a[["symbol", "ts"]].equals(b[["symbol", "ts"]])
    for n in names:
        x, y = a[n].to_numpy(float), b[n].to_numpy(float)
        assert np.array_equal(np.isnan(x), np.isnan(y)), n
        assert np.nanmax(np.abs(x - y) / np.maximum(1, np.abs(x)), initial=0) < tolerance, n


def test_numbers_without_sorting_a_series(spark):
    bars = bars_of(spark, 900, 40)
    got = chunks.numbered(bars, 50).toPandas().sort_values(["symbol", "ts"])
    assert got.groupby("symbol")["_i"].apply(lambda x: x.tolist() == list(range(len(x)))).all()
    halo = chunks.with_halo(chunks.numbered(bars, 50), 50, 20, 2).toPandas()
    for (symbol, k), group in halo.groupby(["symbol", "_chunk"]):
        own = sorted(group[group["_own"]]["_i"])
        n = 900 if symbol == "S0" else 40
        assert own == list(range(50 * k, min(n, 50 * k + 50)))
        assert not own or sorted(group["_i"]) == list(range(max(0, 50 * k - 20), min(n, 50 * k + 52)))
    with pytest.raises(ValueError):
        chunks.with_halo(bars, 10, 20)


def test_recursive_columns(spark):
    """All recursive indicators at once, chunks of twice what they look back."""
    names = list(RECURSIVE)
    bars = bars_of(spark, 3700, 1100, 30)
    split = compute_split(bars, names, 1)
    assert sum(steps.shape(UNITS[n][0])[1] > 500 for n in names) < len(names) / 2
    equal(compute(bars, names), split, names)


def test_many_short_chunks_with_holes(spark):
    names = ["EMA_20", "MACD", "MACD_signal", "RSI_14", "TRIX_15", "T3_5", "ADOSC", "OBV_EMA_12", "PPO_hist", "HWMA", "KDJ_J", "STC", "TSI_13_25", "STOCHRSI_K"]
    bars = bars_of(spark, 1500, 60, holes=True)
    assert max(steps.shape(UNITS[n][0])[1] for n in names) < 40
    equal(compute(bars, names), compute_split(bars, names, 90), names, 1e-6)


def test_levels_and_looks_of_steps():
    found, before = steps.shape(UNITS["MACD"][0])
    assert [s.level for s in found] == [1, 1, 2] and before == 1
    assert [s.level for s in steps.shape(UNITS["STC"][0])[0]] == [1, 1, 2, 3]
    assert [s.kind for s in steps.shape(UNITS["PSAR_up"][0])[0]] == ["path"]


def test_relay_corrects_wrong_guesses(spark):
    """A fold that never forgets: every chunk's guess is wrong, and is run again, in order."""
    rows = pd.DataFrame({"symbol": "A", "timeframe": "1h", "ts": pd.date_range("2024-01-01", periods=400, freq="h"), "x": np.arange(400) % 7})
    df = chunks.with_halo(chunks.numbered(spark.createDataFrame(rows), 50), 50, 0)

    def run(group, states):
        state = states.get("sum")
        begin = (state or [0.0])[0]
        return {"sum": ([] if state is None and group["_chunk"].iloc[0] == 0 else [begin], [begin + float(group["x"].sum())])}

    got = {r["_chunk"]: r.state for r in chunks.relay(df, run).collect()}
    sums = np.cumsum(rows["x"].to_numpy().reshape(8, 50).sum(1))
    assert got == {0: [], **{k: [float(sums[k - 1])] for k in range(1, 8)}}


def test_all_window_columns(spark):
    """Every indicator that is no recursion, and those that read recursions."""
    from barloom.functions.indicators import COLUMNS, names, with_indicators

    wanted = [n for n in names() if n not in RECURSIVE]
    assert all(n in COLUMNS for n in wanted)
    bars = bars_of(spark, 1500, 300, 3)
    for part in (wanted[::2], wanted[1::2]):
        equal(with_indicators(bars, part), with_indicators(bars, part, rows=1), part, 1e-7)


def test_running_values_with_holes(spark):
    from barloom.functions.indicators import with_indicators

    wanted = ["OBV", "OBV_ZSCORE", "AD", "PVT", "NVI", "PVI", "FISHER", "BARS_SINCE_HIGH", "BARS_SINCE_LOW", "SMA_200", "FRACTAL_BEAR"]
    bars = bars_of(spark, 2600, 900, holes=True)
    equal(with_indicators(bars, wanted), with_indicators(bars, wanted, rows=700), wanted, 1e-7)


def test_one_series_is_many_tasks(spark):
    from barloom.functions.indicators import with_indicators

    out = with_indicators(bars_of(spark, 6600), ["EMA_20", "SMA_20", "OBV"], rows=700)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join what is as small as here
    try:
        spread = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] > 0 for r in spread) > 2


@pytest.mark.parametrize("options", [{}, {"sl_mode": "none", "tp_mode": "none"}, {"sl_mode": "atr", "tp_mode": "rr", "trail_mode": "atr", "sizing": "atr_risk"}, {"sizing": "kelly", "trail_mode": "fixed", "tp_pct": 0.3, "sl_pct": 0.3}])
def test_simulator_over_chunks(spark, options):
    """Trades of random signals, with positions open over many borders, are those of the plain fold."""
    from barloom.operators.simulate import Risk, trades

    rng = np.random.default_rng(3)
    rows = pd.concat([made_up(n, i).assign(symbol=f"S{i}", timeframe="1h") for i, n in enumerate((1500, 400, 2))])
    seldom = 0.002 if "none" in options.values() else 0.02
    rows["entry_signal"], rows["exit_signal"] = (rng.random(len(rows)) < 0.2).astype(int), (rng.random(len(rows)) < seldom).astype(int)
    rows.loc[rows.index[-1], "close"] = -1.0
    signals = chunks.kept(spark.createDataFrame(rows).withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in PRICES}).repartition(5))
    risk = Risk(**options)
    order = ["symbol", "entry_idx"]
    a, b = (trades(signals, risk, rows=n).toPandas().sort_values(order, ignore_index=True) for n in (None, 130))
    assert len(a) > 3
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_asof_by_stretches(spark):
    """Also where stretches lack either side, and where values are missing."""
    from barloom.operators import asof

    rng = np.random.default_rng(8)
    at = lambda n, step: pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 400, n)) * step, "h")
    left = pd.concat([pd.DataFrame({"symbol": s, "ts": at(150, 3), "x": range(150)}) for s in "AB"])
    right = pd.DataFrame({"symbol": "A", "ts": at(25, 2), "v": rng.random(25), "w": np.where(rng.random(25) < 0.5, np.nan, 1.0)}).drop_duplicates("ts")
    l, r = spark.createDataFrame(left), spark.createDataFrame(right).withColumn("w", F.nullif("w", F.lit(float("nan"))))
    for fill in (False, True):
        a, b = (asof.asof(l, r, ["v", "w"], fill=fill, span=span).toPandas().sort_values(["symbol", "ts", "x"], ignore_index=True) for span in (None, 36_000))
        pd.testing.assert_frame_equal(a, b)
    points = l.where("symbol = 'A'")
    a, b = (asof.nearest(points, r, ["v"], span=span).toPandas().sort_values(["ts", "x"], ignore_index=True) for span in (None, 36_000))
    pd.testing.assert_frame_equal(a, b)


def test_equity_over_chunks(spark):
    from barloom.operators import simulate

    rng = np.random.default_rng(6)
    rows = pd.concat([made_up(n, i, holes=False).assign(symbol=f"S{i}", timeframe="1h") for i, n in enumerate((700, 90, 3))])
    rows["entry_signal"], rows["exit_signal"] = (rng.random(len(rows)) < 0.3).astype(int), (rng.random(len(rows)) < 0.2).astype(int)
    signals = chunks.kept(spark.createDataFrame(rows))
    found = chunks.kept(simulate.trades(signals, simulate.Risk()))
    for f, order in ((simulate.equity, ["symbol", "ts"]), (simulate.equity_metrics, ["symbol"])):
        a, b = (f(signals, found, rows=n).toPandas().sort_values(order, ignore_index=True) for n in (None, 60))
        pd.testing.assert_frame_equal(a, b, rtol=1e-9)
