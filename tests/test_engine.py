import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.indicators import catalog, names, with_indicators
from barloom.operators import asof, entries, ic, simulate, stats, universe
from barloom.plans import rules, search
from barloom.sources import bars as source

START = dt.datetime(2024, 1, 1)


def series(spark, closes, symbol="A", spread=1.0, extra=None):
    rows = []
    for i, c in enumerate(closes):
        c = None if c is None else float(c)
        rows.append((symbol, "1h", START + dt.timedelta(hours=i), c, None if c is None else c + spread, None if c is None else c - spread, c, 100.0 + i, *(e[i] for e in (extra or {}).values())))
    return spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double" + "".join(f", {k} int" for k in extra or {}))


def walk(n, seed=1):
    rng = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(max(1.0, out[-1] + rng.gauss(0, 1)))
    return out


def test_every_name_is_built_once_and_catalogued():
    assert len(names()) == len(set(names())) >= 331
    assert sorted(n for v in catalog().values() for n in v) == sorted(names())


def test_indicators_against_pandas(spark):
    closes = walk(260)
    got = with_indicators(series(spark, closes), ["EMA_20", "SMA_20", "WMA_13", "ZSCORE_20", "PCT_RANK_10", "LINREG_SLOPE_14", "HMA_9", "RSI_14", "SKEW_20", "KURT_20", "MEDIAN_20", "DPO_20", "UI_14"]).orderBy("ts").toPandas()
    c = pd.Series(closes)
    want = {
        "EMA_20": c.ewm(span=20, adjust=False, min_periods=20).mean(), "SMA_20": c.rolling(20).mean(), "WMA_13": c.rolling(13).apply(lambda w: np.dot(w, range(1, 14)) / 91), "ZSCORE_20": (c - c.rolling(20).mean()) / c.rolling(20).std(),
        "PCT_RANK_10": c.rolling(10).rank(pct=True), "LINREG_SLOPE_14": c.rolling(14).apply(lambda w: np.polyfit(range(14), w, 1)[0]), "SKEW_20": c.rolling(20).skew(), "KURT_20": c.rolling(20).kurt(), "MEDIAN_20": c.rolling(20).median(),
        "DPO_20": c.shift(11) - c.rolling(20).mean(), "UI_14": ((((c - c.rolling(14).max()) / c.rolling(14).max()) * 100) ** 2).rolling(14).mean() ** 0.5,
    }
    for name, x in want.items():
        assert got[name].notna().tolist() == x.notna().tolist(), name
        assert np.allclose(got[name].astype(float), x, equal_nan=True, atol=1e-8), name
    assert got.RSI_14.dropna().between(0, 100).all()


def test_flat_empty_and_null_series(spark):
    some = ["BB_pct_20", "STOCH_K", "RSI_14", "CCI_20", "CORREL_CV_14", "CDL_DOJI", "SUPERT_10_3", "VHF_28", "NVI"]
    flat = with_indicators(series(spark, [5.0] * 60, spread=0.0), some).toPandas()
    assert flat.STOCH_K.isna().all() and flat.BB_pct_20.isna().all() and flat.CORREL_CV_14.isna().all()
    assert with_indicators(series(spark, []), some).count() == 0
    holes = [None if i % 7 == 3 else x for i, x in enumerate(walk(80))]
    assert with_indicators(series(spark, holes), ["SMA_8", "PCT_RANK_10"]).where("SMA_8 is not null").count() == 0
    nan = series(spark, [1.0, float("nan"), 3.0])
    assert source.clean(nan).where("close is null").count() == 1


def test_no_look_ahead(spark):
    closes = walk(150, 5)
    wanted = [n for n in ("EMA_20", "SUPERT_dir", "MACD_hist", "BB_upper_20", "PSAR_dir", "BARS_SINCE_HIGH", "KAMA", "CDL_HAMMER")]
    whole, part = (with_indicators(series(spark, closes[:n]), wanted).orderBy("ts").toPandas()[wanted] for n in (150, 120))
    assert np.allclose(whole.iloc[:120].astype(float), part.astype(float), equal_nan=True)
    fractal = with_indicators(series(spark, [1, 2, 9, 2, 1], spread=0.5), ["FRACTAL_BEAR"]).orderBy("ts").toPandas().FRACTAL_BEAR
    assert fractal.tolist() == [0, 0, 1, 0, 0]  # known to look ahead by two bars


def test_asof_boundaries(spark):
    left = series(spark, [1, 2, 3, 4])
    right = left.where(F.hour("ts").isin(1, 3)).select("symbol", "ts", F.col("close").alias("x"))
    got = asof.asof(left, right, ["x"]).orderBy("ts").toPandas().x
    assert math.isnan(got[0]) and got[1:].tolist() == [2, 2, 4]
    points = spark.createDataFrame([("A", START + dt.timedelta(minutes=30)), ("A", START + dt.timedelta(minutes=31)), ("B", START)], "symbol string, ts timestamp")
    near = asof.nearest(points, left, ["close"]).orderBy("symbol", "ts").toPandas().close
    assert near[:2].tolist() == [1, 2] and math.isnan(near[2])  # equally near: the earlier
    high = source.higher(left, "2h")
    early, late = (asof.inject_higher(left, high.union(high.where("false")), "2h", ["close"], completed_only=x) for x in (False, True))
    assert early.columns[-1] == late.columns[-1] == "HTF_2h_close"


def test_merge_keeps_existing(spark):
    a = series(spark, [1, 2, 3])
    b = series(spark, [9, 9, 9, 9])
    assert source.merge(a, b).orderBy("ts").toPandas().close.tolist() == [1, 2, 3, 9]
    assert source.next_since(a, "2023-01-01").first().since == START + dt.timedelta(hours=3)
    assert source.with_minimum(a, "backtest").count() == 0


@pytest.mark.parametrize(
    ("closes", "entry", "leave", "risk", "reason", "at"),
    [
        ([10, 10, 9, 8, 8], {0: 1}, {}, {"sl_mode": "fixed", "sl_pct": 0.1, "tp_mode": "none"}, "stop_loss", 2),
        ([10, 10, 11, 12, 12], {0: 1}, {}, {"sl_mode": "none", "tp_mode": "fixed", "tp_pct": 0.15}, "take_profit", 3),
        ([10, 10, 12, 11, 11], {0: 1}, {}, {"sl_mode": "none", "tp_mode": "none", "trail_mode": "fixed", "trail_pct": 0.05}, "trailing_stop", 3),
        ([10, 10, 10, 10, 10], {0: 1}, {2: 1}, {"sl_mode": "none", "tp_mode": "none"}, "exit_signal", 3),
        ([10, 10, 10, 10, 10], {0: 1}, {}, {"sl_mode": "none", "tp_mode": "none"}, "end_of_data", 4),
    ],
)
def test_simulator_exits(spark, closes, entry, leave, risk, reason, at):
    n = len(closes)
    df = series(spark, closes, extra={"entry_signal": [entry.get(i, 0) for i in range(n)], "exit_signal": [leave.get(i, 0) for i in range(n)]})
    got = simulate.trades(df, simulate.Risk(fee=0.0, slippage=0.0, **risk)).collect()
    assert [(t.entry_idx, t.exit_idx, t.exit_reason) for t in got] == [(1, at, reason)]
    assert got[0].pnl_pct == pytest.approx((closes[at] / 10 - 1) * 100)


def test_simulator_last_bar_and_no_trades(spark):
    df = series(spark, [1, 2, 3], extra={"entry_signal": [0, 1, 1], "exit_signal": [0, 0, 0]})
    assert simulate.trades(df, simulate.Risk()).count() == 0  # an entry on the last bar never closes
    assert simulate.trades(df.where("false"), simulate.Risk()).count() == 0
    assert simulate.kelly([1, 2], 0.5, 0.3) == 0.3 and simulate.kelly([1, 0], 0.5, 0.3) == 0.05 and simulate.kelly([5, -1] * 10, 1.0, 0.1) == pytest.approx(0.4)
    assert simulate.Risk.of({"stop_loss_pct": 0.05}).sl_mode == "fixed" and simulate.Risk.of({"trailing_pct": 0}).trail_mode == "none"


def test_walk_forward_folds(spark):
    df = series(spark, walk(503), extra={"entry_signal": [0] * 503, "exit_signal": [0] * 503})
    got = simulate.walk_forward(df, 5).groupBy("fold", "part").count().collect()
    assert {(r["fold"], r["part"]): r["count"] for r in got}[(4, "oos")] == 103 - 72 and len(got) == 10
    anchored = {(r["fold"], r["part"]): r["count"] for r in simulate.walk_forward(df, 5, anchored=True).groupBy("fold", "part").count().collect()}
    assert anchored[(4, "is")] == int(503 * 0.7) and anchored[(0, "is")] == 70
    assert simulate.holdout(df).count() == 100


def test_rules_and_expressions(spark):
    df = series(spark, [1, 2, 3, 2, None]).withColumn("RSI_14", F.col("close") * 10)
    def hits(text):
        return [r.x for r in df.select(rules.expression(text, df.columns).alias("x"), "ts").orderBy("ts").collect()]

    assert hits("close > 1 and RSI_14 < 30") == [False, True, False, True, False]
    assert hits("(close > 1) & ~(close > 2)") == [False, True, False, True, False]
    assert hits("1 < close <= 2") == [False, True, False, True, False]
    for bad in ("__import__('os')", "close.mean()", "unknown > 1", "", "close >", "[x for x in (1,)]"):
        assert hits(bad) == [False] * 5
    cross = [r.x for r in df.select(rules.condition(("close", "up", 1.5), df.columns, False).alias("x"), "ts").orderBy("ts").collect()]
    assert cross == [False, True, False, False, False]
    out = rules.slot_signals(df, {"trend": "psar_bull", "setup": "none", "trigger": "ha_3green", "context": "htf_rsi_not_ob", "exit": "rsi_gt_70"})
    assert out.agg(F.sum("entry_signal"), F.sum("exit_signal")).first()[:] == (0, 0)  # a missing trigger never fires
    assert rules.direction("# direction: short\nclose > 1\n# direction: long") == ("long", "close > 1")
    assert rules.valid("x = ") is not None and rules.valid("x = 1") is None
    assert "crosses above" in rules.rule_text({"trigger": "rsi_cross_30"})
    assert all(o in rules.SLOTS[s] for s in rules.SLOTS for o in rules.SLOTS[s]) and len(rules.CONDITIONS) == 26 and len(rules.CROSSES) == 19


def test_statistics(spark):
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p_value double")
    got = stats.false_discovery(p).orderBy("p_value").toPandas()
    assert np.allclose(got.adjusted_p, [0.04, 0.16 / 3, 0.16 / 3, 0.5]) and got.is_significant.tolist() == [True, False, False, False]
    assert stats.false_discovery(p.where("false")).count() == 0
    assert stats.t_sf(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and stats.t_sf(0.0, 5) == 1.0
    found = spark.createDataFrame([("A", i, r) for i, r in enumerate([0.1, -0.05, 0.2])] + [("B", 0, -0.1)], "symbol string, exit_idx int, r double")
    row = stats.portfolio(found, "symbol", n_pairs=2, capital=100.0).first()
    assert row.portfolio_return == pytest.approx((50 * 1.1 * 0.95 * 1.2 + 45) - 100)
    a, b = (stats.monte_carlo(found, "symbol", draws=150).orderBy("symbol").collect() for _ in range(2))
    assert a == b and 0 <= a[0].prob_profitable <= 1
    same = spark.createDataFrame([("A", i, i * 0.01) for i in range(5)] + [("B", i, i * 0.02) for i in range(5)], "symbol string, exit_idx int, r double")
    assert stats.mean_spearman(same, "symbol").first().avg_correlation == pytest.approx(1.0)
    hist = stats.histogram(found, "r", 3).toPandas()
    assert hist.n.sum() == 4


def test_effects_and_correlations(spark):
    rows = [(True, float(10 + i), 1.0) for i in range(10)] + [(False, float(i), None) for i in range(10)]
    df = spark.createDataFrame(rows, "is_winner boolean, x double, y double")
    got = {r.col: r for r in entries.effect_sizes(df, ["x", "y"]).collect()}
    assert got["x"].cohens_d == pytest.approx(10 / np.std(range(10), ddof=1)) and got["y"].cohens_d == 0
    top = entries.suggestions(entries.effect_sizes(df, ["x", "y"])).collect()
    assert [(r.col, r.operator, r.threshold) for r in top] == [("x", ">", 12.25)]
    assert {(r.a, r.b): r.correlation for r in entries.correlation_matrix(df.withColumn("z", -F.col("x")), ["x", "z"]).collect()}[("x", "z")] == -1.0


def test_information_coefficient(spark):
    df = series(spark, walk(120)).withColumn("x", ic.forward_return(5))
    got = ic.information(df, ["x"], (5,)).first()
    assert got.ic == pytest.approx(1.0) and got.n == 115
    assert ic.information(df.limit(20), ["x"], (5,)).first().ic is None
    assert ic.regime_label(with_indicators(df, ["EMA50_slope", "NATR_14"])).count() == 1


def test_universe(spark):
    pairs = spark.createDataFrame([(f"S{i}", True, False, float(i), 5) for i in range(10)], "symbol string, active boolean, excluded boolean, volume_24h double, candle_count int")
    kept = universe.selected(pairs, [{"method": "VolumePairList", "number_assets": 6, "min_value": 2}, {"method": "OffsetFilter", "offset": 1, "number_assets": 3}])
    assert sorted(r.symbol for r in kept.collect()) == ["S6", "S7", "S8"]
    assert universe.with_exclusions(pairs, [{"method": "VolumePairList", "number_assets": 4}]).where("not excluded").count() == 4
    assert universe.exclude_below(pairs, 5).where("excluded").count() == 5 and universe.toggled(pairs, "S1").where("excluded").count() == 1
    new = spark.createDataFrame([("S1", False, False, 99.0, 1), ("N", True, False, 1.0, 0)], pairs.schema)
    merged = {r.symbol: r for r in universe.upsert(pairs, new, ["symbol"], ["active", "volume_24h"]).collect()}
    assert len(merged) == 11 and merged["S1"].volume_24h == 99 and merged["S1"].candle_count == 5
    assert universe.latest(pairs, ["active"], "volume_24h").first().symbol == "S9"
    assert universe.viewed(pairs, 3, "s9").count() == 1


def test_search(spark):
    a, b = search.propose(5), search.propose(5)
    assert a == b and all(lo <= p[k] <= hi for p in a for k, (lo, hi) in search.RANGES.items())
    t = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 0.0), (3, 0.5, 0.5), (4, 2.0, 0.0)], "id int, a double, b double")
    assert sorted(r.id for r in search.pareto(t, "a", "b").collect()) == [1, 2, 4]


def test_stream_bars(spark, tmp_path):
    from barloom.streaming.bars import stream_bars

    rows = [("A", START + dt.timedelta(minutes=10 * i), float(i), i) for i in range(30)]
    spark.createDataFrame(rows, "s string, ts timestamp, v double, id long").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("s string, ts timestamp, v double, id long").parquet(str(tmp_path / "in"))
    q = stream_bars(live, "1h", "s", "ts", "v", "id", late="0 seconds").writeStream.format("memory").queryName("bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM bars ORDER BY ts").toPandas()
    assert got.close.tolist() == [5, 11, 17, 23] and got.volume.tolist() == [6.0] * 4


def test_equity_at_every_bar(spark):
    """The curve, a plain fold of the same trades, and the measures of it; a series without trades has zeros."""
    closes = walk(120, 9)
    enter, leave = [int(i % 9 == 2) for i in range(120)], [int(i % 9 == 6) for i in range(120)]
    df = series(spark, closes, extra={"entry_signal": enter, "exit_signal": leave})
    quiet = df.withColumns({"symbol": F.lit("Q"), "entry_signal": F.lit(0)})
    both, risk = df.unionByName(quiet), simulate.Risk(sl_mode="none", tp_mode="none", sizing="kelly")
    found = simulate.trades(both, risk)
    capital, curve, ended, share, results, at = 10_000.0, [10_000.0], {}, risk.size, [], {t.entry_idx: t for t in found.collect()}
    for i in range(1, 120):
        if i in at:
            assert at[i].position_size == pytest.approx(share)
            capital -= capital * share * risk.fee
            ended[at[i].exit_idx] = at[i]
        if i in ended:
            t = ended[i]
            capital = capital * (1 + t.position_size * t.pnl_pct / 100) * (1 - t.position_size * risk.fee)
            results.append(t.pnl_pct)
            if len(results) % 10 == 0:
                share = simulate.kelly(results, risk.kelly_fraction, share)
        curve.append(capital)
    got = simulate.equity(both, found).where("symbol = 'A'").orderBy("ts").toPandas().equity
    assert np.allclose(got, curve) and len(results) >= 10
    rows = {r.symbol: r for r in simulate.metrics(found, ("symbol",), series=both).join(simulate.equity_metrics(both, found, ("symbol",)), "symbol").collect()}
    top = np.maximum.accumulate(curve)
    assert rows["A"].max_drawdown == pytest.approx(((top - curve) / top).max() * 100) and rows["A"].total_return == pytest.approx((capital / 10_000 - 1) * 100)
    assert (rows["Q"].total_trades, rows["Q"].sharpe, rows["Q"].max_drawdown, rows["Q"].calmar) == (0, 0, 0, 0)


def test_range_periods_differ(spark):
    closes = walk(60, 3)
    df = series(spark, closes, extra={"entry_signal": [int(i == 30) for i in range(60)], "exit_signal": [0] * 60})
    one, two = (simulate.trades(df, simulate.Risk(sl_mode="atr", tp_mode="none", sl_atr=1.0, sl_atr_period=n)).first() for n in (3, 25))
    assert one.entry_idx == two.entry_idx == 31 and (one.exit_idx, one.exit_reason) != (two.exit_idx, two.exit_reason) or one.exit_reason == two.exit_reason


def test_false_discovery_by_slices_is_the_definition(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random(300), rng.random(60) ** 6, [1.0] * 40, [0.0] * 3, [0.5] * 30])
    got = stats.false_discovery(spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(p)], "id int, p_value double"), order=("id",)).orderBy("fdr_rank").toPandas()
    order = np.lexsort((np.arange(len(p)), p))
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    assert got.id.tolist() == order.tolist() and np.allclose(got.adjusted_p, np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1]))


def test_catalog_and_strategies(spark):
    from barloom.plans import catalog, strategy

    kinds = {n: catalog.classify(n) for n in ("RSI_14", "EMA_50", "MACD_hist", "ADX_14", "CDL_HAMMER", "SUPERT_dir", "BB_lower_20", "BB_pct_20", "NATR_14", "volume_ratio")}
    assert {n: e.kind for n, e in kinds.items()} == {"RSI_14": "osc", "EMA_50": "ma", "MACD_hist": "sign", "ADX_14": "gt", "CDL_HAMMER": "cdl", "SUPERT_dir": "flag", "BB_lower_20": "band_lower", "BB_pct_20": "band_pct", "NATR_14": "lt", "volume_ratio": "gt"}
    assert catalog.classify("close") is None and catalog.classify("HTF_4h_RSI_14") is None and kinds["RSI_14"].category == "Oscillators" and kinds["RSI_14"].high == 50
    # what is stated goes before what names tell
    told = {n: (e.kind, e.low, e.high) for n in ("RSI_7", "RSI_21", "STOCH_K", "STOCHRSI_K", "ROC_10", "BB_width_20", "RSI_10", "BB_width_14") if (e := catalog.classify(n))}
    assert told == {"RSI_7": ("osc", 15, 50), "RSI_21": ("osc", 25, 55), "STOCH_K": ("osc", 10, 40), "STOCHRSI_K": ("osc", 5, 30), "ROC_10": ("gt", -1, 3), "BB_width_20": ("gt", 0.005, 0.05), "RSI_10": ("osc", 20, 50), "BB_width_14": ("lt", 0.01, 0.1)}
    assert sorted(n for n in catalog.STATED if catalog.classify(n).default) == ["ADX_14", "BB_pct_20", "EMA_20", "EMA_50", "MACD_hist", "RSI_14", "SUPERT_dir", "volume_ratio"]
    assert len(catalog.crosses()) == 19 and sum(e.category == "Crosses/HTF" for e in catalog.crosses().values()) == 5
    df = series(spark, walk(80, 2))
    out = strategy.run(df, strategy.of_slots({"trend": "none", "trigger": "rsi_cross_50", "exit": "rsi_gt_70"}))
    assert {"entry_signal", "exit_signal", "RSI_14"} <= set(out.columns)
    again = strategy.run(out, strategy.PASS_THROUGH)
    assert again.select("ts", "entry_signal", "exit_signal").exceptAll(out.select("ts", "entry_signal", "exit_signal")).count() == 0
    bad = strategy.run(df, strategy.of_expressions("import os", "close <", [], "x"))
    assert bad.agg(F.sum("entry_signal")).first()[0] == 0


def test_vocabulary_is_that_of_the_survey():
    """Conditions and crosses, written out here a second time, as column, comparison, and column or number."""
    from barloom.plans import rules

    said = """EMA_20 > EMA_50; EMA_50 > EMA_200; close > EMA_50; close > EMA_200; SUPERT_dir == 1; PSAR_dir == 1; RSI_14 < 30; RSI_14 < 35; RSI_14 < 40; RSI_14 > 50; RSI_14 > 60; STOCH_K < 20; STOCH_K < 30;
    STOCHRSI_K < 20; CCI_20 < -100; CCI_20 < -150; MFI_14 < 25; MFI_14 < 35; WILLR_14 < -70; MACD_hist > 0; close < BB_lower_20; ADX_14 > 20; ADX_14 > 25; volume_ratio > 1.5; CMF_20 > 0; close > BB_upper_20"""
    assert [" ".join(map(str, rule)) for rule in rules.CONDITIONS.values()] == [x.strip() for x in said.split(";")]
    crossed = """EMA_8 EMA_20; EMA_20 EMA_50; EMA_50 EMA_200; close EMA_200; close KC_lower; close BB_lower_20; RSI_14 30; RSI_14 50; STOCH_K 20; STOCHRSI_K 20; CCI_20 -100; WILLR_14 -50; MACD MACD_signal; MACD_hist 0;
    close H:EMA_50; close H:EMA_200; close H:KC_lower; close H:BB_lower_20; EMA_20 H:EMA_50"""
    assert [f"{a} {b}" for a, b in rules.CROSSES] == [x.strip() for x in crossed.split(";")]


def test_sessions_are_read(spark):
    rows = [("a", '["1h","4h"]', '[{"method":"VolumePairList","number_assets":5}]'), ("b", '["1h"]', "not json"), ("c", "[]", None)]
    got = {r.id: r for r in universe.sessions(spark.createDataFrame(rows, "id string, timeframes string, pairlist_config string")).collect()}
    assert got["a"].timeframes == ["1h", "4h"] and got["a"].pairlist_config[0].number_assets == 5 and got["a"].entry_mode == "path_b"
    assert [x for x in got["b"].pairlist_config if x.method] == [] and got["c"].pairlist_config == []


def test_search_batches_and_tops(spark):
    df = with_indicators(series(spark, walk(320, 8)), ["EMA_20", "EMA_50", "RSI_14", "MACD", "MACD_signal", "MACD_hist", "STOCH_K"])
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    tried, told = search.successive(df, batches=2, per_batch=6, splits=2)
    assert len(tried) == 12 and told.count() == 12
    top = search.top_strategies(df, tried, told, top=4, draws=50, splits=2)
    assert top.count() == 4 and top.where("p_value < 0 or p_value > 1 or adjusted_p < p_value - 1e-12").count() == 0
    like = search.propose(200, like=[{**tried[0], "trigger": "rsi_cross_50"}])
    assert sum(p["trigger"] == "rsi_cross_50" for p in like) > 80
