"""Stored searches: resuming, dropping losers, proposals that learn."""

import random

import pytest

from barloom.functions.chunks import kept
from barloom.functions.indicators import with_indicators
from barloom.plans import study
from barloom.plans.study import RANGES, Study, Trial, crowding, falls_behind, fronts, offspring, parzen
from barloom.queries import SEARCHED, hourly


@pytest.fixture(scope="module")
def enriched(spark):
    return kept(with_indicators(hourly(spark, "/root/testdata/sf0.01"), SEARCHED))


def test_a_search_goes_on_where_it_stopped(spark, enriched, tmp_path, monkeypatch):
    options = {"n_series": 5, "least_trades": 1, "startup": 4}
    whole = Study(spark, f"file://{tmp_path}/whole", **options)
    want = {r.trial: r for r in whole.run(enriched, 3, 8).collect()}
    assert sorted(want) == list(range(24))
    # later folds aren't run for losing trials
    runs = sum(r.folds for r in want.values())
    assert any(r.state == "pruned" and r.folds < 3 and r.score is None for r in want.values()) and runs < 3 * 24
    # the second batch dies while it is told
    broken, real = Study(spark, f"file://{tmp_path}/broken", **options), study.scores
    calls = []

    def dies(*a, **k):
        calls.append(1)
        if len(calls) > 1:
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(study, "scores", dies)
    with pytest.raises(RuntimeError):
        broken.run(enriched, 3, 8)
    assert len(broken.trials()) == 8
    monkeypatch.setattr(study, "scores", real)
    evaluated, evaluate = [], study.evaluate
    monkeypatch.setattr(study, "evaluate", lambda e, proposals, *a, **k: evaluated.extend(p["trial"] for p in proposals) or evaluate(e, proposals, *a, **k))
    again = {r.trial: r for r in Study(spark, f"file://{tmp_path}/broken", **options).run(enriched, 3, 8).collect()}
    assert min(evaluated) == 8 and again == want
    assert [t.number for t in broken.best(3)] == [t.number for t in whole.best(3)]


def test_median_of_complete_trials():
    history = [Trial({"trial": i}, steps=[float(i), float(i)]) for i in range(10)] + [Trial({"trial": 99}, "pruned", [100.0])]
    assert falls_behind(Trial({"trial": 20}, steps=[4.4]), history) and not falls_behind(Trial({"trial": 20}, steps=[4.5]), history)
    assert not falls_behind(Trial({"trial": 20}, steps=[5.0, 0.0]), history)  # the best so far counts
    assert not falls_behind(Trial({"trial": 20}, steps=[-5.0]), history[:9])


def test_parzen_follows_the_good():
    rng, history = random.Random(2), []
    for p in study.propose(120, 7):
        low, high = RANGES["sl_pct"]
        history.append(Trial(p, score=0.2 * (p["trend"] == "psar_bull") - abs((p["sl_pct"] - low) / (high - low) - 0.3) + rng.gauss(0, 0.01)))
    new = parzen(history, 60, 120)
    assert sum(p["trend"] == "psar_bull" for p in new) > 25
    low, high = RANGES["sl_pct"]
    assert sum(abs((p["sl_pct"] - low) / (high - low) - 0.3) for p in new) / 60 < 0.15
    assert [p["trial"] for p in new] == list(range(120, 180)) and new == parzen(history, 60, 120)
    assert all(lo <= p[k] <= hi for p in new for k, (lo, hi) in RANGES.items())
    assert parzen(history[:3], 5, 3) == study.propose(5, 42, 3)


def plain_fronts(values):
    left, out, k = set(range(len(values))), {}, 0
    while left:
        best = {i for i in left if not any(values[j] != values[i] and values[j][0] >= values[i][0] and values[j][1] >= values[i][1] for j in left)}
        out |= dict.fromkeys(best, k)
        left, k = left - best, k + 1
    return [out[i] for i in range(len(values))]


def test_fronts_and_room():
    rng = random.Random(3)
    for _ in range(200):
        values = [(rng.randrange(6) / 2, rng.randrange(6) / 3) for _ in range(rng.randrange(1, 25))]
        assert fronts(values) == plain_fronts(values)
    room = crowding([(0, 4), (1, 3), (3, 1), (4, 0)], [0, 1, 2, 3])
    assert room[0] == room[3] == float("inf") and room[1] == pytest.approx(1.5) and room[2] == pytest.approx(1.5)


def test_offspring_takes_after_the_first_fronts():
    history = [Trial(p, values=(float(p["trend"] == "psar_bull"), float(p["exit"] == "rsi_gt_75"))) for p in study.propose(150, 3)]
    new = offspring(history, 80, 150)
    share = lambda own, s, o: sum(p[s] == o for p in own) / len(own)
    olds = [t.params for t in history]
    assert share(new, "trend", "psar_bull") > 2 * share(olds, "trend", "psar_bull") and share(new, "exit", "rsi_gt_75") > 1.5 * share(olds, "exit", "rsi_gt_75")
    assert offspring(history[:2], 4, 2) == study.propose(4, 42, 2) and new == offspring(history, 80, 150)


def test_threshold_trials_are_plain_loops(spark, enriched):
    """Scores of a search over thresholds against the fold run by hand."""
    import numpy as np
    import pandas as pd

    from barloom.operators.simulate import Risk, fold, metrics, walk_forward
    from barloom.plans import thresholds

    own = kept(with_indicators(hourly(spark, "/root/testdata/sf0.01"), ["EMA_20", "RSI_7", "RSI_14", "RSI_21", "volume_ratio", "ema_20_50_cross"]))
    ranges = [("RSI_14", "<", 30.0, 60.0), ("volume_ratio", ">", 0.5, 1.2)]
    trials = thresholds.proposals(ranges, 7)
    assert all(30 <= t["thresholds"]["RSI_14"] <= 60 and 60 <= t["level"] <= 85 for t in trials) and {t["period"] for t in trials} == {7, 14, 21}
    got = {r.trial: r for r in thresholds.evaluate(own, "close > EMA_20", ranges, trials, lot=3).collect()}
    rows = walk_forward(own, 3).where("part = 'oos'").toPandas()
    for t in trials:
        sharpes, returns, counts = {}, {}, {}
        for (symbol, _), part in rows.groupby(["symbol", "fold"]):
            part = part.sort_values("ts", ignore_index=True)
            enter = (part.close > part.EMA_20) & (part.RSI_14 < t["thresholds"]["RSI_14"]) & (part.volume_ratio > t["thresholds"]["volume_ratio"])
            leave = (part[f"RSI_{t['period']}"] > t["level"]) | (part.ema_20_50_cross == -1)
            found = fold(part.assign(entry_signal=enter.astype(int), exit_signal=leave.astype(int)), Risk())
            r = np.array([x[6] / 100 * x[10] for x in found])
            sharpes.setdefault(symbol, []).append(r.mean() / (r.std() + 1e-9) * 252**0.5 if len(r) else 0.0)
            returns.setdefault(symbol, []).append((found[0][-1] / 10_000 - 1) * 100 if found else 0.0)
            counts[symbol] = counts.get(symbol, 0) + len(found)
        sharpe, ret, n = (float(np.mean([np.mean(v) for v in x.values()])) for x in (sharpes, returns, counts))
        assert (got[t["trial"]].mean_sharpe, got[t["trial"]].mean_return, got[t["trial"]].mean_trades) == pytest.approx((sharpe, ret, n))
        assert got[t["trial"]].score == pytest.approx(-999.0 if n < 5 else sharpe + 0.01 * ret)


def test_small_helpers_of_the_analysis(spark):
    from barloom.operators import entries, ic, universe
    from barloom.plans import search

    df = spark.range(200).selectExpr("cast(id as double) a", "1.0D b", "if(id < 1, 1.0D, 0.0D) c", "if(id % 3 = 0, null, cast(id as double)) d", "if(id % 3 > 0, null, cast(id as double)) e", "cast(id as string) f")
    assert ic.informative(df, df.columns) == ["a", "d"] and ic.informative(df, ["f"]) == []
    pairs = spark.createDataFrame([("A", True), ("B", False)], "symbol string, excluded boolean")
    assert universe.reset_exclusions(pairs).where("excluded").count() == 0
    told = search.proposals_table(spark, study.propose(3)).collect()
    assert [r.trial for r in told] == [0, 1, 2] and len({r.name for r in told}) == 3 and "trend" in told[0].params
    effects = spark.createDataFrame([("x", -2.0), ("y", 1.0), ("z", 0.0)], "col string, cohens_d double")
    found = {r.col: r.score for r in entries.combined_scores(effects, spark.createDataFrame([("y", 0.5), ("z", 0.25)], "col string, importance double")).collect()}
    assert found == {"x": 0.5, "y": 0.75, "z": 0.25}


def test_coefficients_guide_a_search(spark):
    from barloom.operators import ic, stats
    from barloom.plans import search

    found = spark.createDataFrame([("RSI_14", 0.2), ("EMA_20", 0.05), ("x", None), ("CCI_20", 0.1)], "col string, max_abs_ic double")
    guide = ic.lookup(found, top=3)
    assert guide == {"RSI_14": 0.2, "CCI_20": 0.1, "EMA_20": 0.05}
    plain, led = search.propose(800), search.propose(800, guide=guide)
    share = lambda own: sum(p["setup"].startswith("rsi") for p in own) / len(own)
    assert share(led) > 1.7 * share(plain) and search.propose(800, guide={}) == plain
    # p-values against the density of Student's t, summed up
    import math

    for t, df in ((0.5, 3), (2.0, 10), (3.1, 57), (1.96, 100_000), (6.0, 4)):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        step = t / 20_000
        inside = sum(c * (1 + ((i + 0.5) * step) ** 2 / df) ** (-(df + 1) / 2) for i in range(20_000)) * step
        assert stats.t_sf(t, df) == pytest.approx(1 - 2 * inside, abs=1e-7)
