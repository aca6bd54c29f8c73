"""The registered statistics are of the operators' own sizes."""

from pathlib import Path

import pytest

from barloom import queries
from barloom.operators import stats
from barloom.plans import search


@pytest.mark.parametrize("name,operator,options", [("monte_carlo", stats.monte_carlo, {}), ("bootstrap_ci", stats.bootstrap, {}), ("permutation", stats.permutation, {"flip_signs": True})])
def test_draws(spark, sf, name, operator, options):
    want = operator(queries.returns_of(spark, sf), "symbol", **options)
    assert repr(queries.QUERIES[name](spark, sf).orderBy("symbol").collect()) == repr(want.orderBy("symbol").collect())


def test_trials(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(search, "evaluate", lambda enriched, proposals: asked.extend(proposals))
    monkeypatch.setattr(search, "scores", lambda results, **options: results)
    queries.QUERIES["search_scores"](spark, sf)
    assert [p["trial"] for p in asked] == list(range(100))


def test_lots_are_the_whole(spark, sf):
    larger = str(Path(sf).parent / "sf0.01")  # the smallest table has too few bars for a trade out of sample
    enriched = queries.with_indicators(queries.hourly(spark, larger), ["EMA_20", "EMA_50", "RSI_14", "MACD", "MACD_signal", "MACD_hist", "ATR_14", "volume_ratio", "SUPERT_dir", "STOCH_K"])
    one, many = (sorted(map(repr, search.evaluate(enriched, search.propose(12), lot=n).collect())) for n in (12, 5))
    assert one == many and one
