"""Streams whose state is a series': the same as in batch, also after a restart."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.indicators import with_indicators
from barloom.operators.simulate import Risk, trades
from barloom.streaming.state import stream_means, stream_trades


@pytest.fixture
def bars(spark, tmp_path):
    """Bars in five files, of which the last two come later; some of the last come twice."""
    rng, parts = np.random.default_rng(3), []
    for symbol, n in (("A", 160), ("B", 70)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        parts.append(pd.DataFrame({"symbol": symbol, "timeframe": "1h", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 1.0, "entry_signal": (rng.random(n) < 0.3).astype(int), "exit_signal": (rng.random(n) < 0.1).astype(int)}))
    rows = pd.concat(parts)
    rows.loc[rows.sample(5, random_state=1).index, "close"] = np.nan
    df = spark.createDataFrame(rows).withColumn("close", F.nullif("close", F.lit(float("nan"))))
    cuts = pd.to_datetime(["2023-01-01", "2024-01-02 03:00", "2024-01-02 20:00", "2024-01-04", "2024-01-05", "2025-01-01"], format="ISO8601")
    pieces = [df.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))) for a, b in zip(cuts, cuts[1:], strict=False)]
    pieces[4] = pieces[4].unionByName(pieces[3].limit(7))
    return df, pieces, tmp_path


def streamed(spark, made, bars):
    """made(stream) over the files, one a batch, ended and begun again on the way."""
    df, pieces, folder = bars
    for group in (pieces[:3], pieces[3:]):
        for piece in group:
            piece.coalesce(1).write.mode("append").parquet(str(folder / "in"))
        live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder / "in"))
        q = made(live).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        q.stop()
    return spark.read.parquet(str(folder / "out"))


def test_means(spark, bars):
    got = streamed(spark, lambda live: stream_means(live, {"EMA_8": 8, "EMA_20": 20}), bars).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    want = with_indicators(bars[0], ["EMA_8", "EMA_20"]).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert len(got) == len(want) == 230
    for c in ("EMA_8", "EMA_20"):
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True)


def test_trades(spark, bars):
    risk = Risk(sl_pct=0.03, tp_pct=0.04, trail_mode="fixed")
    got = streamed(spark, lambda live: stream_trades(live, risk), bars).toPandas().sort_values(["symbol", "entry_idx"], ignore_index=True)
    want = trades(bars[0], risk).where("exit_reason <> 'end_of_data'").toPandas().sort_values(["symbol", "entry_idx"], ignore_index=True)
    assert len(want) > 8
    pd.testing.assert_frame_equal(got[["symbol", "entry_ts", "exit_ts", "entry_price", "pnl_pct", "exit_reason", "is_winner"]], want[["symbol", "entry_ts", "exit_ts", "entry_price", "pnl_pct", "exit_reason", "is_winner"]], check_dtype=False)
    assert got[["entry_idx", "exit_idx"]].to_numpy().tolist() == want[["entry_idx", "exit_idx"]].to_numpy().tolist()
