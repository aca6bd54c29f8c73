"""Stored series and the paged data source."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from barloom.sources import bars as source
from barloom.sources.paged import Files, PagedBars, _Narrowed, milliseconds

HOUR, START = 3_600_000, 1_704_067_200_000


def write_pages(folder, symbol, n, size, timeframe="1h", first=0):
    path = folder / symbol / timeframe
    path.mkdir(parents=True, exist_ok=True)
    rows = [[START + (first + i) * HOUR, 1.0 + i, 2.0 + i, 0.5, 1.5 + first + i, 10.0] for i in range(n)]
    for at in range(0, n, size):
        (path / f"{rows[at][0]}.json").write_text(json.dumps(rows[at : at + size]))


@pytest.fixture
def paged(spark, tmp_path):
    write_pages(tmp_path, "AAA", 103, 20)
    write_pages(tmp_path, "BBB", 37, 20)
    spark.dataSource.register(PagedBars)
    return tmp_path


def options(folder, **more):
    return {"folder": str(folder), "symbols": "AAA,BBB,NONE", "timeframes": "1h", "since": str(START), "limit": "7", "pages": "2"} | more


def test_pages_are_partitions(spark, paged):
    df = spark.read.format("paged_bars").options(**options(paged)).load()
    got = df.toPandas()
    assert len(got) == 140 and len(got.drop_duplicates(["symbol", "ts"])) == 140
    assert got[got.symbol == "AAA"].close.sort_values().tolist() == [1.5 + i for i in range(103)]
    assert df.rdd.getNumPartitions() == 3 * -(-103 // 14)
    assert spark.read.format("paged_bars").options(**options(paged, symbols="NONE")).load().count() == 0


def test_filters_reach_the_source(spark, paged):
    reader = _Narrowed(options(paged))
    at = lambda h: pd.Timestamp(START + h * HOUR, unit="ms", tz="UTC").to_pydatetime()
    left = list(reader.pushFilters([EqualTo(("symbol",), "AAA"), GreaterThanOrEqual(("ts",), at(50)), LessThan(("ts",), at(60)), EqualTo(("close",), 1.0)]))
    assert [f.attribute[0] for f in left] == ["ts", "ts", "close"] and reader.symbols == ["AAA"]
    assert [(p.since, p.until) for p in reader.partitions()] == [(START + 50 * HOUR, START + 60 * HOUR + 1)]
    assert list(_Narrowed(options(paged)).pushFilters([In(("symbol",), ("BBB", "CCC"))])) == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("paged_bars").options(**options(paged, push="true")).load().where((F.col("symbol") == "AAA") & (F.col("ts") >= F.lit(at(50))) & (F.col("ts") < F.lit(at(60))))
        assert df.count() == 10 and df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_stream_goes_on_from_its_checkpoint(spark, paged, tmp_path):
    def run():
        live = spark.readStream.format("paged_bars").options(**options(paged)).load()
        q = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
        return spark.read.parquet(str(tmp_path / "out")).toPandas()

    assert len(run()) == 140
    write_pages(paged, "AAA", 9, 20, first=103)
    got = run()
    assert len(got) == 149 and not got.duplicated(["symbol", "ts"]).any()


def test_pages_are_asked_for_again(monkeypatch):
    calls = []

    class Shaky(Files):
        def page(self, *a):
            calls.append(a)
            if len(calls) < 3:
                raise OSError("busy")
            return [[START, 1, 2, 0, 1, None]]

    monkeypatch.setattr("barloom.sources.paged.Files", Shaky)
    monkeypatch.setattr("time.sleep", lambda s: None)
    reader = _Narrowed(options("/nowhere"))
    (batch,) = reader.read(type("P", (), {"symbol": "A", "timeframe": "1h", "since": START, "until": START + HOUR}))
    assert len(calls) == 3 and batch.num_rows == 1 and batch.column("volume").to_pylist() == [None]
    assert milliseconds("2024-01-01T00:00:00") == START == milliseconds(str(START))


def bars(spark, symbol, first, n, close):
    rows = pd.DataFrame({"symbol": symbol, "timeframe": "1h", "ts": pd.date_range("2024-01-01", periods=n, freq="h") + pd.Timedelta(hours=first), "open": 1.0, "high": 2.0, "low": 0.5, "close": float(close), "volume": np.arange(n) * 1.0})
    return spark.createDataFrame(rows)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_stored_series(spark, tmp_path):
    path = str(tmp_path / "bars")
    source.write_bars(bars(spark, "A", 0, 30, 1).unionByName(bars(spark, "B", 0, 20, 2)), path)
    before = files(path)
    df = source.read_bars(spark, path, start="2024-01-01 05:00:00", end="2024-01-01 09:00:00", symbols=["A"])
    assert df.count() == 5
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan or "PartitionFilters: [(symbol" in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    # overlapping and new bars of A alone: stored rows stay, B's folder isn't touched
    source.merge_series(bars(spark, "A", 25, 10, 9), path)
    a = spark.read.parquet(path).where("symbol = 'A'")
    assert a.count() == 35 and a.where("close = 9").count() == 5
    after = files(path)
    assert {f: t for f, t in before.items() if "symbol=B" in f} == {f: t for f, t in after.items() if "symbol=B" in f}
    # enriched series replace stored ones; a third series is added
    source.replace_series(bars(spark, "A", 0, 3, 5).unionByName(bars(spark, "C", 0, 4, 6)), path)
    assert {r.symbol: r["count"] for r in spark.read.parquet(path).groupBy("symbol").count().collect()} == {"A": 3, "B": 20, "C": 4}
    assert {f: t for f, t in before.items() if "symbol=B" in f}.items() <= files(path).items()
    source.merge_series(bars(spark, "D", 0, 2, 1), path)
    assert spark.read.parquet(path).count() == 29
