"""Bar series: reading, making from events or trades, merging, gates.

A bar is (symbol, timeframe, ts, open, high, low, close, volume), ts in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import kept

#: The columns of a series' name.
KEYS = ["symbol", "timeframe"]
PRICES = ["open", "high", "low", "close", "volume"]
COLUMNS = [*KEYS, "ts", *PRICES]

#: The timeframes and their seconds.
TIMEFRAMES = {"1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400, "3d": 259200, "1w": 604800}

#: Rows that a series needs, by what is done with it.
MINIMUM_ROWS = {"backtest": 50, "search": 100, "ic": 200, "entries": 100, "execution": 50, "higher": 20, "indicators": 50, "extended": 30}


def width(timeframe: str) -> int:
    return TIMEFRAMES[timeframe]


def clean(bars: DataFrame) -> DataFrame:
    """NaN prices become NULL, so that comparisons with them are unknown, not true."""
    return bars.withColumns({c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in PRICES})


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Bars of a Parquet folder; range and symbols reach the scan."""
    bars = spark.read.parquet(path)
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    return clean(bars.select(*COLUMNS))


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by timeframe and symbol, so that a series is read alone."""
    bars.repartition("timeframe", "symbol").sortWithinPartitions("timeframe", "symbol", "ts").write.mode(mode).partitionBy("timeframe", "symbol").parquet(path)


def replace_series(bars: DataFrame, path: str) -> None:
    """Writes the series of bars over what is stored of them; other series, which are other folders, stay.

    Rows are written aside first and then moved in, by dynamic partition
    overwrite, so a job that dies leaves the stored series as they were.
    """
    dealt = bars.repartition("timeframe", "symbol").sortWithinPartitions("timeframe", "symbol", "ts")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timeframe", "symbol").parquet(path)


def merge_series(new: DataFrame, path: str) -> None:
    """Merges new bars into the stored series they belong to (`merge`: stored rows stay); only these series are read and written."""
    spark = new.sparkSession
    stored = spark.read.parquet(path)
    touched = new.select("timeframe", "symbol").distinct()
    own = stored.join(touched, ["timeframe", "symbol"], "left_semi")
    replace_series(kept(merge(own, new)), path)


def bucket(ts: Column, timeframe: str) -> Column:
    """Beginning of the bar that holds ts, counted from the epoch."""
    w = width(timeframe)
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / F.lit(w * 1_000_000)) * w)


def resample(rows: DataFrame, timeframe: str, symbol: str, ts: str, price: str, order: list[str], volume: Column | None = None) -> DataFrame:
    """Bars of single prices: first, highest, lowest, last price of each bucket; volume is the count or the given sum.

    Partial aggregation happens before the shuffle: open and close are the
    prices at the smallest and largest (ts, order).
    """
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    at = F.struct(ts, *order)
    value = F.nullif(F.col(price).cast("double"), F.lit(float("nan")))
    made = rows.groupBy(F.col(symbol).alias("symbol"), bucket(F.col(ts), timeframe).alias("ts")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), (F.sum(volume) if volume is not None else F.count("*")).cast("double").alias("volume")
    )
    return made.withColumn("timeframe", F.lit(timeframe)).select(*COLUMNS)


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/events.parquet"), timeframe, "event_type", "ts", "value", ["event_id"])


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series of order prices by priority."""
    return resample(spark.read.parquet(f"{sf_dir}/orders.parquet"), "1d", "o_orderpriority", "o_orderdate", "o_totalprice", ["o_orderkey"])


def higher(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe from bars of a shorter."""
    at = F.col("ts")
    made = bars.groupBy("symbol", bucket(at, timeframe).alias("bar")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return made.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("bar").alias("ts"), *PRICES)


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name; of rows with one (symbol, timeframe, ts) the existing one stays."""
    both = existing.withColumn("_source", F.lit(0)).unionByName(new.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*KEYS, "ts").orderBy("_source"))
    return both.withColumn("_place", first).where("_place = 1").drop("_place", "_source")


def with_minimum(bars: DataFrame, use: str) -> DataFrame:
    """The series with enough rows for a use."""
    return bars.withColumn("_n", F.count("*").over(Window.partitionBy(*KEYS))).where(F.col("_n") >= MINIMUM_ROWS[use]).drop("_n")


def next_since(bars: DataFrame, lookback_start: str) -> DataFrame:
    """Per series, where the next download starts: a bar after the last, at least lookback_start."""
    seconds = F.create_map(*(F.lit(x) for kv in TIMEFRAMES.items() for x in kv))[F.col("timeframe")]
    after = F.timestamp_seconds(F.unix_timestamp(F.max("ts")) + F.first(seconds))
    return bars.groupBy(*KEYS).agg(F.greatest(after, F.lit(lookback_start).cast("timestamp")).alias("since"))


def strip(enriched: DataFrame) -> DataFrame:
    """The bars alone; the scan reads only their columns."""
    return enriched.select(*COLUMNS)


def extent(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEYS).agg(F.count("*").alias("candle_count"), F.min("ts").alias("data_start"), F.max("ts").alias("data_end"))
