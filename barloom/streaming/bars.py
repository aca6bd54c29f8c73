"""Bars from a stream of prices: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bars import COLUMNS, width


def stream_bars(events: DataFrame, timeframe: str, symbol: str, ts: str, price: str, order: str, late: str = "1 hour") -> DataFrame:
    """A bar is emitted once the watermark has passed its end; later events of it are dropped."""
    at, value = F.struct(ts, order), F.col(price).cast("double")
    own = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    made = own.groupBy(F.window(ts, f"{width(timeframe)} seconds").alias("w"), F.col(symbol).alias("symbol")).agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").cast("double").alias("volume"))
    return made.withColumns({"timeframe": F.lit(timeframe), "ts": F.col("w.start")}).select(*COLUMNS)
