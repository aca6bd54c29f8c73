"""The universe of pairs: listing, filters, ranking, exclusion, merging; and small tables of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listing(markets: DataFrame, quote: str, kind: str = "spot") -> DataFrame:
    return markets.where((F.col("active") == True) & (F.col("quote_asset") == quote) & (F.col("type") == kind))  # noqa: E712


def viewed(pairs: DataFrame, min_volume: float | None = None, search: str | None = None) -> DataFrame:
    """Pairs by volume, at least so much of it, the search text anywhere in the symbol."""
    if min_volume is not None:
        pairs = pairs.where(F.col("volume_24h") >= min_volume)
    if search:
        pairs = pairs.where(F.upper("symbol").contains(search.upper()))
    return pairs.orderBy(F.desc("volume_24h"), "symbol")


def active(pairs: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    out = pairs.where("active and not excluded and candle_count > 0")
    return out.where(F.col("symbol").isin(chosen)) if chosen else out


def selected(pairs: DataFrame, filters: list[dict]) -> DataFrame:
    """The pairs that a list of filters leaves, by volume: VolumePairList (number_assets, min_value), AgeFilter (min_days_listed), OffsetFilter (offset, number_assets)."""
    out, ranked = pairs, (F.desc("volume_24h"), F.asc("symbol"))
    for f in filters:
        match f["method"]:
            case "VolumePairList":
                out = out.where(F.col("volume_24h") >= f.get("min_value", 0)).orderBy(*ranked).limit(f.get("number_assets", 80))
            case "AgeFilter":
                if f.get("use_age", False):  # by default ages count as unknown and old enough
                    out = out.where(F.datediff(F.current_date(), "data_start") >= f.get("min_days_listed", 0))
            case "OffsetFilter":
                out = out.orderBy(*ranked).offset(f.get("offset", 0))
                if "number_assets" in f:
                    out = out.limit(f["number_assets"])
    return out


def with_exclusions(pairs: DataFrame, filters: list[dict]) -> DataFrame:
    """pairs with excluded set for those that the filters don't leave."""
    kept = selected(pairs, filters).select("symbol", F.lit(True).alias("_kept"))
    return pairs.join(kept, "symbol", "left").withColumn("excluded", F.col("_kept").isNull()).drop("_kept").select(*pairs.columns)


def exclude_below(pairs: DataFrame, volume: float) -> DataFrame:
    return pairs.withColumn("excluded", F.col("excluded") | F.coalesce(F.col("volume_24h") < volume, F.lit(True)))


def reset_exclusions(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("excluded", F.lit(False))


def toggled(pairs: DataFrame, symbol: str) -> DataFrame:
    return pairs.withColumn("excluded", F.when(F.col("symbol") == symbol, ~F.col("excluded")).otherwise(F.col("excluded")))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """existing with `update` columns of the matching new rows, and the new rows that match none."""
    fresh = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in update), F.lit(True).alias("_hit"))
    changed = existing.join(fresh, keys, "left").select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in existing.columns))
    return changed.unionByName(new.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def updated(records: DataFrame, where: Column, values: dict[str, Column], allowed: set[str]) -> DataFrame:
    """records with the allowed values set where the condition holds; others are left out silently."""
    return records.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items() if k in allowed and k in records.columns})


def without(tables: dict[str, DataFrame], session_id: str, cascade: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables without a session's rows."""
    return {n: t.where(F.col("session_id") != session_id) if n in cascade else t for n, t in tables.items()}


def latest(records: DataFrame, by: list[str], order: str, *ties: str) -> DataFrame:
    """The newest row of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order), *ties)
    return records.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")


def top(records: DataFrame, n: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first n rows, of each group if by is given."""
    if not by:
        return records.orderBy(*order).limit(n)
    return records.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_p") <= n).drop("_p")


def tail(bars: DataFrame, n: int = 500) -> DataFrame:
    """The last n bars of each series."""
    return top(bars, n, [F.desc("ts")], ["symbol", "timeframe"])


def chart(bars: DataFrame, overlays: list[str], patterns: list[str], n: int = 500) -> DataFrame:
    """The data of a chart: the last bars, the overlay columns, and for each pattern a marker below (+) or above (-) the bar."""
    marks = [F.when(F.col(p) > 0, F.col("low") * 0.9985).when(F.col(p) < 0, F.col("high") * 1.0015).alias(f"{p}_marker") for p in patterns]
    return tail(bars, n).select("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume", *overlays, *marks)


#: The filters of a stored list.
FILTERS = "array<struct<method: string, number_assets: int, min_value: double, min_days_listed: int, offset: int>>"


def sessions(records: DataFrame) -> DataFrame:
    """Stored sessions with their JSON read: timeframes an array, pairlist_config an array of filters (empty where it can't be read), entry_mode path_b where absent."""
    has = set(records.columns)
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in has else F.lit(default)
    return records.withColumns({
        "timeframes": F.from_json("timeframes", "array<string>"), "pairlist_config": F.coalesce(F.from_json(text("pairlist_config", "[]"), FILTERS), F.array().cast(FILTERS)), "entry_mode": text("entry_mode", "path_b"),
        **{c: text(c, "") for c in ("entry_logic", "entry_logic_long", "entry_logic_short")},
    })


def counts(records: dict[str, DataFrame], by: str = "session_id") -> DataFrame:
    """Rows of each table by session, a column a table; 0 where it has none."""
    every = None
    for name, table in records.items():
        own = table.select(by, F.lit(name).alias("_t"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(by).pivot("_t", list(records)).count().na.fill(0, list(records))
