"""The registered queries of the engine, each over whole tables, with SQL for those that SQL can express."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates, quantiles
from .functions.chunks import kept
from .functions.indicators import CANDLES, with_indicators
from .operators import asof, entries, ic, simulate, stats, universe
from .plans import catalog, rules, search, strategy, study, thresholds
from .sources import bars as source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: Added before rounding where exact halves are common, which two engines' sums put on either side.
NUDGE = 3e-8


def shown(df: DataFrame, columns: list[str | Column], ts: bool = True, places: int = 6, nudge: float = 0.0) -> DataFrame:
    """Keys, the time as text, and the columns, doubles rounded."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [F.round(F.col(c) + nudge if nudge else F.col(c), places).alias(c) if isinstance(c, str) and kinds[c] == "double" else F.col(c) if isinstance(c, str) else c for c in columns]
    at = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")] if ts else []
    return df.select("symbol", *at, *out)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.event_bars(spark, sf_dir, "1h")


BARS = """
bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def windows(*sizes: int) -> str:
    return "WINDOW w AS (PARTITION BY symbol ORDER BY ts), " + ", ".join(f"r{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)


def roll(f: str, x: str, n: int, extra: str = "") -> str:
    return f"CASE WHEN count({x}) OVER r{n} = {n} THEN {f}({x}{extra}) OVER r{n} END"


def select(columns: dict[str, str], sizes: tuple[int, ...], ctes: str = "", table: str = "bars", places: int = 6) -> str:
    """SQL for indicator columns over the bars, rounded."""
    body = ", ".join(f"round({x}, {places}) AS {n}" for n, x in columns.items())
    return f"WITH {BARS}{', ' + ctes if ctes else ''} SELECT symbol, {TS}, {body} FROM {table} {windows(*sizes) if sizes else ''}"


def indicators(name: str, wanted: list[str], sql: str | None = None, places: int = 6, nudge: float = 0.0, rows: int | None = None) -> None:
    """A query of some indicators over hourly bars; with rows, over chunks of series."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(with_indicators(hourly(spark, sf_dir), wanted, rows), wanted, places=places, nudge=nudge)

    run.__name__ = name
    query(sql)(run)


@query(f"WITH {BARS} SELECT symbol, {TS}, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def bars_ohlcv(spark, sf_dir):
    return shown(hourly(spark, sf_dir), ["open", "high", "low", "close", "volume"])


indicators("sma_wma", ["SMA_20", "SMA_50", "WMA_20"], select({"SMA_20": roll("avg", "close", 20), "SMA_50": roll("avg", "close", 50), "WMA_20": "CASE WHEN count(close) OVER r20 = 20 THEN list_dot_product(list(close) OVER r20, [(2.0 * i / 420)::DOUBLE FOR i IN range(1, 21)]) END"}, (20, 50)))


def ema(x: str, alpha: str, least: int = 1) -> str:
    """SQL of an exponential mean of the values so far."""
    return f"CASE WHEN count({x}) OVER w >= {least} THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER w, lambda a, b: a + {alpha} * (b - a)) END"


indicators("ema_family", ["EMA_20", "EMA_50", "APO_12_26", "GMMA_S3", "BULL_POWER_13"], select({"EMA_20": ema("close", "(2.0/21)", 20), "EMA_50": ema("close", "(2.0/51)", 50), "APO_12_26": f"({ema('close', '(2.0/13)')}) - ({ema('close', '(2.0/27)')})", "GMMA_S3": ema("close", "(2.0/4)"), "BULL_POWER_13": f"high - ({ema('close', '(2.0/14)')})"}, (20,)))
STEPS = "steps AS (SELECT *, greatest(close - lag(close) OVER s, 0) AS up, greatest(lag(close) OVER s - close, 0) AS down FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)), first AS (SELECT * REPLACE (CASE WHEN lag(close) OVER s IS NULL THEN NULL ELSE up END AS up, CASE WHEN lag(close) OVER s IS NULL THEN NULL ELSE down END AS down) FROM steps WINDOW s AS (PARTITION BY symbol ORDER BY ts))"
indicators("rsi", ["RSI_7", "RSI_14"], select({f"RSI_{n}": f"CASE WHEN count(up) OVER w >= {n} THEN CASE WHEN ({ema('down', f'(1.0/{n})')}) = 0 THEN 100 ELSE 100 - 100 / (1 + ({ema('up', f'(1.0/{n})')}) / ({ema('down', f'(1.0/{n})')})) END END" for n in (7, 14)}, (20,), STEPS, "first"))
MACD_SQL = f"WITH {BARS}, l AS (SELECT *, ({ema('close', '(2.0/13)', 12)}) - ({ema('close', '(2.0/27)', 26)}) AS line FROM bars {windows(20)}), s AS (SELECT *, {ema('line', '(2.0/10)', 9)} AS sig FROM l {windows(20)}) SELECT symbol, {TS}, round(line, 6) AS \"MACD\", round(sig, 6) AS \"MACD_signal\", round(line - sig, 6) AS \"MACD_hist\" FROM s"
indicators("macd", ["MACD", "MACD_signal", "MACD_hist"], MACD_SQL)
_K = f"({roll('max', 'high', 14)} - {roll('min', 'low', 14)})"
_STOCH = f"k AS (SELECT *, (close - {roll('min', 'low', 14)}) / nullif({_K}, 0) * 100 AS sk, -100 * ({roll('max', 'high', 14)} - close) / nullif({_K}, 0) AS wr FROM bars {windows(14)})"
indicators("stochastic", ["STOCH_K", "STOCH_D", "WILLR_14"], select({"STOCH_K": "sk", "STOCH_D": roll("avg", "sk", 3), "WILLR_14": "wr + 0.0"}, (3,), _STOCH, "k"))
_BB = f"b AS (SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_pop', 'close', 20)} AS s FROM bars {windows(20)})"
indicators("bollinger", ["BB_upper_20", "BB_mid_20", "BB_lower_20", "BB_width_20", "BB_pct_20"], select({"BB_upper_20": "m + 2 * s", "BB_mid_20": "m", "BB_lower_20": "m - 2 * s", "BB_width_20": "4 * s / nullif(m, 0) * 100", "BB_pct_20": "(close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0)"}, (), _BB, "b"))
_KC = "t AS (SELECT *, (high + low + close) / 3 AS tp, (4 * high - 2 * low + close) / 3 AS ku, (-2 * high + 4 * low + close) / 3 AS kl FROM bars)"
indicators("keltner_donchian", ["KC_middle", "KC_upper", "KC_lower", "DC_upper", "DC_lower", "DC_middle"], select({"KC_middle": roll("avg", "tp", 20), "KC_upper": roll("avg", "ku", 20), "KC_lower": roll("avg", "kl", 20), "DC_upper": roll("max", "high", 20), "DC_lower": roll("min", "low", 20), "DC_middle": f"({roll('max', 'high', 20)} + {roll('min', 'low', 20)}) / 2"}, (20,), _KC, "t"))
_VOL = "v AS (SELECT *, CASE WHEN close < lag(close) OVER s THEN -volume ELSE volume END AS ob, (2 * close - low - high) / nullif(high - low, 0) * volume AS av, (close / nullif(lag(close) OVER s, 0) - 1) * volume AS pv FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts))"
indicators("obv_ad_pvt", ["OBV", "AD", "PVT"], select({"OBV": "sum(ob) OVER w", "AD": "sum(av) OVER w", "PVT": "sum(pv) OVER w"}, (20,), _VOL, "v", places=2), places=2)
_MF = "t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT *, CASE WHEN tp > lag(tp) OVER s THEN tp * volume ELSE 0 END AS mp, CASE WHEN tp < lag(tp) OVER s THEN tp * volume ELSE 0 END AS mn, coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume AS cv, tp * volume AS tv FROM t WINDOW s AS (PARTITION BY symbol ORDER BY ts))"
indicators("mfi_cmf_vwap", ["MFI_14", "CMF_20", "VWAP"], select({"MFI_14": f"100 - 100 / (1 + {roll('sum', 'mp', 14)} / nullif({roll('sum', 'mn', 14)}, 0))", "CMF_20": f"{roll('sum', 'cv', 20)} / nullif({roll('sum', 'volume', 20)}, 0)", "VWAP": f"{roll('sum', 'tv', 14)} / nullif({roll('sum', 'volume', 14)}, 0)"}, (14, 20), _MF, "m"))
indicators("roc_mom", ["ROC_10", "ROC_20", "MOM_10", "MIDPOINT_14", "MIDPRICE_14"], select({"ROC_10": "(close / nullif(lag(close, 10) OVER w, 0) - 1) * 100", "ROC_20": "(close / nullif(lag(close, 20) OVER w, 0) - 1) * 100", "MOM_10": "close - lag(close, 10) OVER w", "MIDPOINT_14": f"({roll('max', 'close', 14)} + {roll('min', 'close', 14)}) / 2", "MIDPRICE_14": f"({roll('max', 'high', 14)} + {roll('min', 'low', 14)}) / 2"}, (14,)))
indicators("zscore_stddev", ["STDDEV_20", "VAR_20", "ZSCORE_20"], select({"STDDEV_20": roll("stddev_samp", "close", 20), "VAR_20": roll("var_samp", "close", 20), "ZSCORE_20": f"(close - {roll('avg', 'close', 20)}) / nullif({roll('stddev_samp', 'close', 20)}, 0)"}, (20,)))
indicators("skew_kurt", ["SKEW_20", "KURT_20"], select({"SKEW_20": roll("skewness", "close", 20), "KURT_20": roll("kurtosis", "close", 20)}, (20,)))
indicators("quantile_rank", ["MEDIAN_20", "QUANTILE_75_20", "QUANTILE_25_20", "PCT_RANK_20", "MAD_20"], select({"MEDIAN_20": roll("quantile_cont", "close", 20, ", 0.5"), "QUANTILE_75_20": roll("quantile_cont", "close", 20, ", 0.75"), "QUANTILE_25_20": roll("quantile_cont", "close", 20, ", 0.25"), "PCT_RANK_20": "CASE WHEN count(close) OVER r20 = 20 THEN (len(list_filter(list(close) OVER r20, lambda x: x < close)) + (len(list_filter(list(close) OVER r20, lambda x: x = close)) + 1) / 2) / 20 END", "MAD_20": "CASE WHEN count(close) OVER r20 = 20 THEN list_avg(list_transform(list(close) OVER r20, lambda x: abs(x - avg(close) OVER r20))) END"}, (20,)))
_RN = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"
_SL, _IC = "CASE WHEN count(close) OVER r14 = 14 THEN regr_slope(close, rn) OVER r14 END", "CASE WHEN count(close) OVER r14 = 14 THEN regr_intercept(close, rn) OVER r14 END"
indicators("linreg", ["LINREG_14", "LINREG_SLOPE_14", "TSF_14"], select({"LINREG_14": f"{_IC} + {_SL} * rn", "LINREG_SLOPE_14": _SL, "TSF_14": f"{_IC} + {_SL} * (rn + 1)"}, (14,), _RN, "n"))
indicators("rolling_corr", ["CORREL_CV_14", "CORREL_HL_14"], select({"CORREL_CV_14": "CASE WHEN count(close) OVER r14 = 14 AND isfinite(corr(close, volume) OVER r14) THEN corr(close, volume) OVER r14 END", "CORREL_HL_14": "CASE WHEN count(close) OVER r14 = 14 AND isfinite(corr(high, low) OVER r14) THEN corr(high, low) OVER r14 END"}, (14,)))


def candle_sql() -> str:
    prices = ("open", "high", "low", "close")
    lags = ", ".join(f"lag({x}, {k}) OVER s AS {x[0]}{k}" for x in prices for k in (1, 2))
    d = f"c AS (SELECT *, abs(close - open) AS b, high - low AS r, high - greatest(open, close) AS u, least(open, close) - low AS d, {lags} FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)), e AS (SELECT *, b / nullif(r, 0) AS p, abs(c1 - o1) AS b1, abs(c2 - o2) AS b2 FROM c)"
    up, down = "close > open", "close < open"
    conditions = {
        "DOJI": "p < .1", "SPINNING_TOP": "p > .1 AND p < .35 AND u > .5 * b AND d > .5 * b", "BULL_MARUBOZU": f"{up} AND p > .9", "BEAR_MARUBOZU": f"-{down} AND p > .9",
        "HAMMER": f"{up} AND d > 2 * b AND u < .5 * b", "HANGING_MAN": f"-{down} AND d > 2 * b AND u < .5 * b", "INV_HAMMER": f"{up} AND u > 2 * b AND d < .5 * b", "SHOOTING_STAR": f"-{down} AND u > 2 * b AND d < .5 * b",
        "DRAGONFLY": "p < .1 AND d > .7 * r", "GRAVESTONE": "-p < .1 AND u > .7 * r", "BULL_ENGULFING": f"{up} AND c1 < o1 AND open <= c1 AND close >= o1", "BEAR_ENGULFING": f"-{down} AND c1 > o1 AND open >= c1 AND close <= o1",
        "BULL_HARAMI": f"c1 < o1 AND {up} AND open > c1 AND close < o1 AND b < .5 * b1", "BEAR_HARAMI": f"-c1 > o1 AND {down} AND open < c1 AND close > o1 AND b < .5 * b1",
        "DARK_CLOUD": f"-c1 > o1 AND {down} AND open > h1 AND close < (o1 + c1) / 2 AND close > o1", "PIERCING": f"c1 < o1 AND {up} AND open < l1 AND close > (o1 + c1) / 2 AND close < o1",
        "TWEEZER_TOP": f"-c1 > o1 AND {down} AND abs(high - h1) < .02 * r", "TWEEZER_BOTTOM": f"c1 < o1 AND {up} AND abs(low - l1) < .02 * r", "INSIDE_BAR": "high <= h1 AND low >= l1", "OUTSIDE_BAR": "high > h1 AND low < l1",
        "3_WHITE_SOLDIERS": f"{up} AND c1 > o1 AND c2 > o2 AND open > o1 AND open < c1 AND o1 > o2 AND o1 < c2 AND close > c1 AND c1 > c2", "3_BLACK_CROWS": f"-{down} AND c1 < o1 AND c2 > o2 AND open < o1 AND open > c1 AND close < c1 AND c1 < c2",
        "MORNING_STAR": f"c2 < o2 AND {up} AND b1 < .3 * b AND close > (o2 + c2) / 2", "EVENING_STAR": f"-c2 > o2 AND {down} AND b1 < .3 * b AND close < (o2 + c2) / 2",
        "3_INSIDE_UP": f"c2 < o2 AND c1 > o1 AND o1 > c2 AND c1 < o2 AND {up} AND close > c1", "3_INSIDE_DOWN": f"-c2 > o2 AND c1 < o1 AND o1 < c2 AND c1 > o2 AND {down} AND close < c1",
    }
    body = ", ".join(f'CASE WHEN {c.lstrip("-")} THEN {-100 if c[0] == "-" else 100} ELSE 0 END AS "CDL_{n}"' for n, c in conditions.items())
    return f"WITH {BARS}, {d} SELECT symbol, {TS}, {body} FROM e"


indicators("candle_patterns", CANDLES, candle_sql())
_H, _L = roll("max", "high", 20), roll("min", "low", 20)
_PP = f"p AS (SELECT *, {_H} AS h20, {_L} AS l20, ({_H} + {_L} + {roll('avg', 'close', 20)}) / 3 AS pp FROM bars {windows(20)})"
indicators("pivots_structure", ["PP", "R1", "R2", "S1", "S2", "PP_dist_pct", "PRICE_RANGE_PCT", "HH", "LL"], select({"PP": "pp", "R1": "2 * pp - l20", "R2": "pp + h20 - l20", "S1": "2 * pp - h20", "S2": "pp - h20 + l20", "PP_dist_pct": "(close - pp) / nullif(pp, 0) * 100", "PRICE_RANGE_PCT": "(close - l20) / nullif(h20 - l20, 0) * 100", "HH": "coalesce(high > lag(h20) OVER w, false)::INT", "LL": "coalesce(low < lag(l20) OVER w, false)::INT"}, (20,), _PP, "p"))
_BS = f"p AS (SELECT *, max(high) OVER w AS top, min(low) OVER w AS bottom, row_number() OVER w AS rn FROM bars {windows(20)})"
indicators("bars_since_high", ["BARS_SINCE_HIGH", "BARS_SINCE_LOW"], select({"BARS_SINCE_HIGH": "rn - max(CASE WHEN high = top THEN rn END) OVER w", "BARS_SINCE_LOW": "rn - max(CASE WHEN low = bottom THEN rn END) OVER w"}, (20,), _BS, "p"))
# the same over chunks of series, with the same SQL
indicators("ema_family_in_chunks", ["EMA_20", "EMA_50", "APO_12_26", "GMMA_S3", "BULL_POWER_13"], ORACLES["ema_family"], rows=200)
indicators("macd_in_chunks", ["MACD", "MACD_signal", "MACD_hist"], ORACLES["macd"], rows=200)
indicators("rsi_in_chunks", ["RSI_7", "RSI_14"], ORACLES["rsi"], rows=200)
indicators("obv_ad_pvt_in_chunks", ["OBV", "AD", "PVT"], ORACLES["obv_ad_pvt"], places=2, rows=200)
indicators("bars_since_high_in_chunks", ["BARS_SINCE_HIGH", "BARS_SINCE_LOW"], ORACLES["bars_since_high"], rows=200)
_M = {n: f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2" for n in (9, 26, 52)}
_IK = f"i AS (SELECT *, {_M[9]} AS t, {_M[26]} AS k, ({_M[9]} + {_M[26]}) / 2 AS a, {_M[52]} AS b FROM bars {windows(9, 26, 52)})"
indicators("ichimoku", ["ICH_tenkan", "ICH_kijun", "ICH_senkou_a", "ICH_senkou_b", "ICH_above_cloud", "ICH_below_cloud"], select({"ICH_tenkan": "t", "ICH_kijun": "k", "ICH_senkou_a": "a", "ICH_senkou_b": "b", "ICH_above_cloud": "coalesce(close > a AND close > b, false)::INT", "ICH_below_cloud": "coalesce(close < a AND close < b, false)::INT"}, (), _IK, "i"))
_AV = "g AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr, abs(high - lag(low) OVER s) AS vp, abs(low - lag(high) OVER s) AS vn, abs(close - lag(close) OVER s) AS ad FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts))"
indicators("aroon_vortex", ["AROON_up", "AROON_down", "AROON_osc", "VI_pos", "VI_neg"], select({"AROON_up": "CASE WHEN count(high) OVER r26 = 26 THEN (list_position(list(high) OVER r26, max(high) OVER r26) - 1) * 4.0 END", "AROON_down": "CASE WHEN count(low) OVER r26 = 26 THEN (list_position(list(low) OVER r26, min(low) OVER r26) - 1) * 4.0 END", "AROON_osc": "CASE WHEN count(high) OVER r26 = 26 THEN (list_position(list(high) OVER r26, max(high) OVER r26) - list_position(list(low) OVER r26, min(low) OVER r26)) * 4.0 END", "VI_pos": f"{roll('sum', 'vp', 14)} / nullif({roll('sum', 'tr', 14)}, 0)", "VI_neg": f"{roll('sum', 'vn', 14)} / nullif({roll('sum', 'tr', 14)}, 0)"}, (14, 26), _AV, "g"))
indicators("choppiness_vhf", ["CHOP_14", "VHF_28"], select({"CHOP_14": f"100 * log10({roll('sum', 'tr', 14)} / nullif({_K}, 0)) / log10(14)", "VHF_28": f"({roll('max', 'close', 28)} - {roll('min', 'close', 28)}) / nullif({roll('sum', 'ad', 28)}, 0)"}, (14, 28), _AV, "g"))
def recursion(name: str, source: str, state: dict[str, tuple[str, str]]) -> str:
    """SQL of a fold over each series: by column its first value, of the row x, and its next, of the state s and the row x. source has symbol and rn from 0 on."""
    first, then = (", ".join(f"({v[k]})::DOUBLE" for v in state.values()) for k in (0, 1))
    return f"{name}(symbol, rn, {', '.join(state)}) AS (SELECT symbol, rn, {first} FROM {source} x WHERE rn = 0 UNION ALL SELECT x.symbol, x.rn, {then} FROM {name} s JOIN {source} x ON x.symbol = s.symbol AND x.rn = s.rn + 1)"


def mean_state(x: str, alpha: str, s: str) -> tuple[str, str]:
    """State of an exponential mean of x, from its first value on."""
    return x, f"CASE WHEN {x} IS NULL THEN s.{s} WHEN s.{s} IS NULL THEN {x} ELSE s.{s} + {alpha} * ({x} - s.{s}) END"


def gap_state(x: str, alpha: float, s: str) -> dict[str, tuple[str, str]]:
    """States of an exponential mean whose missing values age what is before them."""
    old = f"pow({1 - alpha!r}, s.{s}_gap)"
    return {s: (x, f"CASE WHEN {x} IS NULL THEN s.{s} WHEN s.{s} IS NULL THEN {x} ELSE ({old} * s.{s} + {alpha!r} * {x}) / ({old} + {alpha!r}) END"), f"{s}_gap": ("1", f"CASE WHEN {x} IS NULL THEN s.{s}_gap + 1 ELSE 1 END")}


def indicator_sql(columns: dict[str, str], table: str, ctes: str, sizes: tuple[int, ...] = (), places: int = 6, nudge: float = 0.0) -> str:
    """SQL for indicator columns over a table of the CTEs; `base` are the bars with rn, n, true range and lags."""
    base = "base AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS rn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, close - lag(close) OVER w AS dc FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
    body = ", ".join(f"round(({x}) + {nudge}, {places}) AS \"{n}\"" for n, x in columns.items())
    return f"WITH {BARS.replace(chr(10) + 'bars AS', 'RECURSIVE bars AS', 1)}, {base}, {ctes} SELECT symbol, {TS}, {body} FROM {table} {windows(*sizes)}"


def level(name: str, source: str, columns: dict[str, str], sizes: tuple[int, ...] = ()) -> str:
    """A CTE that adds columns to a source."""
    return f"{name} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM {source} {windows(*sizes)})"


def joined(name: str, source: str, folds: list[str]) -> str:
    return f"{name} AS (SELECT * FROM {source} {' '.join(f'JOIN {f} USING (symbol, rn)' for f in folds)})"


_PERIODS = (7, 14, 21)
_ATR = ", ".join([
    level("atr_in", "base", {f"m{n}": f"avg(tr) OVER r{n}" for n in _PERIODS}, _PERIODS),
    recursion("atr", "atr_in", {f"a{n}": ("0", f"CASE WHEN x.rn < {n - 1} THEN 0 WHEN x.rn = {n - 1} THEN x.m{n} ELSE (s.a{n} * {n - 1} + x.tr) / {n} END") for n in _PERIODS}), joined("ranged", "base", ["atr"]),
])
indicators("atr_wilder", ["ATR_7", "ATR_14", "ATR_21", "NATR_7", "NATR_14", "NATR_21", "VOL_RATIO_14", "HIGH_VOL_REGIME"], indicator_sql({"ATR_7": "a7", "ATR_14": "a14", "ATR_21": "a21", "NATR_7": "a7 / nullif(close, 0) * 100", "NATR_14": "a14 / nullif(close, 0) * 100", "NATR_21": "a21 / nullif(close, 0) * 100", "VOL_RATIO_14": f"a14 / nullif({roll('avg', 'a14', 100)}, 0)", "HIGH_VOL_REGIME": f"coalesce(a14 > {roll('quantile_cont', 'a14', 100, ', 0.75')}, false)::INT"}, "ranged", _ATR, (100,)))

_DM = {"plus": "CASE WHEN high - h1 > l1 - low AND high > h1 THEN high - h1 ELSE 0 END", "minus": "CASE WHEN l1 - low > high - h1 AND l1 > low THEN l1 - low ELSE 0 END"}
_WILDER = {f"{c}{n}": ("0", f"CASE WHEN x.rn < {n} THEN 0 WHEN x.rn = {n} THEN x.{c}_{n} ELSE s.{c}{n} - s.{c}{n} / {n} + x.{c} END") for n in _PERIODS for c in ("tr", "plus", "minus")}
_ADX = ", ".join([
    level("dm", "base", _DM), level("dms", "dm", {f"{c}_{n}": f"sum({c}) OVER r{n}" for n in _PERIODS for c in ("tr", "plus", "minus")}, _PERIODS), recursion("dmf", "dms", _WILDER),
    level("lines", "dmf", {f"{x}{n}": f"CASE WHEN tr{n} > 0 THEN 100 * {c}{n} / tr{n} ELSE 0 END" for n in _PERIODS for x, c in (("up", "plus"), ("dn", "minus"))}),
    level("dxs", "lines", {f"dx{n}": f"CASE WHEN up{n} + dn{n} > 0 THEN 100 * abs(up{n} - dn{n}) / (up{n} + dn{n}) ELSE 0 END" for n in _PERIODS}),
    "dxm AS (SELECT *, " + ", ".join(f"avg(dx{n}) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS dm{n}" for n in _PERIODS) + " FROM dxs)",
    recursion("adx", "dxm", {f"x{n}": ("0", f"CASE WHEN x.rn < {2 * n - 1} THEN 0 WHEN x.rn = {2 * n - 1} THEN x.dm{n} ELSE (s.x{n} * {n - 1} + x.dx{n}) / {n} END") for n in _PERIODS}), joined("directed", "base", ["dxm", "adx"]),
])
indicators("adx", [f"{x}_{n}" for n in _PERIODS for x in ("ADX", "DMP", "DMN")], indicator_sql({f"{x}_{n}": f"{c}{n}" for n in _PERIODS for x, c in (("ADX", "x"), ("DMP", "up"), ("DMN", "dn"))}, "directed", _ADX))


def supertrend_sql(name: str, source: str, n: int, factor: float) -> str:
    """SQL of a supertrend: source has rn, tr, mid, close, c1. State: e (range), line, up."""
    e = f"(s.e + 2.0 / {n + 1} * (x.tr - s.e))"
    floor = f"CASE WHEN s.line IS NULL OR x.c1 < s.line THEN x.mid - {factor} * {e} ELSE greatest(x.mid - {factor} * {e}, s.line) END"
    ceiling = f"CASE WHEN s.line IS NULL OR x.c1 > s.line THEN x.mid + {factor} * {e} ELSE least(x.mid + {factor} * {e}, s.line) END"
    up = f"CASE WHEN s.up = 1 THEN NOT x.close < {floor} ELSE x.close > {ceiling} END"
    return recursion(name, source, {"e": ("x.tr", e), "line": ("NULL", f"CASE WHEN {up} THEN {floor} ELSE {ceiling} END"), "up": ("0", f"({up})::INT")})


_SUPER = {f"{n}_{f}": (n, f) for n, f in ((10, 3), (14, 2), (7, 3), (10, 2), (14, 3), (20, 2))}
_CENTRED = f"centred AS (SELECT * REPLACE (coalesce({roll('sum', 'close * volume', 10)} / nullif({roll('sum', 'volume', 10)}, 0), close) AS close) FROM bars {windows(10)}), centre AS MATERIALIZED (SELECT *, (high + low) / 2 AS mid, row_number() OVER w - 1 AS rn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, lag(close) OVER w AS c1 FROM centred WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
_ST = ", ".join([level("held", "base", {"mid": "(high + low) / 2"}), *(supertrend_sql(f"st{k}", "held", *v) for k, v in _SUPER.items()), _CENTRED, supertrend_sql("pmax", "centre", 10, 3), "stall AS (SELECT b.symbol, b.ts, b.rn, " + ", ".join(f"st{k}.line AS line{k}, CASE WHEN b.rn = 0 THEN 0 WHEN st{k}.up = 1 THEN 1 ELSE -1 END AS way{k}" for k in _SUPER) + ", CASE WHEN b.rn = 0 THEN 0 WHEN pmax.up = 1 THEN 1 ELSE -1 END AS pway FROM base b " + " ".join(f"JOIN st{k} ON st{k}.symbol = b.symbol AND st{k}.rn = b.rn" for k in _SUPER) + " JOIN pmax ON pmax.symbol = b.symbol AND pmax.rn = b.rn)"])
indicators("supertrend", [*(f"SUPERT_{k}" for k in _SUPER), *(f"SUPERT_dir_{k}" for k in _SUPER), "SUPERT_dir", "PMAX_dir"], indicator_sql({f"SUPERT_{k}": f"line{k}" for k in _SUPER} | {f"SUPERT_dir_{k}": f"way{k}" for k in _SUPER} | {"SUPERT_dir": "way10_3", "PMAX_dir": "pway"}, "stall", _ST, nudge=NUDGE), nudge=NUDGE)

_V0 = "(s.v + s.pace * (CASE WHEN s.up = 1 THEN s.top ELSE s.bottom END - s.v))"
_TURN = f"(CASE WHEN s.up = 1 THEN x.low < {_V0} ELSE x.high > {_V0} END)"
_PSAR = recursion("psar", "base", {
    "v": ("x.close", f"CASE WHEN x.rn < 2 THEN x.close WHEN {_TURN} THEN CASE WHEN s.up = 1 THEN s.top ELSE s.bottom END WHEN s.up = 1 THEN least({_V0}, x.l1, x.l2) ELSE greatest({_V0}, x.h1, x.h2) END"),
    "up": ("1", f"CASE WHEN x.rn >= 2 AND {_TURN} THEN 1 - s.up ELSE s.up END"),
    "pace": ("0.02", f"CASE WHEN x.rn < 2 THEN s.pace WHEN {_TURN} THEN 0.02 WHEN s.up = 1 AND x.high > s.top OR s.up = 0 AND x.low < s.bottom THEN least(s.pace + 0.02, 0.2) ELSE s.pace END"),
    "top": ("x.high", f"CASE WHEN x.rn < 2 THEN s.top WHEN {_TURN} THEN CASE WHEN s.up = 1 THEN s.top ELSE x.high END WHEN s.up = 1 THEN greatest(s.top, x.high) ELSE s.top END"),
    "bottom": ("x.low", f"CASE WHEN x.rn < 2 THEN s.bottom WHEN {_TURN} THEN CASE WHEN s.up = 1 THEN x.low ELSE s.bottom END WHEN s.up = 0 THEN least(s.bottom, x.low) ELSE s.bottom END"),
})
_KAMA = ", ".join([level("moved", "base", {"path": "sum(abs(dc)) OVER r10", "far": "abs(close - lag(close, 10) OVER w)"}, (10,)), recursion("kama", "moved", {"k": ("NULL", "CASE WHEN x.rn < 9 THEN NULL WHEN x.rn = 9 THEN x.close ELSE s.k + pow((CASE WHEN x.path > 0 THEN x.far / x.path ELSE 0 END) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) * (x.close - s.k) END")})])
indicators("psar_kama", ["PSAR_up", "PSAR_down", "PSAR_dir", "KAMA"], indicator_sql({"PSAR_up": "CASE WHEN rn >= 2 AND up = 1 THEN v END", "PSAR_down": "CASE WHEN rn >= 2 AND up = 0 THEN v END", "PSAR_dir": "CASE WHEN close > v THEN 1 ELSE -1 END", "KAMA": "k"}, "ps", ", ".join([_PSAR, _KAMA, joined("ps", "base", ["psar", "kama"])]), nudge=NUDGE), nudge=NUDGE)


def chain(x: str, n: int, order: int, name: str) -> dict[str, tuple[str, str]]:
    """States of means of means of x."""
    out, new = {}, x
    for k in range(1, order + 1):
        new = f"(s.{name}{k} + 2.0 / {n + 1} * ({new} - s.{name}{k}))"
        out[f"{name}{k}"] = (x, new)
    return out


def t3_sql(name: str) -> str:
    return f"-0.343 * {name}6 + 3 * 0.49 * 1.7 * {name}5 - 3 * 0.7 * 2.89 * {name}4 + 4.913 * {name}3"


_ZL = {n: level(f"zl{n}", "base" if n == 20 else "zl20", {f"z{n}": f"2 * close - lag(close, {(n - 1) // 2}) OVER w"}, (2,)) for n in (20, 50)}
_MA = ", ".join([*_ZL.values(), recursion("means", "zl50", chain("x.close", 5, 6, "p") | chain("x.close", 10, 6, "q") | chain("x.close", 9, 3, "d") | chain("x.close", 21, 3, "g") | {"e20": mean_state("x.z20", "(2.0 / 21)", "e20"), "e50": mean_state("x.z50", "(2.0 / 51)", "e50")}), joined("ma", "base", ["means"])])
indicators("t3_zlema", ["T3_5", "T3_10", "ZLEMA_20", "ZLEMA_50", "DEMA_ext_9", "TEMA_ext_9", "DEMA_ext_21", "TEMA_ext_21"], indicator_sql({"T3_5": t3_sql("p"), "T3_10": t3_sql("q"), "ZLEMA_20": "e20", "ZLEMA_50": "e50", "DEMA_ext_9": "2 * d1 - d2", "TEMA_ext_9": "3 * d1 - 3 * d2 + d3", "DEMA_ext_21": "2 * g1 - g2", "TEMA_ext_21": "3 * g1 - 3 * g2 + g3"}, "ma", _MA))


def multiple_sql(n: int) -> str:
    a = f"(2.0/{n + 1})"
    return ", ".join([level("e1", "base", {"one": ema("close", a, n)}, (2,)), level("e2", "e1", {"two": ema("one", a, n)}, (2,)), level("e3", "e2", {"three": ema("two", a, n)}, (2,))])


for _n in (9, 21, 50):
    indicators(f"dema_tema_{_n}", [f"DEMA_{_n}", f"TEMA_{_n}"], indicator_sql({f"DEMA_{_n}": "2 * one - two", f"TEMA_{_n}": "3 * one - 3 * two + three"}, "e3", multiple_sql(_n)))


def wma_sql(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER r{n} = {n} THEN list_dot_product(list(coalesce({x}, 0)) OVER r{n}, [(2.0 * i / {n * (n + 1)})::DOUBLE FOR i IN range(1, {n + 1})]) END"


_HM = ", ".join([level("hm", "base", {f"m{n}": f"2 * ({wma_sql('close', h)}) - ({wma_sql('close', n)})" for n, h in ((9, 4), (20, 10), (50, 25))}, (4, 9, 10, 20, 25, 50)), level("hmt", "hm", {f"t{n}": roll("avg", "close", (n + 1) // 2) for n in (20, 50)}, (10, 25))])
indicators("hma_wma_trima", ["HMA_9", "HMA_20", "HMA_50", "TRIMA_20", "TRIMA_50", *(f"WMA_{n}" for n in (8, 13, 21, 50)), *(f"SMA_{n}" for n in (8, 13, 21, 100, 200)), "VWMA_20", "VWMA_50"], indicator_sql({"HMA_9": wma_sql("m9", 3), "HMA_20": wma_sql("m20", 4), "HMA_50": wma_sql("m50", 7), "TRIMA_20": roll("avg", "t20", 10), "TRIMA_50": roll("avg", "t50", 25)} | {f"WMA_{n}": wma_sql("close", n) for n in (8, 13, 21, 50)} | {f"SMA_{n}": roll("avg", "close", n) for n in (8, 13, 21, 100, 200)} | {f"VWMA_{n}": f"{roll('sum', 'close * volume', n)} / nullif({roll('sum', 'volume', n)}, 0)" for n in (20, 50)}, "hmt", _HM, (3, 4, 7, 8, 10, 13, 20, 21, 25, 50, 100, 200), nudge=NUDGE), nudge=NUDGE)

_WAY = "sign(coalesce(dc, 0))"
_CR = ", ".join([
    level("cr0", "base", {"way": _WAY, "up": "greatest(dc, 0) + 0 * dc", "down": "greatest(-dc, 0) + 0 * dc", "ret": "close / nullif(c1, 0) - 1", "lo10": roll("min", "low", 9), "hi10": roll("max", "high", 9)}, (9,)),
    recursion("crr", "cr0", {"run": ("1", "CASE WHEN x.way = (SELECT 0) + s.w THEN s.run + 1 ELSE 1 END"), "w": ("x.way", "x.way"), "t1": ("NULL", mean_state("x.dc", "(2.0/26)", "t1")[1]), "u1": ("NULL", mean_state("abs(x.dc)", "(2.0/26)", "u1")[1]), "f": ("x.close", "s.f + 2.0 / 24 * (x.close - s.f)"), "g": ("x.close", "s.g + 2.0 / 51 * (x.close - s.g)"), "kk": mean_state("((x.close - x.lo10) / nullif(x.hi10 - x.lo10, 0) * 100)", "(1.0/3)", "kk")}),
    joined("cr1", "cr0", ["crr"]), level("cr2", "cr1", {"streak": "run * way", "sd": "run * way - lag(run * way) OVER w", "macd": "f - g"}, (2,)),
    recursion("crs", "cr2", {"t2": ("NULL", mean_state("x.t1", "(2.0/14)", "t2")[1]), "u2": ("NULL", mean_state("x.u1", "(2.0/14)", "u2")[1]), "dd": mean_state("x.kk", "(1.0/3)", "dd")}), joined("cr3", "cr2", ["crs"]),
    level("cr4", "cr3", {"su": "greatest(sd, 0) + 0 * sd", "sdn": "greatest(-sd, 0) + 0 * sd", "s1": f"(macd - {roll('min', 'macd', 10)}) / nullif({roll('max', 'macd', 10)} - {roll('min', 'macd', 10)}, 0) * 100"}, (10,)),
    recursion("crt", "cr4", {"k1": mean_state("x.s1", "0.5", "k1")}), joined("cr5", "cr4", ["crt"]),
    level("cr6", "cr5", {"s2": f"(k1 - {roll('min', 'k1', 10)}) / nullif({roll('max', 'k1', 10)} - {roll('min', 'k1', 10)}, 0) * 100"}, (10,)),
    recursion("cru", "cr6", {"k2": mean_state("x.s2", "0.5", "k2")}), joined("cr7", "cr6", ["cru"]),
])
_PLAIN = lambda u, d, n: f"(100 - 100 / (1 + {roll('avg', u, n)} / nullif({roll('avg', d, n)}, 0)))"
_RANK = "CASE WHEN count(ret) OVER r100 = 100 THEN (len(list_filter(list(ret) OVER r100, lambda x: x < ret)) + (len(list_filter(list(ret) OVER r100, lambda x: x = ret)) + 1) / 2) / 100 * 100 END"
indicators("crsi", ["CRSI", "STC", "TSI_13_25", "KDJ_K", "KDJ_D", "KDJ_J"], indicator_sql({"CRSI": f"({_PLAIN('up', 'down', 3)} + {_PLAIN('su', 'sdn', 2)} + {_RANK}) / 3", "STC": "k2", "TSI_13_25": "100 * t2 / nullif(u2, 0)", "KDJ_K": "kk", "KDJ_D": "dd", "KDJ_J": "3 * kk - 2 * dd"}, "cr7", _CR, (2, 3, 100)))

_FORCE = "sign((high + low + close) - lag(high + low + close) OVER w)"
_NV = ", ".join([
    level("nv0", "base", {"way": _FORCE, "size": "high - low", "v1": "lag(volume) OVER w", "clv": "(2 * close - low - high) / nullif(high - low, 0) * volume"}, (2,)),
    level("nv1", "nv0", {"way1": "lag(way) OVER w", "size1": "lag(size) OVER w", "ad": "CASE WHEN clv IS NOT NULL THEN sum(clv) OVER w END"}, (2,)),
    recursion("nvr", "nv1", {"run": ("0", "x.size + CASE WHEN x.way = x.way1 THEN s.run ELSE x.size1 END"), "nvi": ("1000", "CASE WHEN x.volume < x.v1 THEN s.nvi * (x.close / nullif(x.c1, 0)) ELSE s.nvi END"), "pvi": ("1000", "CASE WHEN x.volume > x.v1 THEN s.pvi * (x.close / nullif(x.c1, 0)) ELSE s.pvi END")} | gap_state("x.ad", 0.5, "a3") | gap_state("x.ad", 2 / 11, "a10")),
    joined("nv2", "nv1", ["nvr"]), level("nv3", "nv2", {"force": "way * volume * abs(2 * size / nullif(run, 0) - 1)"}),
    recursion("nvs", "nv3", gap_state("x.force", 2 / 35, "k34") | gap_state("x.force", 2 / 56, "k55")), joined("nv4", "nv3", ["nvs"]),
])
indicators("nvi_pvi", ["KVO", "ADOSC"], indicator_sql({"KVO": "k34 - k55", "ADOSC": "a3 - a10"}, "nv4", _NV, places=4), places=4)


def in_logs(name: str, wanted: list[str], sql: dict[str, str], table: str, ctes: str, sizes: tuple[int, ...] = ()) -> None:
    """A query of indicators that products spread over orders of magnitude: sign(x) * log10(1 + |x|)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = with_indicators(hourly(spark, sf_dir), wanted)
        return e.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *(F.round(F.signum(c) * F.log10(1 + F.abs(F.col(c))), 6).alias(c) for c in wanted))

    run.__name__ = name
    query(indicator_sql({n: f"sign({x}) * log10(1 + abs({x}))" for n, x in sql.items()}, table, ctes, sizes))(run)


in_logs("nvi_pvi_logs", ["NVI", "PVI"], {"NVI": "nvi", "PVI": "pvi"}, "nv4", _NV)
_AD = ", ".join([
    level("ad0", "base", {"u": "greatest(dc, 0) + 0 * dc", "d": "greatest(-dc, 0) + 0 * dc"}), level("ad1", "ad0", {"pace": f"abs(({roll('sum', 'u', 14)} - {roll('sum', 'd', 14)}) / nullif({roll('sum', 'u', 14)} + {roll('sum', 'd', 14)}, 0)) * 2 / 13"}, (14,)),
    recursion("adr", "ad1", {"vid": ("x.close", "CASE WHEN x.pace IS NULL THEN x.close ELSE x.pace * x.close + (1 - x.pace) * s.vid END"), "hw": ("x.close", "0.9 * (0.8 * (s.hw + CASE WHEN x.rn = 1 THEN x.dc ELSE s.speed END) + 0.2 * x.close) + 0.1 * x.close"), "speed": ("0", "CASE WHEN x.rn = 1 THEN x.dc ELSE s.speed END + 0.1 * ((0.8 * (s.hw + CASE WHEN x.rn = 1 THEN x.dc ELSE s.speed END) + 0.2 * x.close) - s.hw - CASE WHEN x.rn = 1 THEN x.dc ELSE s.speed END)")}),
    joined("ad2", "ad1", ["adr"]),
])


def weights_sql(n: int, expression: str) -> str:
    """SQL of a weighted sum of the last n closes, weights by place i from the oldest, 0 on."""
    return f"CASE WHEN count(close) OVER r{n} = {n} THEN list_dot_product(list(close) OVER r{n}, [({expression})::DOUBLE FOR i IN range(0, {n})]) END"


_BELL = {n: f"exp(-pow(({n - 1} - i) - 0.85 * {n - 1}, 2) / (2 * pow({n} / 6.0, 2)))" for n in (9, 21)}
_BELLS = {n: sum(math.exp(-((i - 0.85 * (n - 1)) ** 2) / (2 * (n / 6.0) ** 2)) for i in range(n)) for n in (9, 21)}
_FIB = "[55, 34, 21, 13, 8, 5, 3, 2, 1, 1][i + 1] / 143.0"
_BINOMIAL = "[1, 9, 36, 84, 126, 126, 84, 36, 9, 1][i + 1] / 512.0"
indicators("adaptive_averages", ["VIDYA_14", "HWMA", "ALMA_9", "ALMA_21", "FWMA_10", "PWMA_10", "SWMA", "LIN_DECAY_5"], indicator_sql({"VIDYA_14": "vid", "HWMA": "hw", "ALMA_9": weights_sql(9, f"{_BELL[9]} / {_BELLS[9]!r}"), "ALMA_21": weights_sql(21, f"{_BELL[21]} / {_BELLS[21]!r}"), "FWMA_10": weights_sql(10, _FIB), "PWMA_10": weights_sql(10, _BINOMIAL), "SWMA": weights_sql(4, "[1, 2, 2, 1][i + 1] / 6.0"), "LIN_DECAY_5": "CASE WHEN count(close) OVER r5 = 5 THEN 0.4 * close END"}, "ad2", _AD, (4, 5, 9, 10, 21), nudge=NUDGE), nudge=NUDGE)
_PART = "(14 * pow(x.close / nullif(s.v, 0), 4))"
_NEXT = f"CASE WHEN {_PART} > 1e-300 THEN s.v + (x.close - s.v) / {_PART} WHEN {_PART} = 0 THEN s.v END"
in_logs("mcginley", ["MCGD_14"], {"MCGD_14": "v"}, "mg", ", ".join([recursion("mcg", "base", {"v": ("x.close", f"CASE WHEN abs({_NEXT}) < 1e150 THEN {_NEXT} ELSE x.close END")}), joined("mg", "base", ["mcg"])]))


def ready(x: str, rows: int) -> str:
    return f"CASE WHEN rn >= {rows} THEN {x} END"


_GMMA = (3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60)
_SPANS = sorted({*_GMMA, 6, 12, 13, 14, 20, 21, 26, 100, 200, 8})
_R1 = ", ".join([
    level("ra", "base", {"mid": "(high + low) / 2", "size": "high - low", "up": "greatest(dc, 0) + 0 * dc", "down": "greatest(-dc, 0) + 0 * dc", "obvs": "CASE WHEN close < c1 THEN -volume ELSE volume END", "fi": "dc * volume"}),
    level("rb", "ra", {"obv": "sum(obvs) OVER w"}, (2,)),
    recursion("rc", "rb", {f"e{n}": ("x.close", f"s.e{n} + {2 / (n + 1)!r} * (x.close - s.e{n})") for n in _SPANS} | {f"j{n}": ("x.mid", f"s.j{n} + {1 / n!r} * (x.mid - s.j{n})") for n in (13, 8, 5)} | {f"v{n}": ("x.volume", f"s.v{n} + {2 / (n + 1)!r} * (x.volume - s.v{n})") for n in (5, 10, 12, 26)}
              | {"t1": ("x.close", "s.t1 + 0.125 * (x.close - s.t1)"), "m1": ("x.size", "s.m1 + 0.2 * (x.size - s.m1)"), "o12": ("x.obv", f"s.o12 + {2 / 13!r} * (x.obv - s.o12)")} | {k: ("NULL", mean_state(x, a, k)[1]) for k, x, a in (("f13", "x.fi", "(2.0/14)"), ("u14", "x.up", "(1.0/14)"), ("d14", "x.down", "(1.0/14)"), ("u21", "x.up", "(1.0/21)"), ("d21", "x.down", "(1.0/21)"), ("s5", "x.dc", "(2.0/6)"), ("b5", "abs(x.dc)", "(2.0/6)"))}),
    joined("rd", "rb", ["rc"]),
    level("re", "rd", {"rsi": ready("CASE WHEN d14 = 0 THEN 100 ELSE 100 - 100 / (1 + u14 / d14) END", 14), "open_rsi": "100 - 100 / (1 + u14 / nullif(d14, 0))", "t1r": ready("t1", 14), "m1r": ready("m1", 8), "ppo": ready("(e12 - e26) / nullif(e26, 0) * 100", 25), "pvo": "(v12 - v26) / nullif(v26, 0) * 100"}),
    level("rf", "re", {"srk": f"(rsi - {roll('min', 'rsi', 14)}) / nullif({roll('max', 'rsi', 14)} - {roll('min', 'rsi', 14)}, 0)"}, (14,)), level("rg", "rf", {"k": roll("avg", "srk", 3)}, (3,)),
    recursion("rh", "rg", {k: ("NULL", mean_state(x, a, k)[1]) for k, x, a in (("t2", "x.t1r", "0.125"), ("m2", "x.m1r", "0.2"), ("ps", "x.ppo", "0.2"), ("s20", "x.s5", "(2.0/21)"), ("b20", "x.b5", "(2.0/21)"))} | {"pvs": ("x.pvo", "s.pvs + 0.2 * (x.pvo - s.pvs)")} | gap_state("x.open_rsi", 1 / 3, "qq") | gap_state("x.open_rsi", 0.25, "rsx")),
    joined("ri", "rg", ["rh"]), level("rj", "ri", {"t2r": ready("t2", 28), "mass": "m1r / nullif(CASE WHEN rn >= 16 THEN m2 END, 0)", "smi": "100 * s20 / nullif(b20, 0)", "qd": "abs(qq - lag(qq) OVER w)"}, (2,)),
    recursion("rk", "rj", {"t3": ("NULL", mean_state("x.t2r", "0.125", "t3")[1])} | gap_state("x.smi", 1 / 3, "sms") | gap_state("x.qd", 1 / 3, "qh")),
    joined("rl", "rj", ["rk"]), level("rm", "rl", {"t3r": ready("t3", 42)}), level("rn_", "rm", {"t0": "coalesce(lag(t3r) OVER w, avg(t3r) OVER (PARTITION BY symbol))"}, (2,)),
])
_RSUITE = {"EMA_13": ready("e13", 12), "EMA_21": ready("e21", 20), "EMA_100": ready("e100", 99), "PPO": "ppo", "PPO_signal": ready("ps", 33), "PPO_hist": ready("ppo - ps", 33), "RSI_21": ready("CASE WHEN d21 = 0 THEN 100 ELSE 100 - 100 / (1 + u21 / d21) END", 21), "STOCHRSI_D": roll("avg", "k", 3), "STOCHRSI_K_smooth": roll("avg", "k", 3), "TRIX_15": "(t3r - t0) / nullif(t0, 0) * 100", "MASS_INDEX": roll("sum", "mass", 25), "OBV_EMA_12": "o12", "FI_13": ready("f13", 13), "EMA50_slope": "(e50 - lag(e50, 5) OVER w) / nullif(lag(e50, 5) OVER w, 0) * 100", "ALLIGATOR_JAW": "j13", "ALLIGATOR_TEETH": "j8", "ALLIGATOR_LIPS": "j5", "ALLIGATOR_BULL": "(j5 > j8 AND j8 > j13)::INT", "ALLIGATOR_BEAR": "(j5 < j8 AND j8 < j13)::INT", **{f"GMMA_{'S' if n <= 15 else 'L'}{n}": f"e{n}" for n in _GMMA}, "GMMA_BULL": "(e3 > e60)::INT", **{f"BIAS_{n}": f"(close / nullif(e{n}, 0) - 1) * 100" for n in (6, 14, 26)}, "PVO": "pvo", "PVO_signal": "pvs", "BEAR_POWER_13": "low - e13", "QQE_LINE": "qq", "QQE_HIST": "4.236 * qh", "SMI": "smi", "SMI_signal": "sms", "RSX_14": "rsx", "VOL_OSC": "(v5 - v10) / nullif(v10, 0) * 100", "AMAT_fast": "(e8 > e21)::INT", "OBV_trend": "CASE WHEN obv > o12 THEN 1 ELSE -1 END", **{f"close_vs_EMA_{n}": ready(f"(close / nullif(e{n}, 0) - 1) * 100", n - 1) for n in (20, 50, 200)}}
indicators("recursive_suite", list(_RSUITE), indicator_sql(_RSUITE, "rn_", _R1, (3, 25), nudge=NUDGE), nudge=NUDGE)


def regression(x: str, n: int, what: str) -> str:
    return f"CASE WHEN count({x}) OVER r{n} = {n} THEN regr_{what}({x}, rn) OVER r{n} END"


def at_end(x: str, n: int) -> str:
    return f"({regression(x, n, 'intercept')} + {regression(x, n, 'slope')} * rn)"


def rank_share(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER r{n} = {n} THEN (len(list_filter(list({x}) OVER r{n}, lambda v: v < {x})) + (len(list_filter(list({x}) OVER r{n}, lambda v: v = {x})) + 1) / 2) / {n} END"


def finite_corr(x: str, y: str, n: int) -> str:
    return f"CASE WHEN count({x} + {y}) OVER r{n} = {n} AND stddev_pop({x}) OVER r{n} > 0 AND stddev_pop({y}) OVER r{n} > 0 THEN corr({x}, {y}) OVER r{n} END"


_ROCS = {n: f"(close / nullif(lag(close, {n}) OVER w, 0) - 1) * 100" for n in (5, 10, 11, 14, 15, 20, 30)}
_W1 = ", ".join([
    level("wa", "base", {"mid": "(high + low) / 2", "tp": "(high + low + close) / 3", "up": "greatest(dc, 0) + 0 * dc", "down": "greatest(-dc, 0) + 0 * dc", "lr": "ln(nullif(close, 0) / nullif(c1, 0))", "ret": "close / nullif(c1, 0) - 1", **{f"roc{n}": x for n, x in _ROCS.items()}, "bp": "close - least(low, c1)", "ut": "CASE WHEN c1 IS NOT NULL THEN greatest(high, c1) - least(low, c1) END", "obvs": "CASE WHEN close < c1 THEN -volume ELSE volume END", "co": "close - open", "hl": "high - low", "ho": "greatest(high - open, 0)", "ol": "greatest(open - low, 0)", "hc": "greatest(high - c1, 0) + 0 * c1", "cl": "greatest(c1 - low, 0) + 0 * c1", "rising": "coalesce(dc > 0, false)::INT", "accu": "high * (1 + 4 * (high - low) / nullif(high + low, 0))", "accl": "low * (1 - 4 * (high - low) / nullif(high + low, 0))", "dd": f"pow((close - {roll('max', 'close', 14)}) / nullif({roll('max', 'close', 14)}, 0) * 100, 2)", "k2": "lag(close, 2) OVER w"}, (2, 14)),
    level("wb", "wa", {"obv": "sum(obvs) OVER w", "retm": roll("avg", "ret", 5), "kst": f"{roll('avg', 'roc10', 10)} + 2 * {roll('avg', 'roc15', 10)} + 3 * {roll('avg', 'roc20', 10)} + 4 * {roll('avg', 'roc30', 15)}", "fish": f"greatest(-0.999, least(0.999, 2 * (mid - {roll('min', 'low', 9)}) / nullif({roll('max', 'high', 9)} - {roll('min', 'low', 9)}, 0) - 1)) + 0 * ({roll('max', 'high', 9)}) + 0 / nullif({roll('max', 'high', 9)} - {roll('min', 'low', 9)}, 0)", "inr": f"{roll('sum', 'up', 20)} / nullif({roll('sum', 'up', 20)} + {roll('sum', 'down', 20)}, 0)", "c3": "(close + c1 + k2) / 3", "rvg": f"{roll('avg', 'co', 4)} / nullif({roll('avg', 'hl', 4)}, 0)", "cop": "roc14 + roc11", "vr": f"volume / nullif({roll('avg', 'volume', 20)}, 0)", "vw": f"{roll('sum', 'tp * volume', 14)} / nullif({roll('sum', 'volume', 14)}, 0)", "m14": roll("avg", "close", 14), "s14": roll("stddev_pop", "close", 14), "m20": roll("avg", "close", 20), "s20": roll("stddev_pop", "close", 20), "kcu": roll("avg", "(4 * high - 2 * low + close) / 3", 20), "kcl": roll("avg", "(-2 * high + 4 * low + close) / 3", 20), "sh": roll("avg", "high", 13), "sl": roll("avg", "low", 21)}, (4, 5, 9, 10, 13, 14, 15, 20, 21)),
])
_WSUITE = {
    "DPO_20": f"lag(close, 11) OVER w - {roll('avg', 'close', 20)}", "KST": "kst", "KST_signal": roll("avg", "kst", 9), "ROC_5": "roc5", "ROC_14": "roc14", "ROC_30": "roc30", "AO": f"{roll('avg', 'mid', 5)} - {roll('avg', 'mid', 34)}",
    "UO": f"100 * (4 * ({roll('sum', 'bp', 7)} / nullif({roll('sum', 'ut', 7)}, 0)) + 2 * ({roll('sum', 'bp', 14)} / nullif({roll('sum', 'ut', 14)}, 0)) + {roll('sum', 'bp', 28)} / nullif({roll('sum', 'ut', 28)}, 0)) / 7", "CMO_14": f"({roll('sum', 'up', 14)} - {roll('sum', 'down', 14)}) / nullif({roll('sum', 'up', 14)} + {roll('sum', 'down', 14)}, 0) * 100", "FISHER": "last_value(0.5 * ln((1 + fish) / (1 - fish)) IGNORE NULLS) OVER w",
    "BB_upper_14": "m14 + 2 * s14", "BB_mid_14": "m14", "BB_lower_14": "m14 - 2 * s14", "BB_width_14": "4 * s14 / nullif(m14, 0) * 100", "BB_pct_14": "(close - m14 + 2 * s14) / nullif(4 * s14, 0)", "BB_SQUEEZE": "coalesce(m20 + 2 * s20 < kcu AND m20 - 2 * s20 > kcl, false)::INT", **{f"HV_{n}": f"{roll('stddev_samp', 'lr', n)} * sqrt(8760)" for n in (10, 20, 30, 60)},
    "DC_WIDTH": f"({roll('max', 'high', 20)} - {roll('min', 'low', 20)}) / nullif(close, 0) * 100", "KC_WIDTH": "(kcu - kcl) / nullif(close, 0) * 100", "volume_spike": "coalesce(vr > 2, false)::INT", "NET_VOL": "volume * sign(close - open)", "OBV_ZSCORE": f"(obv - {roll('avg', 'obv', 20)}) / nullif({roll('stddev_samp', 'obv', 20)}, 0)", "CLOSE_VS_VWAP": "(close / nullif(vw, 0) - 1) * 100",
    "candle_body": "abs(co)", "candle_range": "hl", "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low", "close_pct_change": "ret * 100", "body_pct": "abs(co) / nullif(hl, 0)", "upper_wick_pct": "(high - greatest(open, close)) / nullif(hl, 0)", "lower_wick_pct": "(least(open, close) - low) / nullif(hl, 0)",
    "TYPPRICE": "tp", "MEDPRICE": "mid", "WCLPRICE": "(high + low + 2 * close) / 4", "AVGPRICE": "(open + high + low + close) / 4", "TRANGE": "tr", "BOP": "co / nullif(hl, 0)", "FRACTAL_BEAR": "coalesce(high > h1 AND high > h2 AND high > lead(high) OVER w AND high > lead(high, 2) OVER w, false)::INT", "FRACTAL_BULL": "coalesce(low < l1 AND low < l2 AND low < lead(low) OVER w AND low < lead(low, 2) OVER w, false)::INT",
    "MOM_20": "close - lag(close, 20) OVER w", "ROCP_10": "roc10 / 100", "ROCR_10": "1 + roc10 / 100", "ROCR100_10": "100 + roc10", "MAX_14": roll("max", "close", 14), "MIN_14": roll("min", "close", 14), "SUM_14": roll("sum", "close", 14), "BETA_5": finite_corr("ret", "retm", 5),
    **{k: v for n in (10, 50) for k, v in {f"STDDEV_{n}": roll("stddev_samp", "close", n), f"VAR_{n}": roll("var_samp", "close", n), f"ZSCORE_{n}": f"(close - {roll('avg', 'close', n)}) / nullif({roll('stddev_samp', 'close', n)}, 0)", f"PCT_RANK_{n}": rank_share("close", n)}.items()}, "AUTOCORR_1": finite_corr("close", "c1", 20), "AUTOCORR_2": finite_corr("close", "k2", 20),
    "LINREG_INTERCEPT_14": f"{regression('close', 14, 'intercept')} + {regression('close', 14, 'slope')} * (rn - 13)", "LINREG_ANGLE_14": f"degrees(atan({regression('close', 14, 'slope')}))", "LINREG_SLOPE_5": regression("close", 5, "slope"), "CFO_9": f"(close - {at_end('close', 9)}) / nullif(close, 0) * 100", "RVGI_14": roll("avg", "rvg", 14),
    "CG_10": f"-({weights_sql(10, '10 - i')}) / nullif({roll('sum', 'close', 10)}, 0)", "UI_14": f"sqrt({roll('avg', 'dd', 14)})", "ACCB_UPPER": roll("avg", "accu", 20), "ACCB_MID": roll("avg", "close", 20), "ACCB_LOWER": roll("avg", "accl", 20), "PSL_12": f"{roll('avg', 'rising', 12)} * 100", "TREND_STR_14": f"{roll('avg', 'rising', 14)} * 100",
    "AR_14": f"{roll('sum', 'ho', 14)} / nullif({roll('sum', 'ol', 14)}, 0) * 100", "BR_14": f"{roll('sum', 'hc', 14)} / nullif({roll('sum', 'cl', 14)}, 0) * 100", "INERTIA_20": at_end("inr", 20), "TTM_TREND_6": f"CASE WHEN close > {roll('avg', 'c3', 6)} THEN 1 ELSE -1 END", "SQUEEZE_HIST": "close - (kcu + kcl) / 2", "COPPOCK": wma_sql("cop", 10), "QSTICK_8": roll("avg", "co", 8),
    "HILO_HIGH": "sh", "HILO_LOW": "sl", "HILO_dir": "coalesce(close > sh, false)::INT - coalesce(close < sl, false)::INT", "WMA_100": wma_sql("close", 100), "WMA_200": wma_sql("close", 200), "AROONOSC_25": "CASE WHEN count(high) OVER r26 = 26 THEN (list_position(list(high) OVER r26, max(high) OVER r26) - list_position(list(low) OVER r26, min(low) OVER r26)) * 4.0 END",
}
indicators("window_suite", list(_WSUITE), indicator_sql(_WSUITE, "wb", _W1, (4, 5, 6, 7, 8, 9, 10, 12, 14, 20, 26, 28, 30, 34, 50, 60, 100, 200), nudge=NUDGE), nudge=NUDGE)
indicators("ease_of_movement", ["EOM_14"], indicator_sql({"EOM_14": "(high - h1 + low - l1) * (high - low) / nullif(2 * volume, 0) * 100000000"}, "base", "one AS (SELECT 1)", places=0), places=0)




@query()
def all_indicators(spark, sf_dir):
    """Every indicator at once."""
    from .functions.indicators import names

    return with_indicators(hourly(spark, sf_dir), names())


_FOUR = "four AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(close, ts) AS close, max(high) AS high FROM bars GROUP BY 1, 2)"


@query(f"WITH {BARS}, {_FOUR} SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(b.close, 6) AS close, round(f.close, 6) AS h_close, round(f.high, 6) AS h_high FROM bars b ASOF LEFT JOIN four f ON b.symbol = f.symbol AND b.ts >= f.ts")
def asof_htf(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return shown(asof.asof(b, source.higher(b, "4h"), ["close", "high"], prefix="h_"), ["close", "h_close", "h_high"])


@query(ORACLES["asof_htf"])
def asof_htf_in_chunks(spark, sf_dir):
    """The same by stretches of two days."""
    b = hourly(spark, sf_dir)
    return shown(asof.asof(b, source.higher(b, "4h"), ["close", "high"], prefix="h_", span=172_800), ["close", "h_close", "h_high"])


@query()
def htf_injection(spark, sf_dir):
    b = hourly(spark, sf_dir)
    out = asof.inject_higher(b, source.higher(b, "4h"), "4h", completed_only=True)
    return shown(out, [c for c in out.columns if c.startswith("HTF_")])


_SIG = f"sig AS (SELECT *, (close > ({roll('avg', 'close', 20)}))::INT AS s, (close < ({roll('avg', 'close', 20)}))::INT AS x FROM bars {windows(20)})"


@query(f"WITH {BARS}, {_SIG}, fine AS (SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2) SELECT f.symbol, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(f.close, 6) AS close, coalesce(g.s, 0) AS entry_signal, coalesce(g.x, 0) AS exit_signal FROM fine f ASOF LEFT JOIN sig g ON f.symbol = g.symbol AND f.ts >= g.ts")
def asof_exec_signal(spark, sf_dir):
    signals = with_indicators(hourly(spark, sf_dir), ["SMA_20", "ATR_14"]).withColumns({"entry_signal": (F.col("close") > F.col("SMA_20")).cast("int"), "exit_signal": (F.col("close") < F.col("SMA_20")).cast("int")})
    return shown(asof.execution_signals(source.event_bars(spark, sf_dir, "15m"), signals), ["close", "entry_signal", "exit_signal"])


@query(f"WITH {BARS}, p AS (SELECT event_type AS symbol, event_id, ts FROM events), n AS (SELECT p.symbol, p.event_id, arg_min(b.ts, (abs(epoch_us(b.ts) - epoch_us(p.ts)), epoch_us(b.ts))) AS bar_ts, arg_min(b.close, (abs(epoch_us(b.ts) - epoch_us(p.ts)), epoch_us(b.ts))) AS close FROM p JOIN bars b USING (symbol) GROUP BY 1, 2) SELECT symbol, event_id, strftime(bar_ts, '%Y-%m-%d %H:%M:%S') AS bar_ts, round(close, 6) AS close FROM n")
def nearest_bar(spark, sf_dir):
    """The bar nearest to each event."""
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = asof.nearest(points, hourly(spark, sf_dir), ["close"])
    return out.select("symbol", "event_id", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss").alias("bar_ts"), F.round("close", 6).alias("close"))


@query(ORACLES["nearest_bar"])
def nearest_bar_in_chunks(spark, sf_dir):
    """The same by stretches of two days."""
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = asof.nearest(points, hourly(spark, sf_dir), ["close"], span=172_800)
    return out.select("symbol", "event_id", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss").alias("bar_ts"), F.round("close", 6).alias("close"))


_CTX = "c AS (SELECT symbol, ts, volume, max(volume) OVER (PARTITION BY symbol) AS mv, count(*) OVER k AS n_bars, sum(close) OVER k AS sum_close FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))"


@query(f"WITH {BARS}, {_CTX} SELECT symbol, {TS}, n_bars::INT AS n_bars, round(sum_close, 6) AS sum_close FROM c WHERE volume = mv")
def context_window(spark, sf_dir):
    """The bars around each series' busiest ones."""
    b = hourly(spark, sf_dir)
    busiest = b.groupBy("symbol").agg(F.max("volume").alias("volume"))
    found = asof.context(b.join(busiest, ["symbol", "volume"]).select("symbol", "ts"), b, ["close"])
    return shown(found.withColumns({"n_bars": F.size("context"), "sum_close": F.aggregate("context", F.lit(0.0), lambda s, x: s + x["close"])}), ["n_bars", "sum_close"])


#: CTEs of the indicators that rules name, under their own names.
_MAD20 = "CASE WHEN count(tp) OVER r20 = 20 THEN list_avg(list_transform(list(tp) OVER r20, lambda x: abs(x - avg(tp) OVER r20))) END"
FEATURES = ", ".join([
    level("fa", "base", {"tp": "(high + low + close) / 3", "up": "greatest(dc, 0) + 0 * dc", "down": "greatest(-dc, 0) + 0 * dc"}),
    recursion("fb", "fa", {f"e{n}": ("x.close", f"s.e{n} + 2.0 / {n + 1} * (x.close - s.e{n})") for n in (8, 12, 20, 26, 50, 200)} | {"u14": ("NULL", mean_state("x.up", "(1.0/14)", "u14")[1]), "d14": ("NULL", mean_state("x.down", "(1.0/14)", "d14")[1])}),
    joined("fc", "fa", ["fb"]),
    level("fd", "fc", {**{f'"EMA_{n}"': f"CASE WHEN rn >= {n - 1} THEN e{n} END" for n in (8, 20, 50, 200)}, '"MACD"': "CASE WHEN rn >= 25 THEN e12 - e26 END", '"RSI_14"': "CASE WHEN rn >= 14 THEN CASE WHEN d14 = 0 THEN 100 ELSE 100 - 100 / (1 + u14 / d14) END END", "tp1": "lag(tp) OVER w"}, (2,)),
    level("fe", "fd", {"mp": "CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END", "mn": "CASE WHEN tp < tp1 THEN tp * volume ELSE 0 END", "cv": "coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume", "srk": f'("RSI_14" - {roll("min", chr(34) + "RSI_14" + chr(34), 14)}) / nullif({roll("max", chr(34) + "RSI_14" + chr(34), 14)} - {roll("min", chr(34) + "RSI_14" + chr(34), 14)}, 0)'}, (14,)),
    recursion("ff", "fe", {"sig": ("NULL", mean_state('x."MACD"', "(2.0/10)", "sig")[1])}), joined("fg", "fe", ["ff"]),
    _ADX, level("held", "base", {"mid": "(high + low) / 2"}), supertrend_sql("st10_3", "held", 10, 3), _PSAR,
    level("fh", "fg", {
        '"MACD_signal"': "CASE WHEN rn >= 33 THEN sig END", '"MACD_hist"': 'CASE WHEN rn >= 33 THEN "MACD" - sig END', '"STOCHRSI_K"': roll("avg", "srk", 3), '"STOCH_K"': f"(close - {roll('min', 'low', 14)}) / nullif({_K}, 0) * 100", '"WILLR_14"': f"-100 * ({roll('max', 'high', 14)} - close) / nullif({_K}, 0)",
        '"CCI_20"': f"(tp - {roll('avg', 'tp', 20)}) / nullif(0.015 * ({_MAD20}), 0)", '"MFI_14"': f"100 - 100 / (1 + {roll('sum', 'mp', 14)} / nullif({roll('sum', 'mn', 14)}, 0))", '"CMF_20"': f"round({roll('sum', 'cv', 20)} / nullif({roll('sum', 'volume', 20)}, 0), 12)", '"volume_ratio"': f"volume / nullif({roll('avg', 'volume', 20)}, 0)",
        '"BB_lower_20"': f"{roll('avg', 'close', 20)} - 2 * {roll('stddev_pop', 'close', 20)}", '"BB_upper_20"': f"{roll('avg', 'close', 20)} + 2 * {roll('stddev_pop', 'close', 20)}", '"KC_lower"': roll("avg", "(-2 * high + 4 * low + close) / 3", 20),
        '"ICH_above_cloud"': "coalesce(close > (" + _M[9] + " + " + _M[26] + ") / 2 AND close > " + _M[52] + ", false)::INT", '"CDL_HAMMER"': "CASE WHEN close > open AND least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < .5 * abs(close - open) THEN 100 ELSE 0 END", '"CDL_INV_HAMMER"': "CASE WHEN close > open AND high - greatest(open, close) > 2 * abs(close - open) AND least(open, close) - low < .5 * abs(close - open) THEN 100 ELSE 0 END",
    }, (3, 9, 14, 20, 26, 52)),
    'features AS MATERIALIZED (SELECT h.*, d.x14 AS "ADX_14", CASE WHEN h.rn = 0 THEN 0 WHEN st10_3.up = 1 THEN 1 ELSE -1 END AS "SUPERT_dir", CASE WHEN h.close > psar.v THEN 1 ELSE -1 END AS "PSAR_dir" FROM fh h JOIN directed d USING (symbol, rn) JOIN st10_3 ON st10_3.symbol = h.symbol AND st10_3.rn = h.rn JOIN psar ON psar.symbol = h.symbol AND psar.rn = h.rn)',
])
FEATURE_NAMES = "close EMA_8 EMA_20 EMA_50 EMA_200 MACD MACD_signal MACD_hist RSI_14 STOCHRSI_K STOCH_K WILLR_14 CCI_20 MFI_14 CMF_20 volume_ratio BB_lower_20 BB_upper_20 KC_lower ICH_above_cloud CDL_HAMMER CDL_INV_HAMMER ADX_14 SUPERT_dir PSAR_dir".split()


def rule_sql(rule: tuple, missing: bool) -> str:
    """SQL of a rule over the features; unknown is false, a column that isn't there is `missing`."""
    if not rule:
        return "true"
    a, op, b = rule
    if a not in FEATURE_NAMES or isinstance(b, str) and b not in FEATURE_NAMES:
        return str(missing).lower()
    x, y = f'"{a}"', f'"{b}"' if isinstance(b, str) else str(b)
    x1, y1 = f"lag({x}) OVER w", f"lag({y}) OVER w" if isinstance(b, str) else y
    told = {"up": f"{x1} <= {y1} AND {x} > {y}", "down": f"{x1} >= {y1} AND {x} < {y}", "flip": f"{x} = {y} AND {x1} = -({y})", "any>": f"{x} > 0 OR {y} > 0", "==": f"{x} = {y}"}.get(op, f"{x} {op} {y}")
    return f"coalesce({told}, false)"


_FEATURED = indicator_sql({"x": "1"}, "features", FEATURES).partition(" SELECT symbol, strftime")[0]


def flag_query(name: str, columns: dict[str, tuple[tuple, bool]]) -> None:
    """A query of rules over the features, a 0/1 column each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = with_indicators(hourly(spark, sf_dir), [n for n in FEATURE_NAMES if n != "close"])
        return shown(e, [rules.condition(rule, e.columns, missing).cast("int").alias(n) for n, (rule, missing) in columns.items()])

    run.__name__ = name
    body = ", ".join(f"({rule_sql(rule, missing)})::INT AS {n}" for n, (rule, missing) in columns.items())
    query(f"{_FEATURED} SELECT symbol, {TS}, {body} FROM features WINDOW w AS (PARTITION BY symbol ORDER BY ts)")(run)


def turn_sql(x: str) -> str:
    return f"({x})::INT - coalesce(lag(({x})::INT) OVER w, ({x})::INT)"


_E2050, _E50200, _MX = ('coalesce("EMA_20" > "EMA_50", false)', 'coalesce("EMA_50" > "EMA_200", false)', 'coalesce("MACD" > "MACD_signal", false)')
_TURNS = ["ema_20_50_cross", "ema_50_200_cross", "ema_aligned_bull", "MACD_cross", "RSI_DIVERG"]
indicators("turns", _TURNS, f"{_FEATURED}, g AS (SELECT *, {roll('max', 'close', 14)} AS mc, {roll('max', chr(34) + 'RSI_14' + chr(34), 14)} AS mr FROM features {windows(14)}) SELECT symbol, {TS}, {turn_sql(_E2050)} AS ema_20_50_cross, {turn_sql(_E50200)} AS ema_50_200_cross, ({_E2050} AND {_E50200})::INT AS ema_aligned_bull, {turn_sql(_MX)} AS \"MACD_cross\", coalesce(close > lag(mc) OVER w AND \"RSI_14\" < lag(mr) OVER w, false)::INT AS \"RSI_DIVERG\" FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
flag_query("condition_flags", {f"c{i:02d}": (r, False) for i, r in enumerate(rules.CONDITIONS.values())})
flag_query("cross_flags", {f"x{i:02d}": ((a, "up", b), False) for i, (a, b) in enumerate(rules.CROSSES)})
flag_query("slot_options", {f"{s}_{o}": (r, rules.MISSING[s]) for s, options in rules.SLOTS.items() if s != "context" for o, r in options.items()})


def strategies_sql() -> str:
    """SQL of the default strategy, the template and one of slots."""
    slots = " AND ".join(rule_sql(rules.SLOTS[s][o], rules.MISSING[s]) for s, o in (("trend", "supertrend_bull"), ("setup", "adx_gt_20"), ("trigger", "macd_cross_signal")))
    cross = 'coalesce("EMA_20" > "EMA_50", false)'
    turned = f"({cross})::INT - coalesce(lag(({cross})::INT) OVER w, ({cross})::INT) = -1"
    return f"""{_FEATURED} SELECT symbol, {TS}, coalesce("EMA_20" > "EMA_50" AND "RSI_14" > 40 AND "RSI_14" < 70 AND "MACD_hist" > 0 AND "ADX_14" > 20, false)::INT AS default_in, (coalesce("RSI_14" > 75, false) OR {turned})::INT AS default_out,
      coalesce("RSI_14" < 35 AND close > "EMA_50" AND "MACD_hist" > 0 AND "ADX_14" > 20, false)::INT AS template_in, (coalesce("RSI_14" > 70, false) OR {turned})::INT AS template_out, ({slots})::INT AS slot_in, ({rule_sql(rules.SLOTS['exit']['stoch_gt_80'], False)})::INT AS slot_out,
      (coalesce("RSI_14" < 60, false) AND (coalesce(close > "EMA_20", false) OR coalesce("MACD_hist" > 0, false)) AND coalesce("ADX_14" >= 15, false))::INT AS threshold_in, (coalesce("RSI_14" > 65, false) OR {turned})::INT AS threshold_out FROM features WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""


@query(strategies_sql())
def strategy_signals(spark, sf_dir):
    """Signals of the default strategy, the template, a choice of slots, and an expression with thresholds."""
    e = with_indicators(hourly(spark, sf_dir), [n for n in FEATURE_NAMES if n != "close"] + ["ema_20_50_cross"])
    chosen = {"trend": "supertrend_bull", "setup": "adx_gt_20", "trigger": "macd_cross_signal", "context": "none", "exit": "stoch_gt_80"}
    made = {"default": rules.default_signals, "template": rules.template_signals, "slot": lambda d: rules.slot_signals(d, chosen), "threshold": lambda d: rules.threshold_signals(d, "RSI_14 < 60 and (close > EMA_20 or MACD_hist > 0)", [("ADX_14", ">=", 15)], 14, 65)}
    out = e
    for name, strategy in made.items():
        out = strategy(out).withColumnsRenamed({"entry_signal": f"{name}_in", "exit_signal": f"{name}_out"})
    return shown(out, [f"{n}_{w}" for n in made for w in ("in", "out")])


_BASE = f"f AS (SELECT *, {ema('close', '(2.0/21)', 20)} AS e20, {ema('close', '(2.0/51)', 50)} AS e50, {roll('avg', 'close', 20)} AS s20, {roll('stddev_pop', 'close', 20)} AS d20, volume / nullif({roll('avg', 'volume', 20)}, 0) AS vr FROM bars {windows(20)})"


@query(f"WITH {BARS}, {_BASE}, g AS (SELECT *, coalesce(lag(close) OVER w <= lag(e20) OVER w AND close > e20, false)::INT AS up, coalesce(lag(close) OVER w >= lag(e20) OVER w AND close < e20, false)::INT AS down FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, {TS}, up, down FROM g")
def cross_events(spark, sf_dir):
    from .functions.kernels import crossed_above, crossed_below

    e = with_indicators(hourly(spark, sf_dir), ["EMA_20"])
    return shown(e, [crossed_above("close", "EMA_20").cast("int").alias("up"), crossed_below("close", "EMA_20").cast("int").alias("down")])


@query(f"WITH {BARS}, {_BASE}, g AS (SELECT *, coalesce(e20 > e50, false) AS t, coalesce(vr > 1.5, false) AS s, coalesce(lag(close) OVER w <= lag(e50) OVER w AND close > e50, false) AS tr, coalesce(lag(e20) OVER w >= lag(e50) OVER w AND e20 < e50, false) AS x FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, {TS}, (t AND s AND tr)::INT AS entry_signal, x::INT AS exit_signal FROM g")
def slot_strategy_signals(spark, sf_dir):
    params = {"trend": "ema20_gt_ema50", "setup": "vol_spike", "trigger": "price_cross_ema50", "context": "none", "exit": "ema20_cross_below_ema50"}
    return shown(rules.slot_signals(with_indicators(hourly(spark, sf_dir), rules.needed(params)), params), ["entry_signal", "exit_signal"])


def signals_of(spark, sf_dir) -> DataFrame:
    """Entries when the close rises over its mean of 20 bars, exits when it falls below."""
    e = with_indicators(hourly(spark, sf_dir), ["SMA_20", "ATR_14", "RSI_14", "EMA_50", "volume_ratio", "ZSCORE_20", "MOM_10"])
    return e.withColumns({"entry_signal": rules.condition(("close", "up", "SMA_20"), e.columns, False).cast("int"), "exit_signal": rules.condition(("close", "down", "SMA_20"), e.columns, False).cast("int")})


_ENT = f"m AS (SELECT *, {roll('avg', 'close', 20)} AS s20, close - lag(close, 10) OVER w AS mom, volume / nullif({roll('avg', 'volume', 20)}, 0) AS vr, (close - {roll('avg', 'close', 20)}) / nullif({roll('stddev_samp', 'close', 20)}, 0) AS z FROM bars {windows(20)}), o AS (SELECT *, lead(close, 10) OVER w AS later, lag(close) OVER w <= lag(s20) OVER w AND close > s20 AS hit FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts)), p AS (SELECT *, (later * 0.999 / nullif(close * 1.001, 0) - 1) * 100 - 0.2 AS pnl FROM o WHERE hit AND later IS NOT NULL)"


def entries_of(spark, sf_dir) -> DataFrame:
    return asof.outcomes(signals_of(spark, sf_dir), hold=10, fee=0.001, slippage=0.001)


@query(f"WITH {BARS}, {_ENT} SELECT symbol, {TS}, round(close * 1.001, 6) AS entry_price, round(later * 0.999, 6) AS exit_price, round(pnl, 6) AS pnl_pct, coalesce(pnl > 0, false) AS is_winner FROM p")
def entry_outcomes(spark, sf_dir):
    return shown(entries_of(spark, sf_dir), ["entry_price", "exit_price", "pnl_pct", "is_winner"])


_EFF = "u AS (SELECT coalesce(pnl > 0, false) AS w, unnest([{'col': 'MOM_10', 'v': mom}, {'col': 'ZSCORE_20', 'v': z}, {'col': 'volume_ratio', 'v': vr}], recursive := true) FROM p), e AS (SELECT col, count(v) FILTER (WHERE w) AS n_winners, count(v) FILTER (WHERE NOT w) AS n_losers, avg(v) FILTER (WHERE w) AS wm, avg(v) FILTER (WHERE NOT w) AS lm, quantile_cont(v, 0.25) FILTER (WHERE w) AS p25, quantile_cont(v, 0.75) FILTER (WHERE w) AS p75, sqrt((var_samp(v) FILTER (WHERE w) + var_samp(v) FILTER (WHERE NOT w)) / 2) AS sd FROM u WHERE v IS NOT NULL GROUP BY col)"


@query(f"WITH {BARS}, {_ENT}, {_EFF} SELECT col, n_winners, n_losers, round(wm, 6) AS winner_mean, round(lm, 6) AS loser_mean, round(p25, 6) AS winner_p25, round(p75, 6) AS winner_p75, round((wm - lm) / sd, 6) AS cohens_d FROM e")
def cohens_d(spark, sf_dir):
    out = entries.effect_sizes(entries_of(spark, sf_dir), ["MOM_10", "ZSCORE_20", "volume_ratio"])
    return out.select("col", "n_winners", "n_losers", *(F.round(c, 6).alias(c) for c in ("winner_mean", "loser_mean", "winner_p25", "winner_p75", "cohens_d")))


@query(f"WITH {BARS}, {_ENT}, {_EFF}, g AS (SELECT *, (wm - lm) / sd AS d FROM e) SELECT col, CASE WHEN d > 0 THEN '>' ELSE '<' END AS operator, round(CASE WHEN d > 0 THEN p25 ELSE p75 END, 6) AS threshold, round(abs(d), 6) AS abs_d FROM g WHERE abs(d) >= 0.01 AND n_winners >= 5 AND n_losers >= 5 ORDER BY abs(d) DESC LIMIT 15")
def filter_suggestions(spark, sf_dir):
    out = entries.suggestions(entries.effect_sizes(entries_of(spark, sf_dir), ["MOM_10", "ZSCORE_20", "volume_ratio"]), least_effect=0.01)
    return out.select("col", "operator", F.round("threshold", 6).alias("threshold"), F.round("abs_d", 6).alias("abs_d"))


@query(f"""WITH {BARS}, {_ENT}, {_EFF}, g AS (SELECT *, (wm - lm) / sd AS d FROM e WHERE abs((wm - lm) / sd) >= 0.01 AND n_winners >= 5 AND n_losers >= 5),
r AS (SELECT col, CASE WHEN d > 0 THEN '>' ELSE '<' END AS operator, CASE WHEN d > 0 THEN least(p25, wm) * 0.5 ELSE greatest(p75, wm) * 1.5 * 0.3 END AS a, CASE WHEN d > 0 THEN greatest(p75, wm) * 1.5 ELSE greatest(p75, wm) * 1.5 * 1.5 END AS b FROM g)
SELECT col, operator, round(least(a, b), 6) AS low, round(CASE WHEN abs(a - b) < 1e-8 THEN least(a, b) + 1 ELSE greatest(a, b) END, 6) AS high FROM r""")
def threshold_ranges(spark, sf_dir):
    """Where a search looks for the thresholds of suggested filters."""
    effects = entries.effect_sizes(entries_of(spark, sf_dir), ["MOM_10", "ZSCORE_20", "volume_ratio"])
    out = entries.threshold_ranges(entries.suggestions(effects, least_effect=0.01), effects)
    return out.select("col", "operator", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query()
def threshold_search(spark, sf_dir):
    """Fifty trials of thresholds for what the entry analysis suggests, out of sample."""
    enriched = kept(with_indicators(hourly(spark, sf_dir), ["SMA_20", "MOM_10", "ZSCORE_20", "volume_ratio", "RSI_7", "RSI_14", "RSI_21", "ema_20_50_cross", "ATR_14"]))
    effects = entries.effect_sizes(entries_of(spark, sf_dir), ["MOM_10", "ZSCORE_20", "volume_ratio"])
    found = entries.threshold_ranges(entries.suggestions(effects, least_effect=0.01), effects).orderBy("col").limit(5)
    ranges = [(r.col, r.operator, r.low, r.high) for r in found.collect()]  # five at most
    return thresholds.evaluate(enriched, "close > SMA_20", ranges, thresholds.proposals(ranges, 50))


@query()
def importance_ranking(spark, sf_dir):
    """Indicators by effect size and by a forest's importance, together."""
    columns = ["MOM_10", "ZSCORE_20", "volume_ratio"]
    own = kept(entries_of(spark, sf_dir))
    return entries.combined_scores(entries.effect_sizes(own, columns), entries.forest_importances(own, columns))


TRADED = simulate.Risk(sl_pct=0.3, tp_pct=0.6, trail_mode="atr", trail_atr=3.0)
BY = ("symbol", "timeframe")


def trades_of(spark, sf_dir) -> DataFrame:
    return simulate.trades(signals_of(spark, sf_dir), TRADED)


#: SQL of the signals: crosses of the close over and under its mean of 20 bars; Wilder's range of 14 bars, 0 before it begins.
SIGNALS = f"""
m AS (SELECT *, {roll('avg', 'close', 20)} AS s20, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n,
      greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars {windows(20)}),
tr AS (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS tr14 FROM m),
wilder(symbol, rn, atr) AS (SELECT symbol, rn, tr14 FROM tr WHERE rn = 13 UNION ALL SELECT t.symbol, t.rn, w.atr + (t.tr - w.atr) / 14 FROM wilder w JOIN tr t ON t.symbol = w.symbol AND t.rn = w.rn + 1),
signals AS (SELECT t.symbol, t.ts, t.close, t.rn, t.n, coalesce(w.atr, 0) AS atr, coalesce(lag(close) OVER o <= lag(s20) OVER o AND close > s20, false) AS en, coalesce(lag(close) OVER o >= lag(s20) OVER o AND close < s20, false) AS ex
            FROM tr t LEFT JOIN wilder w USING (symbol, rn) WINDOW o AS (PARTITION BY t.symbol ORDER BY t.ts))"""


def simulated(name: str, source: str, risk: simulate.Risk, size: str = "0.1") -> str:
    """SQL of the fold, a row a bar: source has k (the series), ts, close, atr, en, ex. CTEs: {name}_bars, {name} (states), {name}_trades."""
    stop = {"none": "0.0", "fixed": f"paid0 * (1 - {risk.sl_pct})"}[risk.sl_mode]
    target = {"none": "0.0", "fixed": f"paid0 * (1 + {risk.tp_pct})"}[risk.tp_mode]
    trail = {"none": "0.0", "fixed": f"paid0 * {risk.trail_pct}", "atr": f"CASE WHEN atr > 0 THEN {risk.trail_atr} * atr ELSE paid0 * {risk.trail_pct} END"}[risk.trail_mode]
    kept = ", ".join(f"CASE WHEN s.open THEN s.{c} ELSE x.{c}0 END AS {c}" for c in ("start", "paid", "stop", "target", "trail", "cap_in"))
    return f"""
{name}_bars AS (SELECT k, ts, close, atr, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY k) AS n, lag(en) OVER o AS enter, lag(ex) OVER o AS leave FROM {source} WINDOW o AS (PARTITION BY k ORDER BY ts)),
{name}_in AS (SELECT *, i AS start0, {stop} AS stop0, {target} AS target0, {trail} AS trail0 FROM (SELECT *, close * (1 + {risk.slippage}) AS paid0 FROM {name}_bars)),
{name}(k, i, ts, open, start, paid, stop, target, trail, cap_in, peak, cap, got, reason) AS (
  SELECT k, i, ts, false, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, {risk.capital}::DOUBLE, 0.0::DOUBLE, '' FROM {name}_in WHERE i = 0
  UNION ALL
  SELECT k, i, ts, (was AND reason = '') OR (NOT was AND enter), start, paid, stop, target, trail, cap_in, peak,
         CASE WHEN reason <> '' THEN (cap0 + cap0 * {size} * (got / paid - 1)) * (1 - {size} * {risk.fee}) WHEN NOT was AND enter THEN cap_in ELSE cap0 END, got, reason
  FROM (SELECT *, CASE WHEN NOT was THEN '' WHEN stop > 0 AND close <= stop THEN 'stop_loss' WHEN target > 0 AND close >= target THEN 'take_profit' WHEN trail > 0 AND peak - close >= trail THEN 'trailing_stop' WHEN leave THEN 'exit_signal' WHEN i = n - 1 THEN 'end_of_data' ELSE '' END AS reason
        FROM (SELECT x.k, x.i, x.ts, x.n, x.close, x.enter, x.leave, s.open AS was, s.cap AS cap0, {kept}, CASE WHEN s.open THEN greatest(s.peak, x.close) ELSE x.paid0 END AS peak, x.close * (1 - {risk.slippage}) AS got
              FROM {name} s JOIN (SELECT *, NULL::DOUBLE AS cap_in00 FROM {name}_in) y ON y.k = s.k AND y.i = s.i + 1, LATERAL (SELECT y.*, s.cap * (1 - {size} * {risk.fee}) AS cap_in0) x))),
{name}_trades AS (SELECT s.k, s.start::INT AS entry_idx, s.i::INT AS exit_idx, b.ts AS entry_ts, s.ts AS exit_ts, s.paid AS entry_price, s.got AS exit_price, (s.got / s.paid - 1) * 100 AS pnl_pct, s.got > s.paid AS is_winner,
  (s.i - s.start)::INT AS duration_bars, s.reason AS exit_reason, {size} AS position_size, s.cap AS capital, s.cap_in AS capital_in, f.cap AS final_capital
  FROM {name} s JOIN {name}_bars b ON b.k = s.k AND b.i = s.start JOIN (SELECT k, arg_max(cap, i) AS cap FROM {name} GROUP BY k) f ON f.k = s.k WHERE s.reason <> '')"""


def measured(name: str, by: str = "k", size: str = "0.1") -> str:
    """SQL of the measures of a simulation's trades by series; series without trades have zeros."""
    r = f"pnl_pct / 100 * {size}"
    return f"""
{name}_some AS (SELECT {by}, count(*) AS total_trades, count(*) FILTER (WHERE pnl_pct > 0) AS winning_trades, avg((pnl_pct > 0)::INT) AS win_rate,
  sum(greatest(pnl_pct, 0)) / CASE WHEN count(*) FILTER (WHERE pnl_pct <= 0) = 0 THEN 1e-9 ELSE nullif(sum(greatest(-pnl_pct, 0)), 0) END AS profit_factor,
  avg((pnl_pct > 0)::INT) * coalesce(avg(pnl_pct) FILTER (WHERE pnl_pct > 0), 0) - (1 - avg((pnl_pct > 0)::INT)) * coalesce(avg(-pnl_pct) FILTER (WHERE pnl_pct <= 0), 0) AS expectancy, avg(duration_bars) AS avg_duration,
  (max(final_capital) / 10000 - 1) * 100 AS total_return, avg({r}) / (stddev_pop({r}) + 1e-9) * sqrt(252) AS sharpe, avg({r}) / (stddev_pop({r}) FILTER (WHERE pnl_pct < 0) + 1e-9) * sqrt(252) AS sortino FROM {name}_trades GROUP BY {by}),
{name}_measures AS (SELECT d.k, {', '.join(f'CASE WHEN s.total_trades IS NULL THEN 0 ELSE s.{c} END AS {c}' for c in simulate.MEASURES)} FROM (SELECT DISTINCT k FROM {name}_bars) d LEFT JOIN {name}_some s ON s.k = d.k)"""


def equity_sql(name: str) -> str:
    """SQL of the measures of a simulation's equity at every bar."""
    return f"""
{name}_eq AS (SELECT k, i, cap, max(cap) OVER o AS top, (cap - lag(cap) OVER o) / (lag(cap) OVER o + 1e-12) AS r FROM {name} WINDOW o AS (PARTITION BY k ORDER BY i)),
{name}_eqm AS (SELECT k, max((top - cap) / (top + 1e-12) * 100) AS dd, avg(r) / (stddev_pop(r) + 1e-9) * sqrt(252 * 24) AS sh, avg(r) / (coalesce(stddev_pop(r) FILTER (WHERE r < 0), 0) + 1e-9) * sqrt(252 * 24) AS so, (arg_max(cap, i) / 10000 - 1) * 100 AS ret FROM {name}_eq GROUP BY k),
{name}_equity AS (SELECT e.k, CASE WHEN t.k IS NULL THEN 0 ELSE dd END AS max_drawdown, CASE WHEN t.k IS NULL THEN 0 ELSE sh END AS bar_sharpe, CASE WHEN t.k IS NULL THEN 0 ELSE so END AS bar_sortino,
  CASE WHEN t.k IS NULL OR dd <= 0 THEN 0 ELSE ret / dd END AS calmar, CASE WHEN t.k IS NULL OR dd <= 0 THEN 0 ELSE abs(ret) / dd END AS recovery FROM {name}_eqm e LEFT JOIN (SELECT DISTINCT k FROM {name}_trades) t ON t.k = e.k)"""


BARS_R = BARS.replace("\nbars AS", "RECURSIVE bars AS", 1)


#: Measures that compounding spreads over many orders of magnitude: shown as log_x = sign(x) * log10(1 + |x|).
WIDE = {f"{p}{c}" for p in ("", "is_", "oos_", "holdout_", "benchmark_") for c in ("total_return", "return", "profit_factor")} | {"capital", "capital_in", "final_capital", "equity", "calmar", "recovery", "alpha"}


def rounded(columns: list[str] | tuple[str, ...], places: int = 4) -> str:
    return ", ".join(f"round(sign({c}) * log10(1 + abs({c})), 6) AS log_{c}" if c in WIDE else f"round({c}, {places}) AS {c}" for c in columns)


def rounding(df: DataFrame, keys: list[str], columns: list[str] | tuple[str, ...], places: int = 4) -> DataFrame:
    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.round(F.signum(x) * F.log10(1 + F.abs(x)), 6).alias(f"log_{c}") if c in WIDE else F.round(x, places).alias(c)

    return df.select(*keys, *map(one, columns))


_BYK = "(SELECT symbol AS k, * FROM signals)"
_T = simulated("sim", _BYK, TRADED)
_TRADE_DOUBLES = ["entry_price", "exit_price", "pnl_pct", "position_size", "capital", "capital_in", "final_capital"]


@query(f"WITH {BARS_R}, {SIGNALS}, {_T} SELECT k AS symbol, entry_idx, exit_idx, strftime(entry_ts, '%Y-%m-%d %H:%M:%S') AS entry_ts, strftime(exit_ts, '%Y-%m-%d %H:%M:%S') AS exit_ts, is_winner, duration_bars, exit_reason, {rounded(_TRADE_DOUBLES, 6)} FROM sim_trades")
def backtest_trades(spark, sf_dir):
    at = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("entry_ts", "exit_ts")]
    return rounding(trades_of(spark, sf_dir), ["symbol", "entry_idx", "exit_idx", *at, "is_winner", "duration_bars", "exit_reason"], _TRADE_DOUBLES, 6)


@query(ORACLES["backtest_trades"])
def backtest_trades_in_chunks(spark, sf_dir):
    """The same over chunks of series, whose open positions are handed on."""
    at = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("entry_ts", "exit_ts")]
    found = simulate.trades(signals_of(spark, sf_dir), TRADED, rows=100)
    return rounding(found, ["symbol", "entry_idx", "exit_idx", *at, "is_winner", "duration_bars", "exit_reason"], _TRADE_DOUBLES, 6)


_EQUITY = ("max_drawdown", "bar_sharpe", "bar_sortino", "calmar", "recovery")


@query(f"WITH {BARS_R}, {SIGNALS}, {_T}, {measured('sim')}, {equity_sql('sim')} SELECT k AS symbol, {rounded([*simulate.MEASURES, *_EQUITY])} FROM sim_measures JOIN sim_equity USING (k)")
def backtest_metrics(spark, sf_dir):
    signals = kept(signals_of(spark, sf_dir))
    found = kept(simulate.trades(signals, TRADED))
    out = simulate.metrics(found, BY, series=signals).join(simulate.equity_metrics(signals, found), list(BY))
    return rounding(out, ["symbol"], [*simulate.MEASURES, *_EQUITY])


@query(f"WITH {BARS_R}, {SIGNALS}, {_T} SELECT k AS symbol, {TS}, {rounded(['equity'])} FROM (SELECT *, cap AS equity FROM sim)")
def equity_curve(spark, sf_dir):
    """Equity at every bar."""
    signals = kept(signals_of(spark, sf_dir))
    return rounding(simulate.equity(signals, simulate.trades(signals, TRADED)), ["symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")], ["equity"])


@query(ORACLES["equity_curve"])
def equity_curve_in_chunks(spark, sf_dir):
    signals = kept(signals_of(spark, sf_dir))
    found = simulate.equity(signals, simulate.trades(signals, TRADED, rows=100), rows=100)
    return rounding(found, ["symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")], ["equity"])


def folds_sql(source: str, splits: int = 5, ratio: float = 0.7) -> str:
    """SQL of the walk-forward's parts of the signals: k is symbol, fold and part."""
    return f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS j, count(*) OVER (PARTITION BY symbol) AS c FROM {source}),
dealt AS (SELECT *, least(j // (c // {splits}), {splits - 1}) AS fold, c // {splits} AS len FROM placed),
parts AS (SELECT *, CASE WHEN fold = {splits - 1} THEN c - fold * len ELSE len END AS own, j - fold * len AS inner_j FROM dealt),
folds AS (SELECT symbol, ts, close, atr, en, ex, fold, CASE WHEN inner_j < floor(own * {ratio}) THEN 'is' ELSE 'oos' END AS part, symbol || '/' || fold || '/' || CASE WHEN inner_j < floor(own * {ratio}) THEN 'is' ELSE 'oos' END AS k FROM parts WHERE floor(own * {ratio}) >= 50 AND own - floor(own * {ratio}) >= 20)"""


@query(f"WITH {BARS_R}, {SIGNALS}, {folds_sql('signals')}, {simulated('wf', 'folds', simulate.Risk())}, {measured('wf')} SELECT split_part(k, '/', 1) AS symbol, split_part(k, '/', 2)::INT AS fold, split_part(k, '/', 3) AS part, {rounded(simulate.MEASURES)} FROM wf_measures")
def walk_forward(spark, sf_dir):
    by = (*BY, "fold", "part")
    parts = simulate.walk_forward(signals_of(spark, sf_dir))
    return rounding(simulate.metrics(simulate.trades(parts, simulate.Risk(), by), by, series=parts), ["symbol", "fold", "part"], simulate.MEASURES)


_HELD_BARS = BARS_R.replace("bars AS", "all_bars AS", 1) + ", bars AS (SELECT * EXCLUDE (j, c) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS j, count(*) OVER (PARTITION BY symbol) AS c FROM all_bars) WHERE j > c - greatest(20, floor(c * 0.2)))"


@query(f"WITH {_HELD_BARS}, {SIGNALS}, {simulated('sim', _BYK, simulate.Risk())}, {measured('sim')} SELECT k AS symbol, {rounded(simulate.MEASURES)} FROM sim_measures")
def holdout_eval(spark, sf_dir):
    own = with_indicators(simulate.holdout(hourly(spark, sf_dir)), ["SMA_20", "ATR_14"])
    signals = own.withColumns({"entry_signal": rules.condition(("close", "up", "SMA_20"), own.columns, False).cast("int"), "exit_signal": rules.condition(("close", "down", "SMA_20"), own.columns, False).cast("int")})
    return rounding(simulate.metrics(simulate.trades(signals, simulate.Risk()), BY, series=signals), ["symbol"], simulate.MEASURES)


_CUT = "cut AS (SELECT *, rn >= n - greatest(20, floor(n * 0.2)) AS held FROM signals)"
_MEANS = {"return": "total_return", "win_rate": "win_rate", "sharpe": "sharpe", "sortino": "sortino", "profit_factor": "profit_factor", "expectancy": "expectancy"}
_FOLDED = ", ".join(f"coalesce(avg({c}) FILTER (WHERE part = '{p}'), 0) AS {p}_{n}" for p in ("is", "oos") for n, c in _MEANS.items()) + ", " + ", ".join(f"coalesce(sum(total_trades) FILTER (WHERE part = '{p}'), 0) AS {p}_trades" for p in ("is", "oos"))
_SERIES = ["total_return", "total_trades", "win_rate", "profit_factor", "max_drawdown", "calmar", "is_return", "oos_return", "is_sharpe", "oos_sharpe", "is_trades", "oos_trades", "oos_expectancy", "holdout_return", "holdout_sharpe", "holdout_trades", "holdout_max_drawdown", "benchmark_return", "benchmark_sharpe"]
_FULL = f"""WITH {BARS_R}, {SIGNALS}, {_CUT}, {simulated('sim', '(SELECT symbol AS k, * FROM cut WHERE NOT held)', TRADED)}, {measured('sim')}, {equity_sql('sim')},
{folds_sql('(SELECT * FROM cut WHERE NOT held)')}, {simulated('wf', 'folds', TRADED)}, {measured('wf')}, wfs AS (SELECT split_part(k, '/', 1) AS k, {_FOLDED} FROM (SELECT *, split_part(k, '/', 3) AS part FROM wf_measures) GROUP BY 1),
{simulated('held', '(SELECT symbol AS k, * FROM cut WHERE held)', TRADED)}, {measured('held')}, {equity_sql('held')},
held_all AS (SELECT k, total_return AS holdout_return, bar_sharpe AS holdout_sharpe, total_trades AS holdout_trades, win_rate AS holdout_win_rate, max_drawdown AS holdout_max_drawdown, profit_factor AS holdout_profit_factor FROM held_measures JOIN held_equity USING (k)),
q AS (SELECT *, close / nullif(lag(close) OVER s, 0) - 1 AS r FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)), bench AS (SELECT symbol AS k, (arg_max(close, ts) / nullif(arg_min(close, ts), 0) - 1) * 100 AS benchmark_return, avg(r) / (stddev_pop(r) + 1e-9) * sqrt(252) AS benchmark_sharpe FROM q GROUP BY 1),
series AS (SELECT * FROM sim_measures JOIN sim_equity USING (k) LEFT JOIN wfs USING (k) LEFT JOIN held_all USING (k) LEFT JOIN bench USING (k))"""


@query(f"{_FULL} SELECT k AS symbol, {rounded(_SERIES)} FROM series")
def full_run_series(spark, sf_dir):
    """A whole backtest, a row a series: simulation, walk-forward, holdout, benchmark."""
    return rounding(simulate.full_run(signals_of(spark, sf_dir), TRADED)[0], ["symbol"], _SERIES)


_RUN_MEANS = ["is_return", "oos_return", "oos_win_rate", "is_sharpe", "is_sortino", "oos_profit_factor", "oos_expectancy", "holdout_return", "holdout_sharpe", "holdout_win_rate", "holdout_max_drawdown", "benchmark_return", "benchmark_sharpe"]
_RUN = ["series", "series_profitable", *_RUN_MEANS, "holdout_trades", "coverage", "alpha", "total_trades", "win_rate", "profit_factor", "expectancy", "avg_duration"]


@query(f"{_FULL}, one AS (SELECT count(*) AS series, count(*) FILTER (WHERE total_return > 0) AS series_profitable, {', '.join(f'coalesce(avg({c}), 0) AS {c}' for c in _RUN_MEANS)}, sum(holdout_trades) AS holdout_trades, count(*) FILTER (WHERE total_return > 0) / count(*) AS coverage, coalesce(avg(is_return), 0) - coalesce(avg(benchmark_return), 0) AS alpha FROM series), every_trades AS (SELECT 1 AS k, * EXCLUDE (k) FROM sim_trades), every_bars AS (SELECT 1 AS k), {measured('every')} SELECT {rounded(_RUN)} FROM one, (SELECT total_trades, win_rate, profit_factor, expectancy, avg_duration FROM every_measures)")
def full_run(spark, sf_dir):
    """The one row of a whole backtest."""
    return rounding(simulate.full_run(signals_of(spark, sf_dir), TRADED)[1], [], _RUN)


_RET = "q AS (SELECT *, close / nullif(lag(close) OVER s, 0) - 1 AS r, max(close) OVER s AS top FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts))"


@query(f"WITH {BARS}, {_RET} SELECT symbol, round((arg_max(close, ts) / nullif(arg_min(close, ts), 0) - 1) * 100, 4) AS benchmark_return, round(avg(r) / (stddev_pop(r) + 1e-9) * sqrt(252), 6) AS benchmark_sharpe, round(max((top - close) / (top + 1e-12)) * 100, 6) AS benchmark_max_drawdown FROM q GROUP BY symbol")
def benchmark(spark, sf_dir):
    out = stats.benchmark(hourly(spark, sf_dir))
    return out.select("symbol", F.round("benchmark_return", 4).alias("benchmark_return"), F.round("benchmark_sharpe", 6).alias("benchmark_sharpe"), F.round("benchmark_max_drawdown", 6).alias("benchmark_max_drawdown"))


def returns_of(spark, sf_dir) -> DataFrame:
    """Returns of the trades on capital."""
    return trades_of(spark, sf_dir).withColumn("r", F.col("pnl_pct") / 100 * F.col("position_size"))


_PORT = """
t AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY exit_idx) AS step, pnl_pct / 100 * position_size AS r FROM sim_trades),
curve AS (SELECT k, step, 1000.0 * list_reduce(list(1 + r) OVER o, lambda a, b: a * b) AS eq FROM t WINDOW o AS (PARTITION BY k ORDER BY step)),
grid AS (SELECT k, step FROM (SELECT DISTINCT k FROM t), (SELECT DISTINCT step FROM t)),
padded AS (SELECT g.k, g.step, last_value(c.eq IGNORE NULLS) OVER (PARTITION BY g.k ORDER BY g.step) AS eq, coalesce(t.r, 0) AS r FROM grid g LEFT JOIN curve c USING (k, step) LEFT JOIN t USING (k, step)),
total AS (SELECT step, sum(eq) AS eq FROM padded GROUP BY 1 UNION ALL SELECT 0, 1000.0 * count(DISTINCT k) FROM t),
top AS (SELECT *, max(eq) OVER (ORDER BY step) AS hi FROM total),
ranks AS (SELECT k, step, rank() OVER (PARTITION BY k ORDER BY r) + (count(*) OVER (PARTITION BY k, r) - 1) / 2 AS q FROM padded),
rho AS (SELECT a.k, b.k AS other, corr(a.q, b.q) AS rho FROM ranks a JOIN ranks b ON a.step = b.step AND a.k < b.k GROUP BY 1, 2)"""


@query(f"WITH {BARS_R}, {SIGNALS}, {_T}, {_PORT}, risk AS (SELECT avg(r) / (stddev_pop(r) + 1e-9) * sqrt(252) AS portfolio_sharpe, avg(r) / (coalesce(stddev_pop(r) FILTER (WHERE r < 0), 0) + 1e-9) * sqrt(252) AS portfolio_sortino, count(*) AS n_returns FROM t), ends AS (SELECT (arg_max(eq, step) / arg_min(eq, step) - 1) * 100 AS portfolio_return, max((hi - eq) / (hi + 1e-12)) * 100 AS portfolio_max_drawdown FROM top), r AS (SELECT avg(rho) AS avg_correlation, count(*) AS n_pairs FROM rho) SELECT round(portfolio_sharpe, 6) AS portfolio_sharpe, round(portfolio_sortino, 6) AS portfolio_sortino, n_returns, round(log10(1 + portfolio_return), 6) AS log_portfolio_return, round(portfolio_max_drawdown, 6) AS portfolio_max_drawdown, round(avg_correlation, 6) AS avg_correlation, n_pairs FROM risk, ends, r")
def portfolio_metrics(spark, sf_dir):
    found = kept(returns_of(spark, sf_dir))
    out = stats.portfolio(found, "symbol", n_pairs=10).join(F.broadcast(stats.mean_spearman(found, "symbol")))
    return out.select(*(F.round(c, 6).alias(c) for c in ("portfolio_sharpe", "portfolio_sortino", "portfolio_max_drawdown", "avg_correlation")), "n_returns", "n_pairs", F.round(F.log10(1 + F.col("portfolio_return")), 6).alias("log_portfolio_return"))


_PV = "WITH t AS (SELECT p_partkey AS id, (p_partkey * 7919 % 1000) / 1000.0 AS p_value FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p_value, id) AS k, count(*) OVER () AS n FROM t), a AS (SELECT *, least(1, min(p_value * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj, coalesce(max(CASE WHEN p_value <= k / n * 0.05 THEN k / n * 0.05 END) OVER (), 0) AS thr FROM r)"


@query(f"{_PV} SELECT id, k AS fdr_rank, round(adj, 9) AS adjusted_p, adj <= 0.05 AS is_significant, round(thr, 9) AS fdr_threshold FROM a")
def fdr(spark, sf_dir):
    tests = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919 % 1000) / 1000.0).alias("p_value"))
    out = stats.false_discovery(tests, order=("id",))
    return out.select("id", F.col("fdr_rank").cast("long").alias("fdr_rank"), F.round("adjusted_p", 9).alias("adjusted_p"), "is_significant", F.round("fdr_threshold", 9).alias("fdr_threshold"))


_ICB = f"x AS (SELECT *, ({roll('max', 'close', 14)} + {roll('min', 'close', 14)}) / 2 AS mid, close - lag(close, 10) OVER w AS mom, lead(close, 5) OVER w / nullif(close, 0) - 1 AS f5, lead(close, 10) OVER w / nullif(close, 0) - 1 AS f10 FROM bars {windows(14)}), l AS (SELECT symbol, ts, unnest([{{'col': 'MOM_10', 'v': mom}}, {{'col': 'MIDPOINT_14', 'v': mid}}], recursive := true), f5, f10 FROM x), y AS (SELECT symbol, ts, col, v, 5 AS horizon, f5 AS f FROM l UNION ALL SELECT symbol, ts, col, v, 10, f10 FROM l), k AS (SELECT *, rank() OVER (PARTITION BY symbol, col, horizon ORDER BY v) + (count(*) OVER (PARTITION BY symbol, col, horizon, v) - 1) / 2 AS rv, rank() OVER (PARTITION BY symbol, col, horizon ORDER BY f) + (count(*) OVER (PARTITION BY symbol, col, horizon, f) - 1) / 2 AS rf FROM y WHERE v IS NOT NULL AND f IS NOT NULL)"


@query(f"WITH {BARS}, {_ICB} SELECT symbol, col, horizon, count(*) AS n, round(corr(rv, rf), 6) AS ic FROM k GROUP BY symbol, col, horizon")
def ic_raw(spark, sf_dir):
    e = with_indicators(hourly(spark, sf_dir), ["MOM_10", "MIDPOINT_14"])
    out = ic.information(e, ["MOM_10", "MIDPOINT_14"], (5, 10))
    return out.select("symbol", "col", "horizon", "n", F.round("ic", 6).alias("ic"))


def ic_sql(source: str, columns: dict[str, str], horizons: tuple[int, ...], key: str = "symbol", name: str = "ic") -> str:
    """SQL of rank correlations with forward returns: CTE `name` has the key, col, horizon, n, ic. source has the key, ts, close."""
    long = " UNION ALL ".join(f"SELECT {key}, ts, '{c}' AS col, ({x})::DOUBLE AS v, {h} AS horizon, lead(close, {h}) OVER (PARTITION BY {key} ORDER BY ts) / nullif(close, 0) - 1 AS f FROM {source}" for c, x in columns.items() for h in horizons)
    part = f"PARTITION BY {key}, col, horizon"
    return f"{name}_rows AS (SELECT * FROM ({long}) WHERE v IS NOT NULL AND f IS NOT NULL), {name}_ranks AS (SELECT *, rank() OVER ({part} ORDER BY v) + (count(*) OVER ({part}, v) - 1) / 2 AS rv, rank() OVER ({part} ORDER BY f) + (count(*) OVER ({part}, f) - 1) / 2 AS rf FROM {name}_rows), {name} AS (SELECT {key}, col, horizon, count(*) AS n, CASE WHEN isfinite(corr(rv, rf)) THEN corr(rv, rf) END AS ic FROM {name}_ranks GROUP BY ALL)"


def named_strength(x: str) -> str:
    return f"CASE WHEN abs({x}) >= 0.2 THEN 'strong' WHEN abs({x}) >= 0.1 THEN 'moderate' WHEN abs({x}) >= 0.05 THEN 'weak' ELSE 'noise' END"


def way(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN 'bullish' ELSE 'bearish' END"


_RSI14 = f"CASE WHEN count(up) OVER w >= 14 THEN CASE WHEN ({ema('down', '(1.0/14)')}) = 0 THEN 100 ELSE 100 - 100 / (1 + ({ema('up', '(1.0/14)')}) / ({ema('down', '(1.0/14)')})) END END"
_IC3 = f"{STEPS}, vals AS (SELECT symbol, ts, close, close - lag(close, 10) OVER w AS mom, {_RSI14} AS rsi, (close - {roll('avg', 'close', 20)}) / nullif({roll('stddev_samp', 'close', 20)}, 0) AS z FROM first {windows(20)}), {ic_sql('vals', {'MOM_10': 'mom', 'RSI_14': 'rsi', 'ZSCORE_20': 'z'}, ic.HORIZONS)}"
_IC_SUM = "means AS (SELECT col, horizon, avg(ic) AS ic, count(ic) AS n_series FROM ic WHERE n >= 30 GROUP BY 1, 2), best AS (SELECT col, arg_max(horizon, (abs(ic), -horizon)) AS best_period, arg_max(ic, (abs(ic), -horizon)) AS best_ic, max(abs(ic)) AS max_abs_ic, max(n_series) AS n_series FROM means WHERE ic IS NOT NULL GROUP BY col)"
IC_COLUMNS = ["MOM_10", "RSI_14", "ZSCORE_20"]


def ic_of(spark, sf_dir) -> DataFrame:
    return ic.information(with_indicators(hourly(spark, sf_dir), IC_COLUMNS), IC_COLUMNS)


@query(f"WITH {BARS}, {_IC3}, {_IC_SUM} SELECT col, best_period, round(best_ic, 6) AS best_ic, round(max_abs_ic, 6) AS max_abs_ic, {way('best_ic')} AS direction, {named_strength('best_ic')} AS strength, n_series FROM best")
def ic_summary(spark, sf_dir):
    out = ic.summary(ic_of(spark, sf_dir).where("n >= 30"))
    return out.select("col", "best_period", F.round("best_ic", 6).alias("best_ic"), F.round("max_abs_ic", 6).alias("max_abs_ic"), "direction", "strength", "n_series")


@query()
def ic_significance(spark, sf_dir):
    """Coefficients of all horizons with their p-values."""
    return ic_of(spark, sf_dir).withColumn("p", ic.p_value(F.col("ic"), F.col("n")))


_ROLL = """
ten AS (SELECT *, row_number() OVER (PARTITION BY symbol, col ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol, col) AS c FROM ic_ranks WHERE horizon = 10),
rolled AS (SELECT a.symbol, a.col, a.i, any_value(a.c) AS c, count(*) AS k, corr(b.rv, b.rf) AS r FROM ten a JOIN ten b ON a.symbol = b.symbol AND a.col = b.col AND b.i <= a.i AND b.i > a.i - greatest(30, a.c // 5) WHERE a.i % greatest(1, a.c // 20) = 0 GROUP BY a.symbol, a.col, a.i),
stable AS (SELECT symbol, col, any_value(c) AS c, count(*) FILTER (WHERE ok) AS m, avg(r) FILTER (WHERE ok) AS mean, stddev_pop(r) FILTER (WHERE ok) AS sd, avg((r > 0)::INT) FILTER (WHERE ok) AS pos FROM (SELECT *, k >= greatest(20, greatest(30, c // 5) // 2) AND isfinite(r) AS ok FROM rolled) GROUP BY 1, 2)"""
_TOLD = "c >= 60 AND m >= 3"


@query(f"WITH {BARS}, {_IC3}, {_ROLL} SELECT symbol, col, CASE WHEN {_TOLD} THEN round(mean, 6) END AS ic_mean, CASE WHEN {_TOLD} THEN round(sd, 6) END AS ic_std, CASE WHEN {_TOLD} THEN CASE WHEN sd > 1e-6 THEN round(mean / sd, 6) ELSE 0 END END AS icir, CASE WHEN {_TOLD} THEN round(pos, 6) END AS positive_share FROM stable WHERE col <> 'RSI_14'")
def ic_stability(spark, sf_dir):
    out = ic.stability(with_indicators(hourly(spark, sf_dir), ["MOM_10", "ZSCORE_20"]), ["MOM_10", "ZSCORE_20"])
    return rounding(out, ["symbol", "col"], ["ic_mean", "ic_std", "icir", "positive_share"], 6)


CHOSEN = ["EMA20>EMA50", "close>EMA50", "RSI<35", "MACD_hist>0", "vol_ratio>1.5"]


def flags_of(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    need = [x for n in CHOSEN for x in rules.CONDITIONS[n][::2] if isinstance(x, str) and x != "close"]
    named = rules.named_conditions(with_indicators(hourly(spark, sf_dir), list(dict.fromkeys(need))), CHOSEN)
    safe = [f"cond{i}" for i in range(len(CHOSEN))]
    return named.withColumnsRenamed({f"C_{n}": s for n, s in zip(CHOSEN, safe, strict=True)}), safe


_FLAGS = f"{STEPS}, f0 AS (SELECT *, {ema('close', '(2.0/21)', 20)} AS e20, {ema('close', '(2.0/51)', 50)} AS e50, {_RSI14} AS rsi, volume / nullif({roll('avg', 'volume', 20)}, 0) AS vr, ({ema('close', '(2.0/13)', 12)}) - ({ema('close', '(2.0/27)', 26)}) AS line FROM first {windows(20)}), f1 AS (SELECT *, line - ({ema('line', '(2.0/10)', 9)}) AS hist FROM f0 {windows(20)}), flags AS (SELECT symbol, ts, close, coalesce(e20 > e50, false)::INT AS cond0, coalesce(close > e50, false)::INT AS cond1, coalesce(rsi < 35, false)::INT AS cond2, coalesce(hist > 0, false)::INT AS cond3, coalesce(vr > 1.5, false)::INT AS cond4 FROM f1)"
_CONDS = [f"cond{i}" for i in range(5)]
_PAIRS = [(a, b) for i, a in enumerate(_CONDS) for b in _CONDS[i + 1 :]]


def cond_sql(name: str, columns: dict[str, str], least: int = 30) -> str:
    """SQL of the mean coefficient of conditions over series, by name, of flags."""
    rates = " UNION ALL ".join(f"SELECT symbol, '{c}' AS col, avg({x}) AS hit FROM flags GROUP BY symbol" for c, x in columns.items())
    return f"{ic_sql('flags', columns, (10,), name=name)}, {name}_mean AS (SELECT col, avg(ic) AS ic, avg(hit) AS hit_rate, count(*) AS n_series FROM (SELECT * FROM {name} JOIN ({rates}) USING (symbol, col) WHERE n >= {least} AND ic IS NOT NULL AND hit BETWEEN 0.005 AND 0.99) GROUP BY col)"


@query(f"WITH {BARS}, {_FLAGS}, {cond_sql('one', {c: c for c in _CONDS})} SELECT col, round(ic, 6) AS ic, round(abs(ic), 6) AS abs_ic, round(hit_rate, 6) AS hit_rate, {way('ic')} AS direction, {named_strength('ic')} AS strength, n_series FROM one_mean")
def ic_condition(spark, sf_dir):
    df, names = flags_of(spark, sf_dir)
    out = ic.conditions(df, names)
    return out.select("col", *(F.round(c, 6).alias(c) for c in ("ic", "abs_ic", "hit_rate")), "direction", "strength", "n_series")


@query(f"WITH {BARS}, {_FLAGS}, {cond_sql('one', {c: c for c in _CONDS})}, {cond_sql('two', {f'{a}&{b}': f'{a} * {b}' for a, b in _PAIRS})} SELECT a.col AS label_a, b.col AS label_b, round(t.ic, 6) AS ic, round(t.hit_rate, 6) AS hit_rate, round(abs(t.ic) / nullif(greatest(abs(a.ic), abs(b.ic)), 0), 6) AS synergy, abs(t.ic) / nullif(greatest(abs(a.ic), abs(b.ic)), 0) > 1.05 AND abs(t.ic) > 0.03 AS synergistic FROM two_mean t JOIN one_mean a ON a.col = split_part(t.col, '&', 1) JOIN one_mean b ON b.col = split_part(t.col, '&', 2) WHERE t.n_series >= 2")
def ic_combo(spark, sf_dir):
    df, names = flags_of(spark, sf_dir)
    out = ic.combinations_of(df, names, ic.conditions(df, names))
    return out.select("label_a", "label_b", *(F.round(c, 6).alias(c) for c in ("ic", "hit_rate", "synergy")), "synergistic")


_SLOPE = f"s0 AS (SELECT t.*, {ema('close', '(2.0/51)')} AS e50, close - lag(close, 10) OVER w AS mom FROM tr t {windows(20)}), s1 AS (SELECT s.symbol, s.ts, s.close, s.mom, (e50 - lag(e50, 5) OVER o) / nullif(lag(e50, 5) OVER o, 0) * 100 AS slope, coalesce(w.atr, 0) / nullif(s.close, 0) * 100 AS natr FROM s0 s LEFT JOIN wilder w USING (symbol, rn) WINDOW o AS (PARTITION BY s.symbol ORDER BY s.ts))"
_REG = "ends AS (SELECT symbol, quantile_cont(natr, 0.75) AS hi, quantile_cont(natr, 0.25) AS lo FROM s1 GROUP BY 1), reg AS (SELECT symbol, ts, close, mom, unnest(list_filter([CASE WHEN slope > 0.05 THEN 'bull' END, CASE WHEN slope < -0.05 THEN 'bear' END, CASE WHEN abs(slope) <= 0.05 THEN 'ranging' END, CASE WHEN natr >= hi THEN 'high_vol' END, CASE WHEN natr <= lo THEN 'low_vol' END], lambda x: x IS NOT NULL)) AS regime FROM s1 JOIN ends USING (symbol)), split AS (SELECT symbol || '/' || regime AS k, * FROM (SELECT *, count(*) OVER (PARTITION BY symbol, regime) AS m FROM reg) WHERE m >= 50)"


@query(f"WITH {BARS_R}, {SIGNALS}, {_SLOPE}, {_REG}, {ic_sql('split', {'MOM_10': 'mom'}, (10,), 'k')} SELECT split_part(k, '/', 1) AS symbol, split_part(k, '/', 2) AS regime, col, n, CASE WHEN n >= 20 THEN round(ic, 6) END AS ic FROM ic")
def ic_regime(spark, sf_dir):
    out = ic.by_regime(with_indicators(hourly(spark, sf_dir), ["EMA50_slope", "NATR_14", "MOM_10"]), ["MOM_10"])
    return out.select("symbol", "regime", "col", "n", F.round("ic", 6).alias("ic"))


@query(f"WITH {BARS_R}, {SIGNALS}, {_SLOPE}, med AS (SELECT symbol, count(*) AS n, quantile_cont(slope, 0.5) AS slope, quantile_cont(natr, 0.5) AS natr FROM s1 GROUP BY 1) SELECT symbol, CASE WHEN n < 50 THEN 'all' WHEN natr > 4 THEN 'volatile' WHEN slope > 0.05 THEN 'bull' WHEN slope < -0.05 THEN 'bear' ELSE 'ranging' END AS regime, round(slope, 6) AS slope, round(natr, 6) AS natr FROM med")
def regime_label(spark, sf_dir):
    out = ic.regime_label(with_indicators(hourly(spark, sf_dir), ["EMA50_slope", "NATR_14"]))
    return out.select("symbol", "regime", F.round("slope", 6).alias("slope"), F.round("natr", 6).alias("natr"))


@query()
def monte_carlo(spark, sf_dir):
    return stats.monte_carlo(returns_of(spark, sf_dir), "symbol")


@query()
def bootstrap_ci(spark, sf_dir):
    return stats.bootstrap(returns_of(spark, sf_dir), "symbol")


@query()
def permutation(spark, sf_dir):
    return stats.permutation(returns_of(spark, sf_dir), "symbol", flip_signs=True)


SEARCHED = ["EMA_8", "EMA_20", "EMA_50", "EMA_200", "RSI_14", "MACD", "MACD_signal", "MACD_hist", "ATR_14", "volume_ratio", "SUPERT_dir", "PSAR_dir", "STOCH_K", "STOCHRSI_K", "CCI_20", "MFI_14", "WILLR_14", "ADX_14", "BB_lower_20", "ICH_above_cloud", "CDL_HAMMER", "CDL_INV_HAMMER"]


@query()
def search_scores(spark, sf_dir):
    """Scores of 100 trials."""
    enriched = with_indicators(hourly(spark, sf_dir), SEARCHED)
    return search.scores(search.evaluate(enriched, search.propose(100)), n_series=5, least_trades=1)


@query()
def search_execution(spark, sf_dir):
    """Trials whose hourly signals are traded on bars of 15 minutes."""
    enriched = with_indicators(hourly(spark, sf_dir), SEARCHED)
    return search.scores(search.evaluate(enriched, search.propose(20), fine=source.event_bars(spark, sf_dir, "15m")), n_series=5, least_trades=1)


@query()
def search_top(spark, sf_dir):
    """Batches of trials and the best strategies of them, tested."""
    enriched = with_indicators(hourly(spark, sf_dir), SEARCHED)
    tried, told = search.successive(enriched, batches=2, per_batch=20, n_series=5)
    return search.top_strategies(enriched, tried, told)


@query()
def search_study(spark, sf_dir):
    """A hundred trials in four batches that learn from each other, losing ones dropped by the median."""
    enriched = kept(with_indicators(hourly(spark, sf_dir), SEARCHED))
    found = study.Study(spark, f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/study-{uuid.uuid4().hex}", n_series=5, least_trades=1)
    return found.run(enriched, batches=4, per_batch=25)


@query()
def search_fronts(spark, sf_dir):
    """A hundred trials bred for mean Sharpe and mean return together."""
    enriched = kept(with_indicators(hourly(spark, sf_dir), SEARCHED))
    found = study.Study(spark, f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/study-{uuid.uuid4().hex}", both=True, n_series=5, least_trades=1)
    return found.run(enriched, batches=4, per_batch=25)


# one trial's rules in SQL, and its fold: trial numbers are those of the proposals
_TRIAL = {"trend": "price_gt_ema50", "setup": "none", "trigger": "macd_hist_cross_0", "context": "none", "exit": "stoch_gt_80", "sl_mode": "fixed", "sl_pct": 0.05, "tp_mode": "fixed", "tp_pct": 0.1, "trail_mode": "none"}
_TRIAL_SIGNALS = f"signals AS (SELECT symbol, ts, close, 0.0 AS atr, {' AND '.join(rule_sql(rules.SLOTS[x][_TRIAL[x]], rules.MISSING[x]) for x in ('trend', 'setup', 'trigger'))} AS en, {rule_sql(rules.SLOTS['exit']['stoch_gt_80'], False)} AS ex FROM features WINDOW w AS (PARTITION BY symbol ORDER BY ts))"


@query(f"{_FEATURED}, {_TRIAL_SIGNALS}, {folds_sql('signals', 3)}, {simulated('wf', 'folds', simulate.Risk.of(_TRIAL))}, {measured('wf')} SELECT t AS trial, split_part(k, '/', 1) AS symbol, split_part(k, '/', 2)::INT AS fold, {rounded(simulate.MEASURES)} FROM wf_measures, (SELECT unnest([0, 1]) AS t) WHERE k LIKE '%oos'")
def search_trials(spark, sf_dir):
    """Two equal trials in two lots, by part."""
    enriched = with_indicators(hourly(spark, sf_dir), ["EMA_50", "MACD_hist", "STOCH_K", "ATR_14"])
    out = search.evaluate(enriched, [_TRIAL | {"trial": 0}, _TRIAL | {"trial": 1}], lot=1)
    return rounding(out, ["trial", "symbol", "fold"], simulate.MEASURES)


_SC = "SELECT o_orderkey AS id, o_totalprice AS a, (o_orderkey * 7919 % 10007)::DOUBLE AS b FROM orders"


@query(f"WITH s AS ({_SC}) SELECT id, a, b FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.a >= s.a AND t.b >= s.b AND (t.a > s.a OR t.b > s.b))")
def pareto_front(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"), (F.col("o_orderkey") * 7919 % 10007).cast("double").alias("b"))
    return search.pareto(own, "a", "b")


def pairs_of(spark, sf_dir) -> DataFrame:
    """A universe made of customers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_name").alias("symbol"), F.col("c_mktsegment").alias("quote_asset"), F.lit(True).alias("active"), F.lit(False).alias("excluded"), F.col("c_acctbal").alias("volume_24h"), F.col("c_custkey").alias("candle_count"))


@query("WITH p AS (SELECT c_name AS symbol, c_acctbal AS v FROM customer), a AS (SELECT *, row_number() OVER (ORDER BY v DESC, symbol) AS k FROM p WHERE v >= 100), b AS (SELECT *, row_number() OVER (ORDER BY v DESC, symbol) AS j FROM a WHERE k <= 80), kept AS (SELECT symbol FROM b WHERE j > 5 AND j <= 45) SELECT p.symbol, kept.symbol IS NULL AS excluded FROM p LEFT JOIN kept ON p.symbol = kept.symbol")
def pairlist_pipeline(spark, sf_dir):
    filters = [{"method": "VolumePairList", "number_assets": 80, "min_value": 100}, {"method": "AgeFilter", "min_days_listed": 30}, {"method": "OffsetFilter", "offset": 5, "number_assets": 40}]
    return universe.with_exclusions(pairs_of(spark, sf_dir), filters).select("symbol", "excluded")


@query("WITH e AS (SELECT c_name AS symbol, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_name AS symbol, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(e.symbol, n.symbol) AS symbol, round(coalesce(n.v, e.v), 6) AS volume_24h FROM e FULL JOIN n ON e.symbol = n.symbol")
def upsert_pairs(spark, sf_dir):
    own = pairs_of(spark, sf_dir)
    new = own.where("candle_count % 2 = 0").withColumn("volume_24h", F.col("volume_24h") + 1)
    return universe.upsert(own.where("candle_count % 3 <> 0"), new, ["symbol"], ["active", "volume_24h"]).select("symbol", F.round("volume_24h", 6).alias("volume_24h"))


@query(f"WITH {BARS}, n AS (SELECT symbol, ts, close * 2 AS close FROM bars WHERE hour(ts) >= 12), e AS (SELECT symbol, ts, close FROM bars WHERE hour(ts) < 18), u AS (SELECT *, 0 AS src FROM e UNION ALL SELECT *, 1 FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY src) AS k FROM u) SELECT symbol, {TS}, round(close, 6) AS close FROM r WHERE k = 1")
def dedup_merge(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return shown(source.merge(b.where(F.hour("ts") < 18), b.where(F.hour("ts") >= 12).withColumn("close", F.col("close") * 2)), ["close"])


def winners_of(spark, sf_dir) -> DataFrame:
    return entries.snapshots(entries_of(spark, sf_dir).where("is_winner"), ["MOM_10", "ZSCORE_20", "volume_ratio"])


_SNAP = "u AS (SELECT unnest([{'indicator': 'MOM_10', 'v': mom}, {'indicator': 'ZSCORE_20', 'v': z}, {'indicator': 'volume_ratio', 'v': vr}], recursive := true) FROM p WHERE pnl > 0)"


@query(f"WITH {BARS}, {_ENT}, {_SNAP} SELECT indicator, round_even(avg(v), 4) AS mean, round_even(stddev_pop(v), 4) AS std, round_even(min(v), 4) AS min, round_even(max(v), 4) AS max, round_even(quantile_cont(v, 0.25), 4) AS p25, round_even(quantile_cont(v, 0.5), 4) AS p50, round_even(quantile_cont(v, 0.75), 4) AS p75, count(*) AS count FROM u WHERE v IS NOT NULL GROUP BY indicator HAVING count(*) >= 3")
def winner_snapshot_stats(spark, sf_dir):
    return entries.snapshot_stats(winners_of(spark, sf_dir))


_WON = f"""{_FEATURED}, won AS (SELECT f.* FROM (SELECT *, {roll('avg', 'close', 20)} AS s20, lead(close, 10) OVER w AS later, (close - "BB_lower_20") / nullif("BB_upper_20" - "BB_lower_20", 0) AS pct FROM features {windows(20)}) f
  JOIN (SELECT symbol, ts, lag(close) OVER w AS c0, lag(s) OVER w AS s0, s FROM (SELECT symbol, ts, close, {roll('avg', 'close', 20)} AS s FROM bars {windows(20)}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)) g USING (symbol, ts)
  WHERE g.c0 <= g.s0 AND f.close > g.s AND later IS NOT NULL AND (later * 0.999 / nullif(close * 1.001, 0) - 1) * 100 - 0.2 > 0)"""
_FREQ = {"RSI < 30": 'coalesce("RSI_14", 50) < 30', "RSI 30-50": 'coalesce("RSI_14", 50) >= 30 AND coalesce("RSI_14", 50) < 50', "RSI 50-70": 'coalesce("RSI_14", 50) >= 50 AND coalesce("RSI_14", 50) < 70', "ADX > 25": '"ADX_14" > 25', "MACD hist > 0": '"MACD_hist" > 0', "BB% < 0.2": "coalesce(pct, 0.5) < 0.2", "Volume > 1.5x": '"volume_ratio" > 1.5', "Price > EMA50": "false"}


@query(f"{_WON}, t AS (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {x}) AS n{i}" for i, x in enumerate(_FREQ.values())) + " FROM won) " + " UNION ALL ".join(f"SELECT '{n}' AS condition, n{i} AS n, round(n{i} / total, 6) AS frequency FROM t" for i, n in enumerate(_FREQ)))
def condition_frequency(spark, sf_dir):
    """How often each condition held when a winner was entered."""
    columns = [c for c in dict.fromkeys(c for c, _ in entries.WINNER_CONDITIONS.values()) if c != "EMA_50"]
    e = with_indicators(hourly(spark, sf_dir), ["SMA_20", "EMA_50", *columns])
    own = e.withColumns({"entry_signal": rules.condition(("close", "up", "SMA_20"), e.columns, False).cast("int")})
    winners = asof.outcomes(own, hold=10, fee=0.001, slippage=0.001).where("is_winner")
    return entries.condition_frequency(entries.snapshots(winners, columns)).select("condition", "n", F.round("frequency", 6).alias("frequency"))


@query(f"WITH {BARS}, {_ENT} SELECT a, b, round_even(c, 3) AS correlation FROM (SELECT unnest([{{'a': 'MOM_10', 'b': 'ZSCORE_20', 'c': corr(mom, z)}}, {{'a': 'ZSCORE_20', 'b': 'MOM_10', 'c': corr(mom, z)}}, {{'a': 'MOM_10', 'b': 'MOM_10', 'c': 1.0}}, {{'a': 'ZSCORE_20', 'b': 'ZSCORE_20', 'c': 1.0}}], recursive := true) FROM p)")
def corr_matrix(spark, sf_dir):
    return entries.correlation_matrix(entries_of(spark, sf_dir), ["MOM_10", "ZSCORE_20"])


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name) AS k FROM customer) SELECT c_mktsegment AS quote_asset, c_name AS symbol, c_acctbal AS volume_24h FROM r WHERE k <= 5")
def top_k_reports(spark, sf_dir):
    return universe.top(pairs_of(spark, sf_dir), 5, [F.desc("volume_24h"), F.asc("symbol")], ["quote_asset"]).select("quote_asset", "symbol", "volume_24h")


@query("WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50 AS w FROM orders) SELECT least(floor((o_totalprice - lo) / w), 49)::INT AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def pnl_histogram(spark, sf_dir):
    return stats.histogram(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", 50).select("bin", "n")


@query()
def rf_importance(spark, sf_dir):
    return entries.forest_importances(entries_of(spark, sf_dir), ["MOM_10", "ZSCORE_20", "volume_ratio", "RSI_14"])


@query(f"WITH {BARS} SELECT symbol, count(*) AS candle_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS data_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS data_end FROM bars GROUP BY symbol")
def data_extent(spark, sf_dir):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return source.extent(hourly(spark, sf_dir)).select("symbol", "candle_count", at("data_start"), at("data_end"))


@query(f"{_FEATURED}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM features) SELECT symbol, {TS}, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, round(\"EMA_20\", 6) AS \"EMA_20\", round(\"RSI_14\", 6) AS \"RSI_14\", CASE WHEN \"CDL_HAMMER\" > 0 THEN round(low * 0.9985 + {NUDGE}, 6) END AS \"CDL_HAMMER_marker\" FROM r WHERE k <= 500")
def chart_tail(spark, sf_dir):
    """What a chart shows: the last 500 bars of each series, overlays and a pattern's markers."""
    e = with_indicators(hourly(spark, sf_dir), ["EMA_20", "RSI_14", "CDL_HAMMER"])
    out = universe.chart(e, ["EMA_20", "RSI_14"], ["CDL_HAMMER"])
    return shown(out, ["open", "high", "low", "close", "volume", "EMA_20", "RSI_14", F.round(F.col("CDL_HAMMER_marker") + NUDGE, 6).alias("CDL_HAMMER_marker")])


INJECTED = ["RSI_14", "EMA_20", "EMA_50", "EMA_200", "MACD_hist", "MACD", "ADX_14", "STOCH_K", "SUPERT_dir", "CCI_20", "MFI_14", "volume_ratio"]
_FOUR_BARS = "bars AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM hours GROUP BY 1, 2)"
_ON_FOUR = _FEATURED.replace("RECURSIVE bars AS (", "RECURSIVE hours AS (", 1).replace("GROUP BY 1, 2), base AS", f"GROUP BY 1, 2), {_FOUR_BARS}, base AS", 1)


@query(f"{_ON_FOUR}, told AS (SELECT symbol, ts + INTERVAL 4 HOUR AS ts, 0 AS side, {', '.join(chr(34) + c + chr(34) for c in INJECTED)}, CASE WHEN close >= \"EMA_50\" THEN 1 ELSE -1 END AS trend_dir FROM features UNION ALL SELECT symbol, ts, 1, {', '.join('NULL' for _ in INJECTED)}, NULL FROM hours), filled AS (SELECT symbol, ts, side, {', '.join(f'last_value({chr(34)}{c}{chr(34)} IGNORE NULLS) OVER o AS {chr(34)}{c}{chr(34)}' for c in [*INJECTED, 'trend_dir'])} FROM told WINDOW o AS (PARTITION BY symbol ORDER BY ts, side ROWS UNBOUNDED PRECEDING)) SELECT symbol, {TS}, {', '.join(f'round({chr(34)}{c}{chr(34)}, 6) AS {chr(34)}HTF_4h_{c}{chr(34)}' for c in [*INJECTED, 'trend_dir'])} FROM filled WHERE side = 1")
def htf_columns(spark, sf_dir):
    """Columns of completed bars of four hours, carried forward to the hourly ones."""
    b = hourly(spark, sf_dir)
    out = asof.inject_higher(b, source.higher(b, "4h"), "4h", INJECTED, completed_only=True)
    return shown(out, [f"HTF_4h_{c}" for c in [*INJECTED, "trend_dir"]])


#: Column or cross, kind, and its condition in SQL at the middle of its range, each written out.
CATALOGUED: dict[str, tuple[str, str]] = {
    "EMA_20": ("ma", 'close > "EMA_20"'), "EMA_200": ("ma", 'close > "EMA_200"'), "RSI_14": ("osc", '"RSI_14" < 35'), "STOCH_K": ("osc", '"STOCH_K" < 25'), "WILLR_14": ("osc", '"WILLR_14" < -50'), "CCI_20": ("osc", '"CCI_20" < -100'),
    "MFI_14": ("osc", '"MFI_14" < 35'), "CMF_20": ("sign", '"CMF_20" > 0'), "MACD_hist": ("sign", '"MACD_hist" > 0'), "ADX_14": ("gt", '"ADX_14" > 25'), "volume_ratio": ("gt", '"volume_ratio" > 1.5'), "BB_lower_20": ("band_lower", 'close < "BB_lower_20"'),
    "KC_lower": ("band_lower", 'close < "KC_lower"'), "PSAR_dir": ("flag", '"PSAR_dir" = 1'), "SUPERT_dir": ("flag", '"SUPERT_dir" = 1'), "CDL_HAMMER": ("cdl", '"CDL_HAMMER" > 0'),
    "X_ema20_x_ema50": ("cross", 'p_ema20 <= p_ema50 AND "EMA_20" > "EMA_50"'), "X_close_x_ema200": ("cross", 'p_close <= p_ema200 AND close > "EMA_200"'), "X_rsi14_x_30": ("cross", 'p_rsi <= 30 AND "RSI_14" > 30'), "X_stochk_x_20": ("cross", 'p_stoch <= 20 AND "STOCH_K" > 20'),
    "X_cci_x_m100": ("cross", 'p_cci <= -100 AND "CCI_20" > -100'), "X_willr_x_m50": ("cross", 'p_willr <= -50 AND "WILLR_14" > -50'), "X_macd_hist_x_0": ("cross", 'p_hist <= 0 AND "MACD_hist" > 0'), "X_close_x_htf_ema50": ("cross", "false"),
}
_BEFORE = {"p_ema20": "EMA_20", "p_ema50": "EMA_50", "p_ema200": "EMA_200", "p_close": "close", "p_rsi": "RSI_14", "p_stoch": "STOCH_K", "p_cci": "CCI_20", "p_willr": "WILLR_14", "p_hist": "MACD_hist"}
_LAGS = ", ".join(f'lag("{c}") OVER w AS {p}' for p, c in _BEFORE.items())
HITS_SQL = f"{_FEATURED}, told AS (SELECT *, {_LAGS} FROM features WINDOW w AS (PARTITION BY symbol ORDER BY ts)) " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", '{k}' AS kind, count(*) AS n, count(*) FILTER (WHERE {x}) AS hits FROM told" for n, (k, x) in CATALOGUED.items())


@query(HITS_SQL)
def catalog_hits(spark, sf_dir):
    """How often the condition holds that the catalog gives each column, and how often lines cross."""
    e = with_indicators(hourly(spark, sf_dir), [*(n for n in CATALOGUED if not n.startswith("X_")), "EMA_50"])
    found = catalog.of_schema(e.schema)
    return catalog.hits(e, [found[n] for n in CATALOGUED])


@query(f"{_FEATURED} SELECT symbol, {TS}, ({rule_sql(('EMA_20', '>', 'EMA_50'), True)} AND {rule_sql(('RSI_14', 'up', 50), False)})::INT AS a_entry, ({rule_sql(('RSI_14', '>', 75), False)})::INT AS a_exit, coalesce(close > \"EMA_50\" AND \"MACD_hist\" > 0, false)::INT AS b_entry, coalesce(close < \"EMA_20\", false)::INT AS b_exit, coalesce(\"WILLR_14\" < -90, false)::INT AS c_entry, coalesce(\"WILLR_14\" > -10, false)::INT AS c_exit FROM features WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def strategies_together(spark, sf_dir):
    """Three strategies of different make over one table."""
    made = [
        strategy.of_slots({"trend": "ema20_gt_ema50", "trigger": "rsi_cross_50", "exit": "rsi_gt_75"}, "a"),
        strategy.of_expressions("close > EMA_50 and MACD_hist > 0", "close < EMA_20", ["EMA_20", "EMA_50", "MACD_hist"], "b"),
        strategy.FromFunctions("c", lambda _: F.col("WILLR_14") < -90, lambda _: F.col("WILLR_14") > -10, ("WILLR_14",)),
    ]
    return shown(strategy.run_all(hourly(spark, sf_dir), made), [f"{s.name}_{w}" for s in made for w in ("entry", "exit")])


@query("""WITH c AS (SELECT l_returnflag, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), d AS (SELECT l_returnflag, m, l_extendedprice - m AS d FROM lineitem JOIN c USING (l_returnflag))
SELECT l_returnflag, count(*) AS n, round(any_value(m), 4) AS mean, round(sum(d * d) / (count(*) - 1), 2) AS variance, round(sqrt(count(*)) * sum(d ** 3) / sum(d * d) ** 1.5, 6) AS skewness, round(count(*) * sum(d ** 4) / sum(d * d) ** 2 - 3, 6) AS kurtosis FROM d GROUP BY 1""")
def merged_moments(spark, sf_dir):
    """Moments by a user-defined aggregate whose states are merged."""
    found = aggregates.aggregate(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag"], ["l_extendedprice"], aggregates.Moments("l_extendedprice"))
    return found.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


@query("SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def refined_quantiles(spark, sf_dir):
    """Exact quantiles by counting, without a group's values in one place."""
    found = quantiles.exact_quantiles(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return found.select("l_returnflag", "n", *(F.round(F.col("quantiles")[i], 4).alias(c) for i, c in enumerate(("p05", "p50", "p95"))))


@query("SELECT event_type, (props::JSON->>'k')::BIGINT % 10 AS digit, count(*) AS n, sum((props::JSON->>'k')::BIGINT) AS total, count(*) FILTER (WHERE (props::JSON->>'absent') IS NULL) AS absent FROM events GROUP BY 1, 2")
def json_decode(spark, sf_dir):
    """Events by what their JSON says."""
    p = F.from_json("props", "k long, absent string")
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", p.alias("p"))
    return own.groupBy("event_type", (F.col("p.k") % 10).alias("digit")).agg(F.count("*").alias("n"), F.sum("p.k").alias("total"), F.count_if(F.col("p.absent").isNull()).alias("absent"))


_SESSION = "('S' || (c_custkey % 7)::VARCHAR)"


@query(f"SELECT symbol, volume_24h, excluded, note FROM (SELECT c_name AS symbol, c_acctbal AS volume_24h, c_custkey % 7 AS s, CASE WHEN c_custkey % 5 = 0 THEN false WHEN c_name = 'Customer#000000004' THEN NOT (coalesce(c_acctbal < 1000, true)) ELSE coalesce(c_acctbal < 1000, true) END AS excluded, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'none' END AS note FROM customer) WHERE s <> 3")
def record_changes(spark, sf_dir):
    """Records after an exclusion by volume, a toggle, an update of allowed values, a reset of some, and the removal of a session."""
    own = pairs_of(spark, sf_dir).withColumns({"session_id": F.concat(F.lit("S"), (F.col("candle_count") % 7).cast("string")), "note": F.lit("none")})
    out = universe.toggled(universe.exclude_below(own, 1000), "Customer#000000004")
    out = universe.updated(out, F.col("candle_count") % 2 == 0, {"note": F.lit("even"), "symbol": F.lit("never")}, {"note"})
    out = universe.updated(out, F.col("candle_count") % 5 == 0, {"excluded": F.lit(False)}, {"excluded"})
    left = universe.without({"pairs": out}, "S3", ("pairs",))["pairs"]
    return left.select("symbol", "volume_24h", "excluded", "note")


@query(f"SELECT {_SESSION} AS session_id, count(*) AS pairs, count(*) FILTER (WHERE c_acctbal > 0) AS runs FROM customer GROUP BY 1")
def record_counts(spark, sf_dir):
    """Rows of two tables by session."""
    own = pairs_of(spark, sf_dir).withColumn("session_id", F.concat(F.lit("S"), (F.col("candle_count") % 7).cast("string")))
    return universe.counts({"pairs": own, "runs": own.where("volume_24h > 0")})


@query("SELECT c_mktsegment AS quote_asset, c_name AS symbol, round(c_acctbal, 6) AS volume_24h FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name) AS k FROM customer WHERE c_acctbal >= 500 AND upper(c_name) LIKE '%7%') WHERE k = 1")
def latest_records(spark, sf_dir):
    """The first of the searched pairs of each quote."""
    found = universe.viewed(pairs_of(spark, sf_dir), 500, "7")
    return universe.latest(found, ["quote_asset"], "volume_24h", "symbol").select("quote_asset", "symbol", F.round("volume_24h", 6).alias("volume_24h"))
