"""What a column of indicators is good for: its kind of condition, its category and where a threshold is sought.

A catalog is read from a schema alone, and applied as one pass: a column's
condition is `KINDS[kind](column, threshold)`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import CROSSES, condition, known

#: The kinds of condition, of a column and a threshold.
KINDS: dict[str, Callable[[Column, Column], Column]] = {
    "osc": lambda x, t: x < t, "lt": lambda x, t: x < t, "band_pct": lambda x, t: x < t, "gt": lambda x, t: x > t, "sign": lambda x, t: x > 0, "flag": lambda x, t: x == 1,
    "cdl": lambda x, t: x > 0, "ma": lambda x, t: F.col("close") > x, "band_lower": lambda x, t: F.col("close") < x,
}

#: Columns whose kind, category and range are stated and looked up first; True: chosen unless something else is.
STATED: dict[str, tuple[str, str, tuple[float, float] | None, bool]] = {
    "RSI_7": ("osc", "Oscillators", (15, 50), False),
    "RSI_14": ("osc", "Oscillators", (20, 50), True),
    "RSI_21": ("osc", "Oscillators", (25, 55), False),
    "STOCH_K": ("osc", "Oscillators", (10, 40), False),
    "STOCHRSI_K": ("osc", "Oscillators", (5, 30), False),
    "WILLR_14": ("osc", "Oscillators", (-80, -20), False),
    "MFI_14": ("osc", "Oscillators", (20, 50), False),
    "CCI_20": ("osc", "Oscillators", (-150, -50), False),
    "EMA_8": ("ma", "Trend", None, False),
    "EMA_13": ("ma", "Trend", None, False),
    "EMA_20": ("ma", "Trend", None, True),
    "EMA_50": ("ma", "Trend", None, True),
    "EMA_100": ("ma", "Trend", None, False),
    "EMA_200": ("ma", "Trend", None, False),
    "SUPERT_dir": ("flag", "Trend", None, True),
    "PSAR_dir": ("flag", "Trend", None, False),
    "OBV_trend": ("flag", "Volume", None, False),
    "ADX_14": ("gt", "Trend", (15, 35), True),
    "AROON_up": ("gt", "Trend", (50, 90), False),
    "MACD_hist": ("sign", "Momentum", None, True),
    "AO": ("sign", "Momentum", None, False),
    "CMF_20": ("sign", "Momentum", None, False),
    "ROC_10": ("gt", "Momentum", (-1, 3), False),
    "KC_lower": ("band_lower", "Bands", None, False),
    "BB_lower_20": ("band_lower", "Bands", None, False),
    "BB_pct_20": ("band_pct", "Bands", (0.1, 0.4), True),
    "BB_width_20": ("gt", "Bands", (0.005, 0.05), False),
    "NATR_14": ("lt", "Volatility", (0.5, 4.0), False),
    "volume_ratio": ("gt", "Volume", (0.5, 2.5), True),
}

#: Names of the crosses, in the order of rules.CROSSES.
CROSS_NAMES = [
    "X_ema8_x_ema20", "X_ema20_x_ema50", "X_ema50_x_ema200", "X_close_x_ema200", "X_close_x_kc_lower", "X_close_x_bb_lower", "X_rsi14_x_30", "X_rsi14_x_50", "X_stochk_x_20", "X_stochrsi_x_20",
    "X_cci_x_m100", "X_willr_x_m50", "X_macd_x_signal", "X_macd_hist_x_0", "X_close_x_htf_ema50", "X_close_x_htf_ema200", "X_close_x_htf_kc_lower", "X_close_x_htf_bb_lower", "X_ema20_x_htf_ema50",
]

#: Columns that are no condition by themselves.
SKIPPED = frozenset([
    "open", "high", "low", "close", "volume", "timestamp", "date", "entry_signal", "exit_signal", "ema_20_50_cross", "ema_50_200_cross", "ema_aligned_bull", "MACD", "MACD_signal", "STOCH_D", "STOCHRSI_D", "PSAR_up", "PSAR_down",
    "BB_upper_14", "BB_mid_14", "BB_upper_20", "BB_mid_20", "KC_upper", "KC_middle", "DC_upper", "DC_middle", "SUPERT_10_3", "SUPERT_14_2", "SUPERT_7_3", "SUPERT_20_2", "SUPERT_dir_10_3", "SUPERT_dir_14_2", "SUPERT_dir_7_3", "SUPERT_dir_20_2",
    "ACCB_UPPER", "ACCB_MID", "DMP_7", "DMN_7", "DMP_14", "DMN_14", "DMP_21", "DMN_21", "ADX_7", "ADX_21", "ATR_7", "ATR_20", "ATR_21", "NATR_7", "NATR_21", "candle_body", "candle_range", "upper_wick", "lower_wick",
    "TYPPRICE", "MEDPRICE", "WCLPRICE", "AVGPRICE", "TRANGE", "MIDPOINT_14", "MIDPRICE_14", "MAX_14", "MIN_14", "SUM_14", "BARS_SINCE_HIGH", "BARS_SINCE_LOW", "PRICE_RANGE_PCT", "KST_signal", "PPO", "PPO_signal", "KDJ_D",
    "ICH_tenkan", "ICH_kijun", "ICH_senkou_a", "ICH_senkou_b", "ICH_below_cloud", "ALLIGATOR_JAW", "ALLIGATOR_TEETH", "ALLIGATOR_LIPS", "ALLIGATOR_BEAR", "AROON_down", "VI_neg", "BEAR_POWER_13", "FRACTAL_BEAR",
    "OBV", "OBV_EMA_12", "body_pct", "upper_wick_pct", "lower_wick_pct", "PP", "R1", "R2", "S1", "S2", "PP_dist_pct", "OBV_ZSCORE", "ROCR_10", "ROCR100_10", "APO_12_26", "ROCP_10", "STDDEV_10", "STDDEV_20", "STDDEV_50", "VAR_10", "VAR_20", "VAR_50",
    "SKEW_20", "KURT_20", "MAD_20", "MEDIAN_20", "QUANTILE_75_20", "QUANTILE_25_20", "AUTOCORR_2", "BETA_5", "CORREL_CV_14", "CORREL_HL_14", "TSF_14", "LINREG_14", "LINREG_INTERCEPT_14", "LINREG_ANGLE_14", "TREND_STR_14", "INERTIA_20", "DECAY", "LIN_DECAY_5",
    "AMAT_fast", "SMI_signal", "QQE_LINE", "MACD_cross", "HILO_HIGH", "HILO_LOW", "PSL_12", "QSTICK_8", "CFO_9", "CG_10", "NVI", "PVI", "PVO_signal", "AR_14", "BR_14", "BRAR", "volume_spike", "VOL_RATIO_14", "DEMA_ext_9", "DEMA_ext_21", "TEMA_ext_9", "TEMA_ext_21",
    "CDL_SPINNING_TOP", "CDL_DOJI", "CDL_BEAR_MARUBOZU", "CDL_HANGING_MAN", "CDL_SHOOTING_STAR", "CDL_GRAVESTONE", "CDL_DARK_CLOUD", "CDL_BEAR_ENGULFING", "CDL_BEAR_HARAMI", "CDL_BULL_HARAMI", "CDL_TWEEZER_TOP",
    "CDL_3_INSIDE_DOWN", "CDL_3_BLACK_CROWS", "CDL_EVENING_STAR", "CDL_OUTSIDE_BAR", "CDL_INSIDE_BAR", "HIGH_VOL_REGIME", "BB_SQUEEZE", "LL", "RSI_DIVERG",
    "GMMA_S3", "GMMA_S5", "GMMA_S8", "GMMA_S10", "GMMA_S12", "GMMA_S15", "GMMA_L30", "GMMA_L35", "GMMA_L40", "GMMA_L45", "GMMA_L50", "GMMA_L60", "HH",
])

#: What each kind is told by: exact names; beginnings; endings; range of the threshold. The first line that fits counts.
TOLD: list[tuple[str, list[str], list[str], list[str], tuple[float, float] | None]] = [
    ("cdl", [], ["CDL_"], [], None),
    ("flag", ["SUPERT_dir", "PSAR_dir", "OBV_trend", "GMMA_BULL", "ICH_above_cloud", "HILO_dir", "PMAX_dir", "TTM_TREND_6", "ALLIGATOR_BULL", "FRACTAL_BULL"], [], ["_dir", "_BULL"], None),
    ("ma", ["KAMA", "VIDYA_14", "FWMA_10", "PWMA_10", "SWMA", "HWMA", "MCGD_14", "VWAP"], ["EMA_", "SMA_", "WMA_", "TEMA_", "DEMA_", "HMA_", "ZLEMA_", "TRIMA_", "ALMA_", "T3_", "VWMA_"], [], None),
    ("sign", ["MACD_hist", "AO", "CMF_20", "KVO", "BOP", "PPO_hist", "AROON_osc", "KST", "DPO_20", "STC", "FISHER", "SQUEEZE_HIST", "QQE_HIST", "BULL_POWER_13", "EMA50_slope", "CLOSE_VS_VWAP", "KDJ_J", "TSI_13_25", "SMI", "COPPOCK", "NET_VOL", "AD", "FI_13", "EOM_14", "close_pct_change", "PVT", "AUTOCORR_1", "RVGI_14", "PVO", "TRIX_15"], ["BIAS_", "close_vs_", "LINREG_SLOPE", "ZSCORE_", "PCT_RANK_", "ROC_", "MOM_", "ROCP_"], [], None),
    ("osc", [], ["RSI_"], [], (20, 50)),
    ("osc", [], ["STOCH"], [], (5, 35)),
    ("osc", ["WILLR_14"], [], [], (-80, -20)),
    ("osc", [], ["MFI_"], [], (20, 50)),
    ("osc", [], ["CCI_"], [], (-150, -50)),
    ("osc", ["CMO_14", "CRSI", "RSX_14", "UO", "KDJ_K", "CHOP_14"], [], [], (20, 55)),
    ("band_lower", ["KC_lower", "BB_lower_20", "BB_lower_14", "DC_lower", "ACCB_LOWER"], ["BB_lower", "KC_lower", "DC_lower", "ACCB_LOWER"], [], None),
    ("band_pct", [], ["BB_pct_"], [], (0.1, 0.4)),
    ("lt", [], ["NATR_"], [], (0.5, 4.0)),
    ("lt", [], ["HV_"], [], (10, 60)),
    ("lt", ["UI_14", "MASS_INDEX"], [], [], (20, 60)),
    ("lt", ["KC_WIDTH", "DC_WIDTH"], ["BB_width_"], [], (0.01, 0.1)),
    ("gt", [], ["ADX_"], [], (15, 35)),
    ("gt", ["AROON_up"], [], [], (50, 90)),
    ("gt", ["AROONOSC_25"], [], [], (0, 80)),
    ("gt", ["volume_ratio"], [], [], (0.5, 2.5)),
    ("gt", [], ["DMP_"], [], (10, 40)),
    ("gt", ["VI_pos"], [], [], (0.8, 1.3)),
    ("gt", ["VHF_28"], [], [], (0.2, 0.5)),
]

#: Categories by a part of the upper-cased name; the first that fits counts.
CATEGORIES: dict[str, list[str]] = {
    "Trend": ["EMA", "SMA", "WMA", "TEMA", "DEMA", "HMA", "ZLEMA", "TRIMA", "ALMA", "T3_", "KAMA", "VWAP", "VWMA", "VIDYA", "FWMA", "PWMA", "SWMA", "HWMA", "MCGD", "ADX", "AROON", "SUPERT", "PSAR", "GMMA", "HILO", "PMAX", "VI_", "AROONOSC"],
    "Momentum": ["RSI", "STOCH", "MACD", "CCI", "MOM", "ROC", "AO", "DPO", "KST", "TRIX", "WILLR", "UO", "CMO", "CRSI", "KDJ", "TSI", "STC", "FISHER", "SMI", "QQE", "COPPOCK", "PPO", "RVGI"],
    "Bands": ["BB_", "KC_", "DC_", "ACCB"],
    "Volatility": ["ATR", "NATR", "HV_", "CHOP", "VHF", "UI_", "SQUEEZE", "VOL_RATIO", "STDDEV", "VAR_", "MASS_INDEX"],
    "Volume": ["OBV", "MFI", "CMF", "FI_", "EOM", "AD", "PVT", "NVI", "PVI", "KVO", "VOL", "VOLUME", "NET_VOL", "PVO", "BRAR", "AR_", "BR_"],
    "Patterns": ["CDL_"],
    "Statistical": ["ZSCORE", "PCT_RANK", "AUTOCORR", "LINREG", "INERTIA", "BIAS", "CORREL", "TREND_STR"],
    "Price Action": ["CLOSE_VS", "CLOSE_PCT", "EMA50_SLOPE"],
}
#: Kinds, or beginnings of names, whose category doesn't follow from the name's parts.
_OWN_CATEGORY = {"cdl": "Candlesticks", "ma": "Trend", "band_lower": "Bands", "band_pct": "Bands"}


@dataclass(frozen=True)
class Entry:
    column: str
    kind: str
    category: str
    low: float | None = None
    high: float | None = None
    default: bool = False

    def condition(self, threshold: float | None = None, columns: list[str] = ()) -> Column:
        """Whether the column's condition holds; unknown is false. Without a threshold, the middle of its range. A cross is read from the columns."""
        if self.kind == "cross":
            a, b = CROSSES[CROSS_NAMES.index(self.column)]
            return condition((a, "up", b), list(columns), False)
        middle = (self.low + self.high) / 2 if self.low is not None else 0.0
        return known(KINDS[self.kind](F.col(self.column), F.lit(middle if threshold is None else threshold)))


def category(column: str) -> str:
    upper = column.upper()
    return next((name for name, parts in CATEGORIES.items() if any(p in upper for p in parts)), "Other")


def classify(column: str) -> Entry | None:
    """The entry of a column, or None for one that is no condition by itself; columns of longer timeframes aren't either. What is stated comes before what names tell."""
    if column in STATED:
        kind, own, ends, default = STATED[column]
        return Entry(column, kind, own, *(ends or (None, None)), default)
    if column in SKIPPED or column.startswith("HTF_"):
        return None
    for kind, exact, beginnings, endings, ends in TOLD:
        if column in exact or column.startswith(tuple(beginnings)) or column.endswith(tuple(endings)):
            low, high = ends or (None, None)
            named = {"RSI_": "Momentum", "MFI_": "Volume", "BB_width": "Bands", "KC_WIDTH": "Bands", "DC_WIDTH": "Bands", "VHF": "Volatility", "CHOP": "Momentum", "RSX": "Momentum"}
            own = _OWN_CATEGORY.get(kind) or next((c for p, c in named.items() if column.startswith(p)), None)
            return Entry(column, kind, own or category(column), low, high)
    return None


def of_schema(schema: T.StructType) -> dict[str, Entry]:
    """The catalog of the numeric columns of a schema, and the crosses, which are no columns; no data is read."""
    numeric = (f.name for f in schema.fields if isinstance(f.dataType, T.NumericType))
    return {n: e for n in numeric if (e := classify(n)) is not None} | crosses()


def crosses() -> dict[str, Entry]:
    """The crosses by name; one whose columns a table lacks never happens there."""
    return {n: Entry(n, "cross", "Crosses/HTF" if str(b).startswith("H:") else "Crosses") for n, (_, b) in zip(CROSS_NAMES, CROSSES, strict=True)}


def hits(df: DataFrame, entries: list[Entry]) -> DataFrame:
    """column, kind, n, hits: how often each entry's condition holds, by one pass."""
    flags = df.select(*(e.condition(columns=df.columns).alias(f"c{i}") for i, e in enumerate(entries)))  # crosses look back
    row = flags.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"c{i}")).alias(f"h{i}") for i, e in enumerate(entries)))
    told = F.array(*(F.struct(F.lit(e.column).alias("column"), F.lit(e.kind).alias("kind"), F.col(f"h{i}").alias("hits")) for i, e in enumerate(entries)))
    return row.select("_n", F.explode(told).alias("s")).select("s.column", "s.kind", F.col("_n").alias("n"), "s.hits")
