"""The indicator registry: names to Column expressions over the bars and other indicators.

`COLUMNS[name]` builds a Column; `needs(name)` are the indicators it reads.
Names in recursive.RECURSIVE come from one grouped pass. `with_indicators`
computes just what is asked for and what that needs: first the recursive
columns, then the expressions by level, each level one `select` over one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import (
    bars_since,
    correlation,
    col,
    deviation,
    diff,
    flag,
    full,
    highest,
    kurtosis,
    lag,
    last_value,
    lead,
    linreg,
    lowest,
    mean_deviation,
    pct_change,
    percent_rank,
    quantile,
    ratio,
    rolling,
    running_max,
    running_sum,
    series,
    skewness,
    sma,
    total,
    weighted,
    window_values,
    wma,
)
from .chunks import Carries, carries, carrying, kept, owned, with_halo
from .recursive import RECURSIVE, compute, compute_split

O, H, L, C, V = "open", "high", "low", "close", "volume"


@dataclass(frozen=True)
class Indicator:
    name: str
    category: str
    build: Callable[[], Column]
    needs: tuple[str, ...] = ()


COLUMNS: dict[str, Indicator] = {}


def put(category: str, needs: str = "", **builders: Callable[[], Column]) -> None:
    for name, build in builders.items():
        COLUMNS[name] = Indicator(name, category, build, tuple(needs.split()))


c = col


def typical() -> Column:
    return (c(H) + c(L) + c(C)) / 3


def true_range() -> Column:
    return F.greatest(c(H) - c(L), F.abs(c(H) - lag(C)), F.abs(c(L) - lag(C)))


def positive(x: Column) -> Column:
    """What is above 0; NULL stays NULL, which `greatest` alone would pass over."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


# --- trend
for _n in (8, 13, 20, 21, 50, 100, 200):
    put("trend", **{f"SMA_{_n}": lambda n=_n: sma(C, n), f"WMA_{_n}": lambda n=_n: wma(C, n)})


for _n, _h, _r in ((9, 4, 3), (20, 10, 4), (50, 25, 7)):
    put("trend", f"_HMA_{_n}", **{f"HMA_{_n}": lambda n=_n, r=_r: wma(f"_HMA_{n}", r)})
    put("", **{f"_HMA_{_n}": lambda n=_n, h=_h: 2 * wma(C, h) - wma(C, n)})
put("", _TP=typical, _TR=true_range, _MID=lambda: (c(H) + c(L)) / 2, _RET=lambda: pct_change(C), _LOGRET=lambda: F.ln(ratio(C, lag(C))), _UP=lambda: positive(diff(C)), _DOWN=lambda: positive(-diff(C)), _ABSDIFF=lambda: F.abs(diff(C)))
put("trend", "_TP", CCI_20=lambda: ratio(c("_TP") - sma("_TP", 20), 0.015 * mean_deviation("_TP", 20)))
put("", _VM_pos=lambda: F.abs(c(H) - lag(L)), _VM_neg=lambda: F.abs(c(L) - lag(H)))
put("trend", "_VM_pos _VM_neg _TR", VI_pos=lambda: ratio(total("_VM_pos", 14), total("_TR", 14)), VI_neg=lambda: ratio(total("_VM_neg", 14), total("_TR", 14)))
put("trend", DPO_20=lambda: lag(C, 11) - sma(C, 20))
put("", **{f"_ROCR_{n}": lambda n=n: (ratio(C, lag(C, n)) - 1) * 100 for n in (10, 15, 20, 30)})
put("trend", "_ROCR_10 _ROCR_15 _ROCR_20 _ROCR_30", KST=lambda: sma("_ROCR_10", 10) + 2 * sma("_ROCR_15", 10) + 3 * sma("_ROCR_20", 10) + 4 * sma("_ROCR_30", 15))
put("trend", "KST", KST_signal=lambda: sma("KST", 9))


def middle(n: int) -> Column:
    return (highest(H, n) + lowest(L, n)) / 2


put("trend", ICH_tenkan=lambda: middle(9), ICH_kijun=lambda: middle(26), ICH_senkou_a=lambda: (middle(9) + middle(26)) / 2, ICH_senkou_b=lambda: middle(52))
put("trend", "ICH_senkou_a ICH_senkou_b", ICH_above_cloud=lambda: flag((c(C) > c("ICH_senkou_a")) & (c(C) > c("ICH_senkou_b"))), ICH_below_cloud=lambda: flag((c(C) < c("ICH_senkou_a")) & (c(C) < c("ICH_senkou_b"))))


def place_of(x: str, n: int, best) -> Column:
    """Percent of the trailing n + 1 rows passed when the best value stood; the first of equals."""
    values = window_values(x, n + 1)
    return full(x, n + 1, (F.array_position(values, best(values)) - 1) * (100.0 / n))


put("trend", AROON_up=lambda: place_of(H, 25, F.array_max), AROON_down=lambda: place_of(L, 25, F.array_min))
put("trend", "AROON_up AROON_down", AROON_osc=lambda: c("AROON_up") - c("AROON_down"), AROONOSC_25=lambda: c("AROON_up") - c("AROON_down"))

# --- momentum
put("momentum", STOCH_K=lambda: ratio(c(C) - lowest(L, 14), highest(H, 14) - lowest(L, 14)) * 100)
put("momentum", "STOCH_K", STOCH_D=lambda: sma("STOCH_K", 3))
put("momentum", WILLR_14=lambda: -100 * ratio(highest(H, 14) - c(C), highest(H, 14) - lowest(L, 14)))
for _n in (5, 10, 14, 20, 30):
    put("momentum", **{f"ROC_{_n}": lambda n=_n: pct_change(C, n) * 100})
put("momentum", "_MID", AO=lambda: sma("_MID", 5) - sma("_MID", 34))
put("", _BP=lambda: c(C) - F.least(c(L), lag(C)), _UOTR=lambda: F.when(lag(C).isNotNull(), F.greatest(c(H), lag(C)) - F.least(c(L), lag(C))))
put("momentum", "_BP _UOTR", UO=lambda: 100 * (4 * ratio(total("_BP", 7), total("_UOTR", 7)) + 2 * ratio(total("_BP", 14), total("_UOTR", 14)) + ratio(total("_BP", 28), total("_UOTR", 28))) / 7)
put("momentum", "_UP _DOWN", CMO_14=lambda: ratio(total("_UP", 14) - total("_DOWN", 14), total("_UP", 14) + total("_DOWN", 14)) * 100)


def fisher_value() -> Column:
    v = 2 * ratio(c("_MID") - lowest(L, 9), highest(H, 9) - lowest(L, 9)) - 1
    return F.when(v.isNotNull(), F.greatest(F.lit(-0.999), F.least(F.lit(0.999), v)))


put("", "_MID", _FISHER=fisher_value)
put("momentum", "_FISHER", FISHER=lambda: last_value(0.5 * F.ln((1 + c("_FISHER")) / (1 - c("_FISHER")))))

# --- volatility
for _n in (14, 20):
    put("", **{f"_BBSD_{_n}": lambda n=_n: rolling(C, n, F.stddev_pop)})
    put("volatility", f"_BBSD_{_n}", **{f"BB_upper_{_n}": lambda n=_n: sma(C, n) + 2 * c(f"_BBSD_{n}"), f"BB_mid_{_n}": lambda n=_n: sma(C, n), f"BB_lower_{_n}": lambda n=_n: sma(C, n) - 2 * c(f"_BBSD_{n}")})
    put("volatility", f"BB_upper_{_n} BB_mid_{_n} BB_lower_{_n}", **{f"BB_width_{_n}": lambda n=_n: ratio(c(f"BB_upper_{n}") - c(f"BB_lower_{n}"), f"BB_mid_{n}") * 100, f"BB_pct_{_n}": lambda n=_n: ratio(c(C) - c(f"BB_lower_{n}"), c(f"BB_upper_{n}") - c(f"BB_lower_{n}"))})
put("", _KCU=lambda: (4 * c(H) - 2 * c(L) + c(C)) / 3, _KCL=lambda: (-2 * c(H) + 4 * c(L) + c(C)) / 3)
put("volatility", "_TP _KCU _KCL", KC_middle=lambda: sma("_TP", 20), KC_upper=lambda: sma("_KCU", 20), KC_lower=lambda: sma("_KCL", 20))
put("volatility", "BB_upper_20 BB_lower_20 KC_upper KC_lower", BB_SQUEEZE=lambda: flag((c("BB_upper_20") < c("KC_upper")) & (c("BB_lower_20") > c("KC_lower"))))
put("volatility", DC_upper=lambda: highest(H, 20), DC_lower=lambda: lowest(L, 20), DC_middle=lambda: (highest(H, 20) + lowest(L, 20)) / 2)
for _n in (7, 14, 21):
    put("volatility", f"ATR_{_n}", **{f"NATR_{_n}": lambda n=_n: ratio(f"ATR_{n}", C) * 100})
for _n in (10, 20, 30, 60):
    put("volatility", "_LOGRET", **{f"HV_{_n}": lambda n=_n: deviation("_LOGRET", n) * math.sqrt(8760)})
put("volatility", "DC_upper DC_lower KC_upper KC_lower", DC_WIDTH=lambda: ratio(c("DC_upper") - c("DC_lower"), C) * 100, KC_WIDTH=lambda: ratio(c("KC_upper") - c("KC_lower"), C) * 100)
put("volatility", "ATR_14", VOL_RATIO_14=lambda: ratio("ATR_14", sma("ATR_14", 100)))

# --- volume
put("volume", OBV=lambda: running_sum(F.when(c(C) < lag(C), -c(V)).otherwise(c(V))))
put("", "_TP", _MFP=lambda: F.when(c("_TP") > lag("_TP"), c("_TP") * c(V)).otherwise(0.0), _MFN=lambda: F.when(c("_TP") < lag("_TP"), c("_TP") * c(V)).otherwise(0.0), _TPV=lambda: c("_TP") * c(V))
put("volume", "_MFP _MFN", MFI_14=lambda: 100 - 100 / (1 + ratio(total("_MFP", 14), total("_MFN", 14))))
put("", _CLV=lambda: ratio((c(C) - c(L)) - (c(H) - c(C)), c(H) - c(L)))
put("", "_CLV", _CMFV=lambda: F.coalesce("_CLV", F.lit(0.0)) * c(V), _ADV=lambda: c("_CLV") * c(V))
put("volume", "_CMFV", CMF_20=lambda: ratio(total("_CMFV", 20), total(V, 20)))
put("volume", "_TPV", VWAP=lambda: ratio(total("_TPV", 14), total(V, 14)))
put("volume", EOM_14=lambda: ratio((diff(H) + diff(L)) * (c(H) - c(L)), 2 * c(V)) * 100_000_000)
put("volume", "OBV OBV_EMA_12", OBV_trend=lambda: F.when(c("OBV") > c("OBV_EMA_12"), 1).otherwise(-1))
put("volume", volume_ratio=lambda: ratio(V, sma(V, 20)))
put("volume", "volume_ratio", volume_spike=lambda: flag(c("volume_ratio") > 2))
put("volume", "_ADV", AD=lambda: running_sum("_ADV"))
put("", _PVTV=lambda: pct_change(C) * c(V), _CV=lambda: c(C) * c(V), _NVIV=lambda: F.when(c(V) < lag(V), 1 + pct_change(C)).otherwise(1.0), _PVIV=lambda: F.when(c(V) > lag(V), 1 + pct_change(C)).otherwise(1.0))
put("volume", "_PVTV", PVT=lambda: running_sum("_PVTV"))
put("volume", "_CV", VWMA_20=lambda: ratio(total("_CV", 20), total(V, 20)), VWMA_50=lambda: ratio(total("_CV", 50), total(V, 50)))


def running_product(x: str) -> Column:
    """Product of the values so far; 0 from the first 0 on. Signs and sizes go apart, for logarithms."""
    signs = running_sum(F.when(c(x) < 0, 1).otherwise(0)) % 2
    size = F.exp(running_sum(F.ln(F.abs(F.nullif(c(x), F.lit(0.0))))))
    return F.when(running_sum(F.when(c(x) == 0, 1).otherwise(0)) > 0, 0.0).otherwise(F.when(signs == 1, -size).otherwise(size))


put("volume", "_NVIV _PVIV", NVI=lambda: 1000 * running_product("_NVIV"), PVI=lambda: 1000 * running_product("_PVIV"))
put("volume", NET_VOL=lambda: c(V) * F.signum(c(C) - c(O)))
put("volume", "OBV", OBV_ZSCORE=lambda: ratio(c("OBV") - sma("OBV", 20), deviation("OBV", 20)))
put("volume", "VWAP", CLOSE_VS_VWAP=lambda: (ratio(C, "VWAP") - 1) * 100)

# --- price
put("price", candle_body=lambda: F.abs(c(C) - c(O)), candle_range=lambda: c(H) - c(L), upper_wick=lambda: c(H) - F.greatest(c(O), c(C)), lower_wick=lambda: F.least(c(O), c(C)) - c(L), close_pct_change=lambda: pct_change(C) * 100)
put("price", "candle_body candle_range upper_wick lower_wick", body_pct=lambda: ratio("candle_body", "candle_range"), upper_wick_pct=lambda: ratio("upper_wick", "candle_range"), lower_wick_pct=lambda: ratio("lower_wick", "candle_range"))
for _n in (20, 50, 200):
    put("price", f"EMA_{_n}", **{f"close_vs_EMA_{_n}": lambda n=_n: (ratio(C, f"EMA_{n}") - 1) * 100})


def turn(above: Column) -> Column:
    now = flag(above)
    return now - F.coalesce(F.lag(now).over(series()), now)


put("price", "EMA_20 EMA_50 EMA_200", ema_20_50_cross=lambda: turn(c("EMA_20") > c("EMA_50")), ema_50_200_cross=lambda: turn(c("EMA_50") > c("EMA_200")), ema_aligned_bull=lambda: flag((c("EMA_20") > c("EMA_50")) & (c("EMA_50") > c("EMA_200"))))
put("price", TYPPRICE=typical, MEDPRICE=lambda: (c(H) + c(L)) / 2, WCLPRICE=lambda: (c(H) + c(L) + 2 * c(C)) / 4, AVGPRICE=lambda: (c(O) + c(H) + c(L) + c(C)) / 4, TRANGE=true_range, BOP=lambda: ratio(c(C) - c(O), c(H) - c(L)))

# --- structure
put("structure", PP=lambda: (highest(H, 20) + lowest(L, 20) + sma(C, 20)) / 3)
put("structure", "PP", R1=lambda: 2 * c("PP") - lowest(L, 20), S1=lambda: 2 * c("PP") - highest(H, 20), R2=lambda: c("PP") + highest(H, 20) - lowest(L, 20), S2=lambda: c("PP") - highest(H, 20) + lowest(L, 20), PP_dist_pct=lambda: ratio(c(C) - c("PP"), "PP") * 100)
put("structure", PRICE_RANGE_PCT=lambda: ratio(c(C) - lowest(L, 20), highest(H, 20) - lowest(L, 20)) * 100)
put("", _HI20=lambda: highest(H, 20), _LO20=lambda: lowest(L, 20))
put("", _TOP=lambda: running_max(H), _BOTTOM=lambda: -running_max(-c(L)))
put("structure", "_HI20 _LO20 _TOP _BOTTOM", HH=lambda: flag(c(H) > lag("_HI20")), LL=lambda: flag(c(L) < lag("_LO20")), BARS_SINCE_HIGH=lambda: bars_since(c(H) == c("_TOP")), BARS_SINCE_LOW=lambda: bars_since(c(L) == c("_BOTTOM")))
put("structure", "ATR_14", HIGH_VOL_REGIME=lambda: flag(c("ATR_14") > quantile("ATR_14", 100, 0.75)))
put("structure", FRACTAL_BEAR=lambda: flag((c(H) > lag(H)) & (c(H) > lag(H, 2)) & (c(H) > lead(H)) & (c(H) > lead(H, 2))), FRACTAL_BULL=lambda: flag((c(L) < lag(L)) & (c(L) < lag(L, 2)) & (c(L) < lead(L)) & (c(L) < lead(L, 2))))

# --- statistics and the rest of the extended suite
put("statistics", MOM_10=lambda: diff(C, 10), MOM_20=lambda: diff(C, 20), ROCP_10=lambda: pct_change(C, 10), ROCR_10=lambda: ratio(C, lag(C, 10)), ROCR100_10=lambda: ratio(C, lag(C, 10)) * 100)
put("statistics", MIDPOINT_14=lambda: (highest(C, 14) + lowest(C, 14)) / 2, MIDPRICE_14=lambda: middle(14), MAX_14=lambda: highest(C, 14), MIN_14=lambda: lowest(C, 14), SUM_14=lambda: total(C, 14))
put("", "_RET", _RETSMA=lambda: sma("_RET", 5))
put("statistics", "_RET _RETSMA", BETA_5=lambda: correlation("_RET", "_RETSMA", 5))
put("statistics", CORREL_CV_14=lambda: correlation(C, V, 14), CORREL_HL_14=lambda: correlation(H, L, 14))
for _n in (10, 20, 50):
    put("statistics", **{f"STDDEV_{_n}": lambda n=_n: deviation(C, n), f"VAR_{_n}": lambda n=_n: rolling(C, n, F.var_samp), f"ZSCORE_{_n}": lambda n=_n: ratio(c(C) - sma(C, n), deviation(C, n)), f"PCT_RANK_{_n}": lambda n=_n: percent_rank(C, n)})
put("statistics", SKEW_20=lambda: skewness(C, 20), KURT_20=lambda: kurtosis(C, 20), MAD_20=lambda: mean_deviation(C, 20), MEDIAN_20=lambda: quantile(C, 20, 0.5), QUANTILE_75_20=lambda: quantile(C, 20, 0.75), QUANTILE_25_20=lambda: quantile(C, 20, 0.25))
put("", _LAG1=lambda: lag(C, 1), _LAG2=lambda: lag(C, 2))
put("statistics", "_LAG1 _LAG2", AUTOCORR_1=lambda: correlation(C, "_LAG1", 20), AUTOCORR_2=lambda: correlation(C, "_LAG2", 20))


def line_at(x: str, n: int, place: float) -> Column:
    slope, start = linreg(x, n)
    return start + slope * place


put("statistics", LINREG_14=lambda: line_at(C, 14, 13), LINREG_SLOPE_14=lambda: linreg(C, 14)[0], LINREG_INTERCEPT_14=lambda: linreg(C, 14)[1], LINREG_ANGLE_14=lambda: F.degrees(F.atan(linreg(C, 14)[0])), TSF_14=lambda: line_at(C, 14, 14), LINREG_SLOPE_5=lambda: linreg(C, 5)[0], CFO_9=lambda: ratio(c(C) - line_at(C, 9, 8), C) * 100)
put("trend", "ALLIGATOR_JAW ALLIGATOR_TEETH ALLIGATOR_LIPS", ALLIGATOR_BULL=lambda: flag((c("ALLIGATOR_LIPS") > c("ALLIGATOR_TEETH")) & (c("ALLIGATOR_TEETH") > c("ALLIGATOR_JAW"))), ALLIGATOR_BEAR=lambda: flag((c("ALLIGATOR_LIPS") < c("ALLIGATOR_TEETH")) & (c("ALLIGATOR_TEETH") < c("ALLIGATOR_JAW"))))
put("trend", "GMMA_S3 GMMA_L60", GMMA_BULL=lambda: flag(c("GMMA_S3") > c("GMMA_L60")))
put("", _CO=lambda: c(C) - c(O), _HL=lambda: c(H) - c(L))
put("", "_CO _HL", _RVGI=lambda: ratio(sma("_CO", 4), sma("_HL", 4)))
put("momentum", "_RVGI", RVGI_14=lambda: sma("_RVGI", 14))
put("volatility", "_TR", CHOP_14=lambda: 100 * F.log10(ratio(total("_TR", 14), highest(H, 14) - lowest(L, 14))) / math.log10(14))
put("trend", "_ABSDIFF", VHF_28=lambda: ratio(highest(C, 28) - lowest(C, 28), total("_ABSDIFF", 28)))
put("momentum", CG_10=lambda: -ratio(weighted(C, list(range(10, 0, -1))), total(C, 10)))
put("", _DD=lambda: F.pow(ratio(c(C) - highest(C, 14), highest(C, 14)) * 100, F.lit(2.0)))
put("volatility", "_DD", UI_14=lambda: F.sqrt(sma("_DD", 14)))
put("", _ACCU=lambda: c(H) * (1 + 4 * ratio(c(H) - c(L), c(H) + c(L))), _ACCL=lambda: c(L) * (1 - 4 * ratio(c(H) - c(L), c(H) + c(L))), _UPBAR=lambda: flag(diff(C) > 0), _HO=lambda: F.greatest(c(H) - c(O), F.lit(0.0)), _OL=lambda: F.greatest(c(O) - c(L), F.lit(0.0)), _HC=lambda: positive(c(H) - lag(C)), _CL=lambda: positive(lag(C) - c(L)))
put("volatility", "_ACCU _ACCL", ACCB_UPPER=lambda: sma("_ACCU", 20), ACCB_MID=lambda: sma(C, 20), ACCB_LOWER=lambda: sma("_ACCL", 20))
put("momentum", "_UPBAR", PSL_12=lambda: sma("_UPBAR", 12) * 100, TREND_STR_14=lambda: sma("_UPBAR", 14) * 100)
put("momentum", "_HO _OL _HC _CL", AR_14=lambda: ratio(total("_HO", 14), total("_OL", 14)) * 100, BR_14=lambda: ratio(total("_HC", 14), total("_CL", 14)) * 100)
put("", "_UP _DOWN", _INERTIA=lambda: ratio(total("_UP", 20), total("_UP", 20) + total("_DOWN", 20)))
put("momentum", "_INERTIA", INERTIA_20=lambda: line_at("_INERTIA", 20, 19))
put("", _C3=lambda: (c(C) + lag(C) + lag(C, 2)) / 3)
put("trend", "_C3", TTM_TREND_6=lambda: F.when(c(C) > sma("_C3", 6), 1).otherwise(-1))
put("volatility", "KC_upper KC_lower", SQUEEZE_HIST=lambda: c(C) - (c("KC_upper") + c("KC_lower")) / 2)
put("", _COPP=lambda: (pct_change(C, 14) + pct_change(C, 11)) * 100)
put("momentum", "_COPP", COPPOCK=lambda: wma("_COPP", 10))
for _n in (20, 50):
    put("", **{f"_TRIMA_{_n}": lambda n=_n: sma(C, (n + 1) // 2)})
    put("trend", f"_TRIMA_{_n}", **{f"TRIMA_{_n}": lambda n=_n: sma(f"_TRIMA_{n}", (n + 1) // 2)})


def gaussian(n: int, offset: float = 0.85, sigma: float = 6.0) -> list[float]:
    """The bell's weights in reverse: the peak lies on old bars."""
    m, s = offset * (n - 1), n / sigma
    w = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)]
    return [x / sum(w) for x in reversed(w)]


def fibonacci(n: int) -> list[float]:
    w = [1.0, 1.0]
    while len(w) < n:
        w.append(w[-1] + w[-2])
    return [x / sum(w[:n]) for x in reversed(w[:n])]


put("trend", ALMA_9=lambda: weighted(C, gaussian(9)), ALMA_21=lambda: weighted(C, gaussian(21)), FWMA_10=lambda: weighted(C, fibonacci(10)), PWMA_10=lambda: weighted(C, [math.comb(9, i) / 512 for i in range(10)]), SWMA=lambda: weighted(C, [1 / 6, 2 / 6, 2 / 6, 1 / 6]), LIN_DECAY_5=lambda: full(C, 5, 0.4 * c(C)))
put("momentum", "_CO", QSTICK_8=lambda: sma("_CO", 8))
put("", "RSI_14", _MAXC14=lambda: highest(C, 14), _MAXRSI14=lambda: highest("RSI_14", 14))
put("momentum", "RSI_14 _MAXC14 _MAXRSI14", RSI_DIVERG=lambda: flag((c(C) > lag("_MAXC14")) & (c("RSI_14") < lag("_MAXRSI14"))))
put("momentum", "MACD MACD_signal", MACD_cross=lambda: turn(c("MACD") > c("MACD_signal")))
put("", _SH13=lambda: sma(H, 13), _SL21=lambda: sma(L, 21))
put("trend", "_SH13 _SL21", HILO_HIGH=lambda: c("_SH13"), HILO_LOW=lambda: c("_SL21"), HILO_dir=lambda: flag(c(C) > c("_SH13")) - flag(c(C) < c("_SL21")))


# --- candlestick patterns, +-100 or 0
def patterns() -> dict[str, tuple[Column, int]]:
    """Condition and value by pattern."""
    body, size = F.abs(c(C) - c(O)), c(H) - c(L)
    up, down = c(C) > c(O), c(C) < c(O)
    high, low = c(H) - F.greatest(c(O), c(C)), F.least(c(O), c(C)) - c(L)
    share = ratio(body, size)
    p = {x: lag(x) for x in (O, H, L, C)}
    q = {x: lag(x, 2) for x in (O, H, L, C)}
    body1 = F.abs(p[C] - p[O])
    up1, down1, up2, down2 = p[C] > p[O], p[C] < p[O], q[C] > q[O], q[C] < q[O]
    half1, half2 = (p[O] + p[C]) / 2, (q[O] + q[C]) / 2
    inside = {"up": down1 & up & (c(O) > p[C]) & (c(C) < p[O]) & (body < 0.5 * body1), "down": up1 & down & (c(O) < p[C]) & (c(C) > p[O]) & (body < 0.5 * body1)}
    harami1 = {"up": down2 & up1 & (p[O] > q[C]) & (p[C] < q[O]), "down": up2 & down1 & (p[O] < q[C]) & (p[C] > q[O])}
    return {
        "DOJI": (share < 0.1, 100), "SPINNING_TOP": ((share > 0.1) & (share < 0.35) & (high > 0.5 * body) & (low > 0.5 * body), 100),
        "BULL_MARUBOZU": (up & (share > 0.9), 100), "BEAR_MARUBOZU": (down & (share > 0.9), -100),
        "HAMMER": (up & (low > 2 * body) & (high < 0.5 * body), 100), "HANGING_MAN": (down & (low > 2 * body) & (high < 0.5 * body), -100),
        "INV_HAMMER": (up & (high > 2 * body) & (low < 0.5 * body), 100), "SHOOTING_STAR": (down & (high > 2 * body) & (low < 0.5 * body), -100),
        "DRAGONFLY": ((share < 0.1) & (low > 0.7 * size), 100), "GRAVESTONE": ((share < 0.1) & (high > 0.7 * size), -100),
        "BULL_ENGULFING": (up & down1 & (c(O) <= p[C]) & (c(C) >= p[O]), 100), "BEAR_ENGULFING": (down & up1 & (c(O) >= p[C]) & (c(C) <= p[O]), -100),
        "BULL_HARAMI": (inside["up"], 100), "BEAR_HARAMI": (inside["down"], -100),
        "DARK_CLOUD": (up1 & down & (c(O) > p[H]) & (c(C) < half1) & (c(C) > p[O]), -100), "PIERCING": (down1 & up & (c(O) < p[L]) & (c(C) > half1) & (c(C) < p[O]), 100),
        "TWEEZER_TOP": (up1 & down & (F.abs(c(H) - p[H]) < 0.02 * size), -100), "TWEEZER_BOTTOM": (down1 & up & (F.abs(c(L) - p[L]) < 0.02 * size), 100),
        "INSIDE_BAR": ((c(H) <= p[H]) & (c(L) >= p[L]), 100), "OUTSIDE_BAR": ((c(H) > p[H]) & (c(L) < p[L]), 100),
        "3_WHITE_SOLDIERS": (up & up1 & up2 & (c(O) > p[O]) & (c(O) < p[C]) & (p[O] > q[O]) & (p[O] < q[C]) & (c(C) > p[C]) & (p[C] > q[C]), 100),
        "3_BLACK_CROWS": (down & down1 & up2 & (c(O) < p[O]) & (c(O) > p[C]) & (c(C) < p[C]) & (p[C] < q[C]), -100),
        "MORNING_STAR": (down2 & up & (body1 < 0.3 * body) & (c(C) > half2), 100), "EVENING_STAR": (up2 & down & (body1 < 0.3 * body) & (c(C) < half2), -100),
        "3_INSIDE_UP": (harami1["up"] & up & (c(C) > p[C]), 100), "3_INSIDE_DOWN": (harami1["down"] & down & (c(C) < p[C]), -100),
    }


_PATTERNS: dict[bool, dict[str, tuple[Column, int]]] = {}


def pattern(name: str) -> Column:
    split = carries() is not None
    if split not in _PATTERNS:
        _PATTERNS[split] = patterns()
    condition, value = _PATTERNS[split][name]
    return flag(condition) * value


CANDLES = [f"CDL_{x}" for x in "DOJI SPINNING_TOP BULL_MARUBOZU BEAR_MARUBOZU HAMMER HANGING_MAN INV_HAMMER SHOOTING_STAR DRAGONFLY GRAVESTONE BULL_ENGULFING BEAR_ENGULFING BULL_HARAMI BEAR_HARAMI DARK_CLOUD PIERCING TWEEZER_TOP TWEEZER_BOTTOM INSIDE_BAR OUTSIDE_BAR 3_WHITE_SOLDIERS 3_BLACK_CROWS MORNING_STAR EVENING_STAR 3_INSIDE_UP 3_INSIDE_DOWN".split()]


put("candles", **{n: lambda n=n: pattern(n.removeprefix("CDL_")) for n in CANDLES})


def names() -> list[str]:
    """Every indicator a caller may ask for."""
    return [*RECURSIVE, *(n for n in COLUMNS if n[0] != "_")]


def catalog() -> dict[str, list[str]]:
    """Names by category."""
    found: dict[str, list[str]] = {}
    for n in names():
        category = COLUMNS[n].category if n in COLUMNS else "recursive"
        found.setdefault(category, []).append(n)
    return found


def _levels(wanted: list[str]) -> tuple[list[str], list[list[str]]]:
    """The recursive columns and, in order, the levels of expressions that the wanted names need."""
    depth: dict[str, int] = {}

    def visit(n: str) -> int:
        if n in RECURSIVE:
            depth[n] = 0
        elif n in COLUMNS:
            if n not in depth:
                depth[n] = 1 + max([0, *(visit(x) for x in COLUMNS[n].needs)])
        else:
            raise KeyError(f"no indicator {n}")
        return depth[n]

    for n in wanted:
        visit(n)
    levels = [[n for n, d in depth.items() if d == k] for k in range(1, max([0, *depth.values()]) + 1)]
    return [n for n, d in depth.items() if d == 0], levels


#: Rows ahead of a chunk and behind it that windows may reach, one window over another; and by how many of them a running value's own windows look back.
BEFORE, AFTER, WITHIN = 320, 2, 32


def with_indicators(bars: DataFrame, wanted: list[str], rows: int | None = None) -> DataFrame:
    """bars with the wanted indicators, and no others.

    With `rows`, series of any length: each is cut into chunks of so many rows
    (or of what the indicators reach, if that is more), and a chunk is a task's
    work. Results are the same but for rounding. Jobs run when it is called.
    """
    has = set(bars.columns)
    wanted = [n for n in dict.fromkeys(wanted) if n not in has]
    first, levels = _levels(wanted)
    first = [n for n in first if n not in has]
    if rows is None:
        out = compute(bars, first)
        for level in levels:
            out = out.withColumns({n: COLUMNS[n].build() for n in level if n not in has})
        return out.select(*bars.columns, *wanted)
    out = compute_split(bars, first, rows)
    if levels:
        rows = max(rows, 2 * (BEFORE + AFTER))
        out = with_halo(kept(out) if first else out, rows, BEFORE, AFTER)
        for number, level in enumerate(levels, 1):
            with carrying(Carries(rows, BEFORE, WITHIN * number)) as carried:
                made = {n: COLUMNS[n].build() for n in level if n not in has}
            out = carried.join(out).withColumns(made).drop(*carried.columns)
        out = owned(out)
    return out.select(*bars.columns, *wanted)
