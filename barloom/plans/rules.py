"""Rules: named conditions, crosses, slots and a safe expression language, all as boolean Columns (unknown: false)."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import crossed_above, crossed_below, lag

#: The 26 named conditions, (column, operator, column or number).
CONDITIONS: dict[str, tuple[str, str, str | float]] = {
    "EMA20>EMA50": ("EMA_20", ">", "EMA_50"), "EMA50>EMA200": ("EMA_50", ">", "EMA_200"), "close>EMA50": ("close", ">", "EMA_50"), "close>EMA200": ("close", ">", "EMA_200"),
    "SUPERT bull": ("SUPERT_dir", "==", 1), "PSAR bull": ("PSAR_dir", "==", 1), "RSI<30": ("RSI_14", "<", 30), "RSI<35": ("RSI_14", "<", 35), "RSI<40": ("RSI_14", "<", 40),
    "RSI>50": ("RSI_14", ">", 50), "RSI>60": ("RSI_14", ">", 60), "STOCH<20": ("STOCH_K", "<", 20), "STOCH<30": ("STOCH_K", "<", 30), "STOCHRSI<20": ("STOCHRSI_K", "<", 20),
    "CCI<-100": ("CCI_20", "<", -100), "CCI<-150": ("CCI_20", "<", -150), "MFI<25": ("MFI_14", "<", 25), "MFI<35": ("MFI_14", "<", 35), "WILLR<-70": ("WILLR_14", "<", -70),
    "MACD_hist>0": ("MACD_hist", ">", 0), "close<BB_lower": ("close", "<", "BB_lower_20"), "ADX>20": ("ADX_14", ">", 20), "ADX>25": ("ADX_14", ">", 25),
    "vol_ratio>1.5": ("volume_ratio", ">", 1.5), "CMF>0": ("CMF_20", ">", 0), "close>BB_upper": ("close", ">", "BB_upper_20"),
}

#: The 19 crosses, all upward; H: of a longer timeframe.
CROSSES: list[tuple[str, str | float]] = [
    ("EMA_8", "EMA_20"), ("EMA_20", "EMA_50"), ("EMA_50", "EMA_200"), ("close", "EMA_200"), ("close", "KC_lower"), ("close", "BB_lower_20"), ("RSI_14", 30), ("RSI_14", 50), ("STOCH_K", 20), ("STOCHRSI_K", 20),
    ("CCI_20", -100), ("WILLR_14", -50), ("MACD", "MACD_signal"), ("MACD_hist", 0), ("close", "H:EMA_50"), ("close", "H:EMA_200"), ("close", "H:KC_lower"), ("close", "H:BB_lower_20"), ("EMA_20", "H:EMA_50"),
]

#: By slot, option to (column, operator, column or number). "up" and "down" are crosses, "flip" a change of sign.
SLOTS: dict[str, dict[str, tuple]] = {
    "trend": {
        "none": (), "ema20_gt_ema50": ("EMA_20", ">", "EMA_50"), "ema50_gt_ema200": ("EMA_50", ">", "EMA_200"), "price_gt_ema50": ("close", ">", "EMA_50"), "price_gt_ema200": ("close", ">", "EMA_200"),
        "supertrend_bull": ("SUPERT_dir", "==", 1), "psar_bull": ("PSAR_dir", "==", 1), "ichimoku_bull": ("ICH_above_cloud", "==", 1),
    },
    "setup": {
        "none": (), "rsi_lt_30": ("RSI_14", "<", 30), "rsi_lt_35": ("RSI_14", "<", 35), "rsi_lt_40": ("RSI_14", "<", 40), "rsi_gt_50": ("RSI_14", ">", 50), "stoch_lt_20": ("STOCH_K", "<", 20), "stoch_lt_30": ("STOCH_K", "<", 30),
        "macd_positive": ("MACD_hist", ">", 0), "cci_lt_m100": ("CCI_20", "<", -100), "mfi_lt_25": ("MFI_14", "<", 25), "mfi_lt_35": ("MFI_14", "<", 35), "bb_below_lower": ("close", "<", "BB_lower_20"),
        "adx_gt_20": ("ADX_14", ">", 20), "adx_gt_25": ("ADX_14", ">", 25), "vol_spike": ("volume_ratio", ">", 1.5),
    },
    "trigger": {
        "ema20_cross_ema50": ("EMA_20", "up", "EMA_50"), "price_cross_ema50": ("close", "up", "EMA_50"), "price_cross_ema200": ("close", "up", "EMA_200"), "rsi_cross_30": ("RSI_14", "up", 30), "rsi_cross_50": ("RSI_14", "up", 50),
        "stoch_cross_20": ("STOCH_K", "up", 20), "stochrsi_cross_20": ("STOCHRSI_K", "up", 20), "macd_cross_signal": ("MACD", "up", "MACD_signal"), "macd_hist_cross_0": ("MACD_hist", "up", 0), "cci_cross_m100": ("CCI_20", "up", -100),
        "willr_cross_m50": ("WILLR_14", "up", -50), "hammer_pattern": ("CDL_HAMMER", "any>", "CDL_INV_HAMMER"), "bull_engulf": ("CDL_ENGULFING", ">", 0), "bb_lower_cross": ("close", "up", "BB_lower_20"),
        "supertrend_flip": ("SUPERT_dir", "flip", 1), "ha_3green": ("HA_close", "green", "HA_open"),
    },
    "context": {
        "none": (), "htf_ema50_bull": ("close", ">", "H:EMA_50"), "htf_ema200_bull": ("close", ">", "H:EMA_200"), "htf_supertrend_bull": ("H:SUPERT_dir", "==", 1), "htf_rsi_not_ob": ("H:RSI_14", "<", 70), "htf_adx_trending": ("H:ADX_14", ">", 20),
    },
    "exit": {
        "rsi_gt_70": ("RSI_14", ">", 70), "rsi_gt_75": ("RSI_14", ">", 75), "rsi_gt_80": ("RSI_14", ">", 80), "ema20_cross_below_ema50": ("EMA_20", "down", "EMA_50"), "supertrend_flip_bear": ("SUPERT_dir", "flip", -1),
        "stoch_gt_80": ("STOCH_K", ">", 80), "macd_hist_cross_below_0": ("MACD_hist", "down", 0),
    },
}
#: What a rule says where its column is missing.
MISSING = {"trend": True, "setup": True, "trigger": False, "context": True, "exit": False}


def known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def find(name: str | float, columns: list[str]) -> str | float | None:
    """The column of a name; H: names the first column of a longer timeframe with that ending."""
    if not isinstance(name, str):
        return name
    if name.startswith("H:"):
        return next((c for c in columns if c.startswith("HTF_") and c.endswith("_" + name[2:])), None)
    return name if name in columns else None


def condition(rule: tuple, columns: list[str], missing: bool) -> Column:
    """The Column of a rule."""
    if not rule:
        return F.lit(True)
    left, op, right = rule
    a, b = find(left, columns), find(right, columns)
    if a is None or b is None:
        return F.lit(missing)
    x, y = F.col(a), F.col(b) if isinstance(b, str) else F.lit(b)
    table: dict[str, Callable[[], Column]] = {
        ">": lambda: x > y, "<": lambda: x < y, ">=": lambda: x >= y, "<=": lambda: x <= y, "==": lambda: x == y,
        "up": lambda: crossed_above(a, b), "down": lambda: crossed_below(a, b), "flip": lambda: (x == y) & (lag(a) == -y),
        "any>": lambda: (x > 0) | (y > 0), "green": lambda: (x > y) & (lag(a) > lag(b)) & (lag(a, 2) > lag(b, 2)),
    }
    return known(table[op]())


def slot(name: str, option: str, columns: list[str]) -> Column:
    return condition(SLOTS[name].get(option, ()), columns, MISSING[name]) if option in SLOTS[name] else F.lit(MISSING[name])


def slot_signals(df: DataFrame, params: dict[str, str]) -> DataFrame:
    """entry_signal = trend & setup & trigger & context; exit_signal = exit."""
    entry = F.lit(True)
    for name in ("trend", "setup", "trigger", "context"):
        entry = entry & slot(name, params.get(name, "none"), df.columns)
    return df.withColumns({"entry_signal": entry.cast("int"), "exit_signal": slot("exit", params.get("exit", "rsi_gt_70"), df.columns).cast("int")})


def needed(params: dict[str, str]) -> list[str]:
    """Indicators that the options read."""
    found = [x for s, o in params.items() if s in SLOTS for x in SLOTS[s].get(o, ())[::2]]
    return [x for x in dict.fromkeys(found) if isinstance(x, str) and not x.startswith("H:") and x not in ("open", "high", "low", "close", "volume")]


def default_signals(df: DataFrame) -> DataFrame:
    """The default strategy: a rising trend with room left in; out when overbought or the trend turns."""
    entry = (F.col("EMA_20") > F.col("EMA_50")) & (F.col("RSI_14") > 40) & (F.col("RSI_14") < 70) & (F.col("MACD_hist") > 0) & (F.col("ADX_14") > 20)
    return df.withColumns({"entry_signal": known(entry).cast("int"), "exit_signal": (known(F.col("RSI_14") > 75) | known(F.col("ema_20_50_cross") == -1)).cast("int")})


def template_signals(df: DataFrame) -> DataFrame:
    """The template for own strategies: oversold within a trend."""
    entry = (F.col("RSI_14") < 35) & (F.col("close") > F.col("EMA_50")) & (F.col("MACD_hist") > 0) & (F.col("ADX_14") > 20)
    return df.withColumns({"entry_signal": known(entry).cast("int"), "exit_signal": (known(F.col("RSI_14") > 70) | known(F.col("ema_20_50_cross") == -1)).cast("int")})


def threshold_signals(df: DataFrame, entry: str, thresholds: list[tuple[str, str, float]], rsi_period: int, rsi_threshold: float) -> DataFrame:
    """A user's expression and thresholds by indicator; out by RSI or when the averages cross down."""
    into = expression(entry, df.columns)
    for name, op, value in thresholds:
        into = into & condition((name, op, value), df.columns, True)
    leave = condition((f"RSI_{rsi_period}", ">", rsi_threshold), df.columns, False) | condition(("ema_20_50_cross", "==", -1), df.columns, False)
    return df.withColumns({"entry_signal": into.cast("int"), "exit_signal": leave.cast("int")})


def named_conditions(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """df with a 0/1 column for each named condition whose columns are there."""
    rules = {n: r for n, r in CONDITIONS.items() if (names is None or n in names) and find(r[0], df.columns) is not None and find(r[2], df.columns) is not None}
    return df.withColumns({f"C_{n}": condition(r, df.columns, False).cast("int") for n, r in rules.items()})


class RuleError(ValueError):
    """The expression isn't in the language."""


_BINARY = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.BitAnd: "__and__", ast.BitOr: "__or__"}
_COMPARE = {ast.Gt: "__gt__", ast.Lt: "__lt__", ast.GtE: "__ge__", ast.LtE: "__le__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}


def expression(text: str, columns: list[str]) -> Column:
    """A boolean expression over column names: numbers, + - * /, comparisons (chained too), and or not & | ~, abs().

    Parsed, never run. An empty text, or one that isn't in the language or
    names no column, is false for all rows, as a failing expression would be.
    """
    try:
        return known(_parsed(ast.parse(text.strip(), mode="eval").body, columns).cast("boolean"))
    except (SyntaxError, RuleError):
        return F.lit(False)


def _parsed(node: ast.AST, columns: list[str]) -> Column:
    match node:
        case ast.Constant(value=bool() | int() | float()):
            return F.lit(node.value)
        case ast.Name(id=name) if name in columns:
            return F.col(name)
        case ast.Subscript(value=ast.Name(id="df"), slice=ast.Constant(value=str(name))) if name in columns:
            return F.col(name)
        case ast.BoolOp(op=op, values=values):
            parts = [known(_parsed(v, columns)) for v in values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(op, ast.And) else out | p
            return out
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_parsed(x, columns)
        case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
            return ~known(_parsed(x, columns))
        case ast.BinOp(left=a, op=ast.Div(), right=b):
            return F.try_divide(_parsed(a, columns), _parsed(b, columns))
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            x, y = _parsed(a, columns), _parsed(b, columns)
            if isinstance(op, (ast.BitAnd, ast.BitOr)):
                x, y = known(x), known(y)
            return getattr(x, _BINARY[type(op)])(y)
        case ast.Compare(left=first, ops=ops, comparators=rest) if all(type(o) in _COMPARE for o in ops):
            sides = [_parsed(x, columns) for x in (first, *rest)]
            out = F.lit(True)
            for a, o, b in zip(sides, ops, sides[1:], strict=False):
                out = out & known(getattr(a, _COMPARE[type(o)])(b))
            return out
        case ast.Call(func=ast.Name(id="abs"), args=[x], keywords=[]):
            return F.abs(_parsed(x, columns))
    raise RuleError(ast.dump(node)[:80])


def direction(text: str, default: str = "long") -> tuple[str, str]:
    """The direction named by the last `# direction:` line, and the text without such lines."""
    found, rest = default, []
    for line in text.splitlines():
        head, _, value = line.strip().partition(":")
        if head.replace(" ", "").lower() == "#direction" and value.strip().lower() in ("long", "short"):
            found = value.strip().lower()
        else:
            rest.append(line)
    return found, "\n".join(rest).strip()


def valid(source: str) -> str | None:
    """None if a strategy's source parses, else what is wrong. Nothing is run."""
    try:
        ast.parse(source)
    except SyntaxError as e:
        return f"line {e.lineno}: {e.msg}"
    return None


def describe(rule: tuple) -> str:
    """A rule in words."""
    if not rule:
        return "any"
    a, op, b = rule
    words = {"up": "crosses above", "down": "crosses below", "flip": "turns to", "any>": "or", "green": "three times above", "==": "is"}
    return f"{str(a).replace('H:', 'higher ')} {words.get(op, op)} {str(b).replace('H:', 'higher ')}"


def rule_text(params: dict[str, str]) -> str:
    return "; ".join(f"{s}: {describe(SLOTS[s].get(params[s], ()))}" for s in SLOTS if s in params)
