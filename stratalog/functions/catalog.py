"""Functions of metric expressions that change values one by one, as built-in expressions.

Logarithms follow IEEE (Spark's give null at 0), comparisons too (Spark holds NaN equal to itself and
above all numbers), and casts keep doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _log(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.when(F.isnan(v), NAN).when(v > 0, fn(v)).when(v == 0, -INF).otherwise(NAN)


def _sign(v: Column) -> Column:
    return F.when(F.isnan(v), 0.0).when(v > 0, 1.0).when(v < 0, -1.0).otherwise(0.0)


#: name: expression of the value
VALUES: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh,
    "cos": F.cos, "cosh": F.cosh, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh,
    "ceil": lambda v: F.ceil(v).cast("double"), "floor": lambda v: F.floor(v).cast("double"),
    "exp": F.exp, "sqrt": F.sqrt, "ln": _log(F.ln), "log2": _log(F.log2), "log10": _log(F.log10),
    "deg": F.degrees, "rad": F.radians, "sgn": _sign,
}

#: name: expression of the time, in UTC
DATES: dict[str, Callable[[Column], Column]] = {
    "timestamp": lambda t: F.unix_micros(t) / 1e6, "minute": F.minute, "hour": F.hour, "day_of_week": lambda t: F.dayofweek(t) - 1,
    "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
    "month": F.month, "year": F.year,
}

#: name: (least number of further arguments, expression of the value and those)
LIMITS: dict[str, tuple[int, Callable[..., Column]]] = {
    "clamp": (2, lambda v, low, high: F.greatest(F.least(v, high), low)),
    "clamp_min": (1, lambda v, low: F.greatest(v, low)),
    "clamp_max": (1, lambda v, high: F.least(v, high)),
    "round": (0, lambda v, to=None: F.round(v / (F.lit(1.0) if to is None else to)) * (F.lit(1.0) if to is None else to)),
}


def compare(op: str, a: Column, b: Column) -> Column:
    """1 or 0, by IEEE: nothing but ``!=`` holds for NaN."""
    test = {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    unordered = F.isnan(a) | F.isnan(b)
    return F.when(unordered, 1.0 if op == "!=" else 0.0).otherwise(F.when(test, 1.0).otherwise(0.0))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """Doubles; a division or remainder by zero is NaN."""
    if op in ("/", "%"):
        quotient = a / b if op == "/" else a % b
        return F.when(b != 0, quotient).otherwise(NAN)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b)}[op]()
