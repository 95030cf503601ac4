"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def r(x: Column, digits: int) -> Column:
    """Half-up rounding with the same IEEE steps in every engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def ratio(a: Column, b: Column, digits: int) -> Column:
    """``a / b`` rounded by :func:`r`; over zero an infinity or NaN as in SQL, where Spark's division is an error."""
    over_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, over_zero).otherwise(r(a / b, digits))


def series(*order: str):
    """Rows of a symbol in bar order."""
    return Window.partitionBy("symbol").orderBy(*(order or ("idx",)))


def trailing(n: int, skip: int = 0):
    """The last ``n`` bars up to ``skip`` bars back."""
    return series().rowsBetween(-(n - 1) - skip, -skip)


#: Prices are averaged as whole millionths, so that a mean is the same in any order of summation and equal to a price that it equals.
TICKS = 10**6


def exact_mean(column: str, frame) -> Column:
    """The mean of a price over a window frame, from one integer sum and one division."""
    ticks = F.round(F.col(column) * TICKS).cast("long")
    return F.sum(ticks).over(frame).cast("double") / (F.count(column).over(frame) * float(TICKS))


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
