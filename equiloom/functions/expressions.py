"""Column helpers. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from operator import ge, gt, le, lt

from pyspark.sql import Column, functions as F

COMPARE = {">=": ge, ">": gt, "<=": le, "<": lt}


def ladder(value: Column, steps: Sequence[tuple], default=None, by: str = ">=") -> Column:
    """First step whose edge the value meets, else ``default``; NULL stays NULL.

    The value is rounded to nine places first, so that a ratio which is an edge on paper
    is an edge in floating point too.
    """
    value = F.round(value.cast("double"), 9)
    meets = COMPARE[by]
    result = F.when(value.isNull(), F.lit(None))
    for edge, outcome in steps:
        result = result.when(meets(value, F.lit(float(edge))), outcome)
    return result.otherwise(default)


def points(value: Column, steps: Sequence[tuple], default=0, by: str = ">=") -> Column:
    """A ladder whose missing values earn ``default`` points."""
    return F.coalesce(ladder(value, steps, default, by), F.lit(default)).cast("double")


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Bounds a value; NULL stays NULL although least and greatest skip it."""
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNotNull(), bounded)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL for a zero or missing denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def change(now: Column, before: Column) -> Column:
    return ratio(now, before) - 1


def holds(condition: Column) -> Column:
    """NULL conditions count as false."""
    return F.coalesce(condition, F.lit(False))


def as_int(condition: Column) -> Column:
    return holds(condition).cast("int")


def number(text: Column) -> Column:
    """Tolerant parse: separators, currency and percent signs go; placeholders are NULL."""
    bare = F.translate(F.trim(text), ",$%", "")
    usable = F.when(~F.upper(bare).isin("", "NONE", "N/A", "-", "NULL"), bare)
    return usable.try_cast("double")


def iso_date(text: Column) -> Column:
    """A date only when the text has the shape of one and names a real day."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date")


def sample_skew(value: Column) -> Column:
    """Bias-corrected skewness (Spark's own is the population moment)."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(value).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))


def compounded(returns: Column) -> Column:
    return F.product(1 + returns) - 1
