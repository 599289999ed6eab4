"""Column expressions shared by the operators.  All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import (
    DEFAULT_HEIGHT_CM,
    DEFAULT_SESSION_HOURS,
    EPSILON,
    MIN_SESSION_HOURS,
)

__all__ = [
    "bmi_from",
    "category_weight",
    "clip",
    "col",
    "cell",
    "has_text",
    "half_even_int",
    "logistic",
    "meets",
    "null_if_nan",
    "numeric_columns",
    "ratio",
    "round4",
    "safe_div",
    "same_entity",
    "session_hours",
    "weekly_share",
]


def cell(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col(f"`{name}`")


def col(c: Column | str) -> Column:
    return cell(c) if isinstance(c, str) else c


def ratio(top: Column | str, bottom: Column | str, eps: float = EPSILON) -> Column:
    """``top / (bottom + eps)``: a zero baseline gives a huge finite number, not an error."""
    return col(top) / (col(bottom) + F.lit(eps))


def safe_div(top: Column, bottom: Column, when_zero: float | None = None) -> Column:
    out = F.try_divide(top, bottom)
    return out if when_zero is None else F.coalesce(out, F.lit(when_zero))


def weekly_share(load_30d: Column | str) -> Column:
    """Chronic load expressed per week."""
    return col(load_30d) / F.lit(30.0) * F.lit(7.0)


def same_entity(df: DataFrame, key: str, entity: str | int) -> Column:
    """Rows whose key reads as the given text.

    For whole-number keys the comparison stays on the stored type, so it reaches the
    scan; text that is no such number matches nothing.
    """
    text = str(entity)
    if isinstance(df.schema[key].dataType, T.IntegralType):
        digits = text[1:] if text.startswith("-") else text
        plain = digits.isascii() and digits.isdigit() and str(int(text)) == text
        return cell(key) == F.lit(int(text)) if plain else F.lit(False)
    return cell(key).cast("string") == F.lit(text)


def session_hours(
    start: Column | None, end: Column | None, floor: float = MIN_SESSION_HOURS
) -> Column:
    """Session length with a floor; unknown stays unknown, absent columns mean a default."""
    if start is None or end is None:
        return F.lit(DEFAULT_SESSION_HOURS)
    length = end - start
    return F.when(length.isNotNull(), F.greatest(length, F.lit(floor)))


def category_weight(text: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    """Weight of a category by its whole lower-cased text."""
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(text)), F.lit(default))


def has_text(text: Column, part: str) -> Column:
    """True where the lower-cased text contains ``part``; null counts as no."""
    return F.coalesce(F.lower(text).contains(part), F.lit(False))


def bmi_from(weight: Column, height_cm: Column, default_height: float = DEFAULT_HEIGHT_CM) -> Column:
    meters = F.coalesce(height_cm, F.lit(default_height)) / F.lit(100.0)
    return weight / (meters * meters)


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """Bound a value; null stays null (``greatest``/``least`` alone would skip it)."""
    out = x
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.when(x.isNotNull(), out)


def half_even_int(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def round4(x: Column) -> Column:
    return F.bround(x, 4)


def meets(p: Column, cutoff: float | Column) -> Column:
    """1 where the score reaches the cutoff, else 0."""
    bar = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    return (p >= bar).cast("int")


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
