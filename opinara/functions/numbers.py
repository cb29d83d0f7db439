"""Numeric column expressions shared by the analytics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara import settings


def maybe_round(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def percent(part: Column, whole: Column, digits: int | None) -> Column:
    """``part`` of ``whole`` in percent; null when there is nothing to divide by."""
    return maybe_round(F.try_divide(F.lit(100.0) * part, whole), digits)


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(value: Column) -> Column:
    """Double value of a text that is written as a decimal number; null where it is none."""
    text = value.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def is_valid_rating(value: Column) -> Column:
    """True for a number between the limits; null and NaN give false."""
    number = to_number(value)
    return F.coalesce(number.between(settings.RATING_MIN, settings.RATING_MAX), F.lit(False))


_UNITS = 1_000_000


def rating_units(value: Column) -> Column:
    """The rating in whole millionths. Sums of whole numbers do not depend on the order in which partial sums
    arrive, so an aggregate that is computed again after a lost executor is the same to the last bit; and adding
    them costs no more than adding doubles."""
    return F.floor(value * _UNITS + 0.5)


def mean_rating(total: Column, count: Column, digits: int | None) -> Column:
    """Average of ``count`` ratings from their total in millionths; null when there are none."""
    return maybe_round(F.try_divide(total.cast("double"), count * _UNITS), digits)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def rating_band(value: Column) -> Column:
    """Gauge band of a rating: up to 2, up to 3.5, up to 5."""
    return (
        F.when(value.isNull() | (value < 0) | (value > 5), None)
        .when(value < 2, "low")
        .when(value < 3.5, "medium")
        .otherwise("high")
    )


def sentiment_label(compound: Column) -> Column:
    return (
        F.when(compound >= settings.POSITIVE_FROM, settings.POSITIVE)
        .when(compound <= settings.NEGATIVE_TO, settings.NEGATIVE)
        .otherwise(settings.NEUTRAL)
    )
