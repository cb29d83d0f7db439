"""Partial sums that every rating and sentiment query is read from.

Reviews are first summed per business (or month), on the map side as far as possible; dimensions are joined to
those few rows, and coarser results add the sums up again. Averages and shares are taken last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions.numbers import flag, mean_rating, percent, rating_units

LABELS = {"positive": settings.POSITIVE, "neutral": settings.NEUTRAL, "negative": settings.NEGATIVE}
SUMS = ["rating_sum", "rated", "reviews", *LABELS]


def sums(reviews: DataFrame, *keys: str | Column) -> DataFrame:
    return reviews.groupBy(*keys).agg(
        F.sum(rating_units(F.col("rating"))).alias("rating_sum"),
        F.count("rating").alias("rated"),
        F.count("*").alias("reviews"),
        *[F.sum(flag(F.col("sentiment_label") == label)).alias(name) for name, label in LABELS.items()],
    )


def per_business(reviews: DataFrame, *extra: str) -> DataFrame:
    return sums(reviews, *extra, "business_id")


def per_month(reviews: DataFrame, *extra: str) -> DataFrame:
    return sums(reviews.where("review_year IS NOT NULL"), *extra, "review_year", "review_month")


def regroup(partial: DataFrame, *keys: str | Column) -> DataFrame:
    """Adds partial sums up to coarser keys. ``businesses`` counts the businesses behind them."""
    businesses = F.sum("businesses") if "businesses" in partial.columns else F.count("*")
    return partial.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS], businesses.alias("businesses"))


def average(digits: int | None = 2) -> Column:
    return mean_rating(F.col("rating_sum"), F.col("rated"), digits)


def share(label: str, digits: int | None = 1) -> Column:
    return percent(F.col(label), F.col("reviews"), digits)


def named(partial: DataFrame, businesses: DataFrame) -> DataFrame:
    """Per-business sums with the business's name and dimension keys."""
    return partial.join(
        businesses.select("business_id", F.col("name").alias("business_name"), "city_id", "category_id"), "business_id"
    )


def add_names(rows: DataFrame, dimension: DataFrame, key: str, name: str, how: str = "inner") -> DataFrame:
    """Dimension names by key. How the join is run is left to the sizes Spark sees."""
    return rows.join(dimension.select(key, name), key, how)


def by_name(rows: DataFrame, dimension: DataFrame, key: str, name: str, *keys: str) -> DataFrame:
    """Sums per dimension name, which is unique. They are added up per key before: a city with most of the businesses
    is one row by the time it meets its name."""
    return add_names(regroup(rows.where(F.col(key).isNotNull()), *keys, key), dimension, key, name)
