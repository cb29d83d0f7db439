"""Single businesses: profile, comparison, reviews to read, and the name lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.dates import year_month
from opinara.functions.numbers import rating_band
from opinara.operators.rollup import average, per_business, per_month, regroup, share
from opinara.sources.sampling import draw
from opinara.sources.warehouse import Star


def _named(star: Star, names: Sequence[str], city: str | None = None) -> DataFrame:
    """Ids of the businesses with one of the names, found before the reviews are read."""
    found = star.businesses.where(F.col("name").isin(list(names)))
    if city is not None:
        found = found.join(star.cities.where(F.col("city_name") == city).select("city_id"), "city_id", "left_semi")
    return found.select("business_id", "name")


def profiles(star: Star, names: Sequence[str], city: str | None = None) -> DataFrame:
    """Measures per name; businesses of one name in several cities are taken together."""
    rows = per_business(star.reviews.join(_named(star, names, city), "business_id", "left_semi"))
    return regroup(rows.join(_named(star, names, city), "business_id"), "name").select(
        "name", average(2).alias("avg_rating"), F.col("reviews").alias("review_count"),
        share("positive").alias("positive_pct"), share("negative").alias("negative_pct"),
        share("neutral").alias("neutral_pct"),
    )


def profile(star: Star, name: str, city: str | None = None) -> DataFrame:
    return profiles(star, [name], city)


def profile_trend(star: Star, name: str, city: str | None = None) -> DataFrame:
    rows = star.reviews.join(_named(star, [name], city), "business_id", "left_semi")
    return (
        per_month(rows)
        .select(
            year_month(F.col("review_year"), F.col("review_month")).alias("year_month"),
            average(2).alias("avg_rating"), F.col("reviews").alias("review_count"),
        )
        .orderBy("year_month")
    )


def comparison(star: Star, names: Sequence[str]) -> DataFrame:
    """Feature vector per compared business, each feature from 0 to 100; as many rows as names."""
    rows = profiles(star, names).na.fill(0)
    most = F.greatest(F.max("review_count").over(Window.partitionBy()), F.lit(1))
    return rows.select(
        "name",
        (F.col("avg_rating") / 5 * 100).alias("rating_score"),
        F.col("positive_pct").alias("positive_score"),
        (F.col("review_count") / most * 100).alias("volume_score"),
        (100 - F.col("negative_pct")).alias("negative_free_score"),
        F.least(F.col("review_count") / 50, F.lit(100.0)).alias("engagement_score"),
    )


def rating_gap(star: Star, first: str, second: str) -> DataFrame:
    """Both averages and numbers of reviews in one row, with the difference of the averages."""
    both = profiles(star, [first, second])

    def of(name: str, column: str):
        return F.max(F.when(F.col("name") == name, F.col(column)))

    return both.agg(
        of(first, "avg_rating").alias("first_avg"), of(second, "avg_rating").alias("second_avg"),
        of(first, "review_count").alias("first_reviews"), of(second, "review_count").alias("second_reviews"),
    ).withColumn("rating_gap", F.round(F.col("first_avg") - F.col("second_avg"), 2))


def sentiment_breakdown(star: Star, names: Sequence[str]) -> DataFrame:
    """Label shares per compared business, one row each."""
    shares = profiles(star, names).select(
        "name", F.col("positive_pct").alias("Positive"), F.col("neutral_pct").alias("Neutral"),
        F.col("negative_pct").alias("Negative"),
    )
    return shares.na.fill(0).unpivot("name", ["Positive", "Neutral", "Negative"], "sentiment", "pct")


def bands(star: Star) -> DataFrame:
    """Number of businesses per rating band of their average."""
    rows = per_business(star.reviews).withColumn("band", rating_band(average(2)))
    return rows.where("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("businesses"))


def sample_reviews(
    star: Star, sentiment: str | None = None, business_name: str | None = None, city_name: str | None = None,
    limit: int = 20, seed: int | None = None,
) -> DataFrame:
    """A few random reviews that meet all conditions given, always the same ones for a seed.

    Only reviews of known businesses are drawn from, every task keeping ``limit`` rows; the names are joined to the
    drawn rows.
    """
    rows = star.reviews
    if sentiment:
        rows = rows.where(F.col("sentiment_label") == sentiment)
    businesses = star.businesses.join(star.cities.select("city_id", "city_name"), "city_id", "left").select(
        "business_id", F.col("name").alias("business_name"), "city_name"
    )
    for column, value in {"business_name": business_name, "city_name": city_name}.items():
        if value:
            businesses = businesses.where(F.col(column) == value)
    rows = rows.join(businesses.select("business_id"), "business_id", "left_semi")
    drawn = rows.orderBy(F.rand() if seed is None else draw(F.col("review_id"), seed)).limit(limit)
    return drawn.join(businesses, "business_id").select(
        "business_name", "city_name", "rating", "sentiment_label", "review_text", "review_date"
    )


def business_names(star: Star) -> DataFrame:
    return star.businesses.select("name").distinct().orderBy("name")


def city_names(star: Star) -> DataFrame:
    return star.cities.select("city_name").orderBy("city_name")


def category_names(star: Star) -> DataFrame:
    return star.categories.select("category_name").orderBy("category_name")
