"""Summaries that keep every business and city, with or without reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.rollup import SUMS, average, per_business, share
from opinara.plans import trends
from opinara.sources.warehouse import Star


def _all_businesses(star: Star) -> DataFrame:
    """Every business with its sums, zero where it has no reviews."""
    counts = [c for c in SUMS if c != "rating_sum"]
    return star.businesses.select("business_id", "name", "city_id", "category_id").join(
        per_business(star.reviews), "business_id", "left"
    ).na.fill(0, subset=counts)


def business_summary(star: Star) -> DataFrame:
    return (
        _all_businesses(star)
        .join(star.cities.select("city_id", "city_name"), "city_id", "left")
        .join(star.categories.select("category_id", "category_name"), "category_id", "left")
        .select(
            "business_id", "name", "city_name", "category_name", F.col("reviews").alias("total_reviews"),
            average(2).alias("average_rating"), F.col("positive").alias("positive_reviews"),
            F.col("negative").alias("negative_reviews"), share("positive", 2).alias("positive_pct"),
        )
    )


def city_summary(star: Star) -> DataFrame:
    per_city = (
        _all_businesses(star)
        .where("city_id IS NOT NULL")
        .groupBy("city_id")
        .agg(*[F.sum(c).alias(c) for c in SUMS], F.count("*").alias("total_businesses"))
    )
    return (
        star.cities.select("city_id", "city_name")
        .join(per_city, "city_id", "left")
        .na.fill(0, subset=["total_businesses", "reviews", "rated"])
        .select(
            "city_name", "total_businesses", F.col("reviews").alias("total_reviews"),
            average(2).alias("average_rating"), share("positive", 2).alias("positive_pct"),
        )
    )


def monthly_trends(star: Star) -> DataFrame:
    return trends.months(star).select(
        "review_year", "review_month", "year_month", F.col("reviews").alias("total_reviews"),
        average(2).alias("average_rating"), share("positive", 2).alias("positive_pct"),
        share("negative", 2).alias("negative_pct"),
    )


def city_map(star: Star) -> DataFrame:
    """Cities with a position, their average and number of reviews."""
    placed = star.cities.where("latitude IS NOT NULL").select("city_id", "city_name", "latitude", "longitude")
    return (
        per_business(star.reviews)
        .join(star.businesses.select("business_id", "city_id"), "business_id")
        .groupBy("city_id")
        .agg(*[F.sum(c).alias(c) for c in SUMS])
        .join(placed, "city_id")
        .select("city_name", "latitude", "longitude", average(2).alias("avg_rating"),
                F.col("reviews").alias("review_count"))
    )


def register_views(star: Star) -> None:
    business_summary(star).createOrReplaceTempView("vw_business_summary")
    city_summary(star).createOrReplaceTempView("vw_city_summary")
    monthly_trends(star).createOrReplaceTempView("vw_monthly_trends")
