"""Ratings: totals, distribution, averages per city and category, best and worst businesses.

Where sums per business are compared with a statistic of themselves both sides are the same plan, so Spark reads the reviews
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions.numbers import flag, mean_rating, percent, rating_units
from opinara.operators import ranking
from opinara.operators.rollup import add_names, average, by_name, named, per_business, share, sums
from opinara.sources.warehouse import Star

MIN = settings.MIN_REVIEWS


def kpi_summary(star: Star) -> DataFrame:
    """One row: totals, average rating and label shares; null averages when there are no reviews."""
    return sums(star.reviews).select(
        F.col("reviews").alias("total_reviews"),
        average(2).alias("avg_rating"),
        share("positive").alias("positive_pct"),
        share("negative").alias("negative_pct"),
        share("neutral").alias("neutral_pct"),
        star.businesses.agg(F.count("*")).scalar().alias("total_businesses"),
        star.cities.agg(F.count("*")).scalar().alias("total_cities"),
    )


def overall_average(star: Star, digits: int = 3) -> DataFrame:
    return sums(star.reviews).select(average(digits).alias("national_avg"))


def scored_counts(star: Star) -> DataFrame:
    """How many reviews there are, and how many have a label."""
    return star.reviews.agg(
        F.count("*").alias("total_reviews"), F.count("sentiment_label").alias("scored_reviews")
    )


def rating_distribution(star: Star) -> DataFrame:
    """Reviews per whole star from 1 to 5, in percent of all reviews. One scan: whatever lies outside is counted
    in one extra group, which is then left out."""
    stars = F.when(F.col("rating").between(1, 5), F.col("rating").cast("int"))
    counts = star.reviews.groupBy(stars.alias("rating")).agg(F.count("*").alias("review_count"))
    whole = F.sum("review_count").over(Window.partitionBy())
    return (
        counts.withColumn("pct", percent(F.col("review_count"), whole, 2))
        .where("rating IS NOT NULL")
        .orderBy("rating")
    )


def rating_distribution_raw(star: Star) -> DataFrame:
    counts = star.reviews.groupBy(F.col("rating").cast("int").alias("rating")).agg(F.count("*").alias("review_count"))
    return counts.orderBy("rating")


def sentiment_counts(star: Star, digits: int | None = 2, labelled_only: bool = False) -> DataFrame:
    """Reviews per label, in percent of all of them (or of the labelled ones)."""
    rows = star.reviews.where("sentiment_label IS NOT NULL") if labelled_only else star.reviews
    counts = rows.groupBy("sentiment_label").agg(F.count("*").alias("count"))
    whole = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("pct", percent(F.col("count"), whole, digits))


def _by_dimension(star: Star, name: str) -> DataFrame:
    rows = named(per_business(star.reviews), star.businesses)
    if name == "city_name":
        return by_name(rows, star.cities, "city_id", name)
    return by_name(rows, star.categories, "category_id", name)


def _average_by(star: Star, name: str, min_reviews: int, limit: int | None) -> DataFrame:
    found = (
        _by_dimension(star, name)
        .where(F.col("rated") >= min_reviews)
        .select(name, average(2).alias("avg_rating"), F.col("rated").alias("review_count"))
        .orderBy(F.desc("avg_rating"), name)
    )
    return found if limit is None else found.limit(limit)


def average_by_city(star: Star, min_reviews: int = MIN, limit: int | None = 30) -> DataFrame:
    return _average_by(star, "city_name", min_reviews, limit)


def average_by_category(star: Star, min_reviews: int = MIN) -> DataFrame:
    return _average_by(star, "category_name", min_reviews, None)


def _performance(star: Star, name: str, min_reviews: int) -> DataFrame:
    return (
        _by_dimension(star, name)
        .where(F.col("reviews") >= min_reviews)
        .select(
            name, F.col("reviews").alias("review_count"), average(2).alias("avg_rating"),
            share("positive").alias("positive_pct"), share("negative").alias("negative_pct"),
            F.col("businesses").alias("business_count"),
        )
        .orderBy(F.desc("review_count"), name)
    )


def city_performance(star: Star, min_reviews: int = MIN) -> DataFrame:
    return _performance(star, "city_name", min_reviews)


def category_performance(star: Star, min_reviews: int = MIN) -> DataFrame:
    return _performance(star, "category_name", min_reviews)


def category_volume(star: Star, n: int = 15, min_reviews: int = MIN) -> DataFrame:
    """The categories with the most reviews."""
    found = _by_dimension(star, "category_name").where(F.col("rated") >= min_reviews)
    listed = found.select("category_name", average(2).alias("avg_rating"), F.col("rated").alias("review_count"))
    return listed.orderBy(F.desc("review_count"), "category_name").limit(n)


def positive_share_by_category(star: Star, min_reviews: int = 10) -> DataFrame:
    return (
        _by_dimension(star, "category_name")
        .where(F.col("reviews") >= min_reviews)
        .select("category_name", share("positive", None).alias("pos_pct"))
        .orderBy(F.desc("pos_pct"), "category_name")
    )


def _with_places(rows: DataFrame, star: Star, city: str = "left") -> DataFrame:
    placed = add_names(rows, star.cities, "city_id", "city_name", city)
    return add_names(placed, star.categories, "category_id", "category_name", "left")


def business_measures(star: Star, min_reviews: int) -> DataFrame:
    """Sums per business with at least ``min_reviews`` reviews, with its name. The filter runs before the join."""
    return named(per_business(star.reviews).where(F.col("reviews") >= min_reviews), star.businesses)


def _listed(rows: DataFrame, *measures: Column) -> DataFrame:
    return rows.select(
        "business_id", "business_name", "city_id", "category_id", average(2).alias("avg_rating"),
        F.col("reviews").alias("review_count"), *measures,
    )


_LIST = ["business_id", "business_name", "city_name", "category_name", "avg_rating", "review_count"]


def _first(rows: DataFrame, star: Star, n: int, order: list[Column], *measures: str) -> DataFrame:
    """The first ``n`` businesses; only those are joined to their city and category."""
    return _with_places(rows.orderBy(*order).limit(n), star).select(*_LIST, *measures).orderBy(*order)


def top_businesses(star: Star, n: int = 10, min_reviews: int = MIN) -> DataFrame:
    rows = _listed(business_measures(star, min_reviews), share("positive").alias("positive_pct"))
    order = [F.desc("avg_rating"), F.desc("review_count"), F.asc("business_name"), F.asc("business_id")]
    return _first(rows, star, n, order, "positive_pct")


def bottom_businesses(star: Star, n: int = 10, min_reviews: int = MIN) -> DataFrame:
    rows = _listed(business_measures(star, min_reviews), share("negative").alias("negative_pct"))
    order = [F.asc("avg_rating"), F.desc("negative_pct"), F.asc("business_name"), F.asc("business_id")]
    return _first(rows, star, n, order, "negative_pct")


def extreme_businesses_with_city(star: Star, best: bool = True, n: int = 10, min_reviews: int = 10) -> DataFrame:
    """The same for businesses that have a city, by rating alone."""
    rows = _listed(business_measures(star, min_reviews))
    placed = rows.join(star.cities.select("city_id"), "city_id", "left_semi")
    by_rating = F.desc("avg_rating") if best else F.asc("avg_rating")
    return _first(placed, star, n, [by_rating, F.asc("business_name"), F.asc("business_id")]).drop("category_name")


def needs_attention(star: Star, threshold: float = settings.RATING_ALERT, min_reviews: int = MIN) -> DataFrame:
    """Businesses whose rounded average lies below the threshold, worst first."""
    rows = _listed(business_measures(star, min_reviews), share("negative").alias("negative_pct"))
    low = _with_places(rows.where(F.col("avg_rating") < threshold), star).select(*_LIST, "negative_pct")
    return low.orderBy("avg_rating", "business_name", "business_id")


def above_city_average(star: Star) -> DataFrame:
    """Businesses rated above the average review of their city, both averages unrounded."""
    rows = business_measures(star, 0).where("city_id IS NOT NULL")
    city = rows.groupBy("city_id").agg(mean_rating(F.sum("rating_sum"), F.sum("rated"), None).alias("city_avg"))
    above = rows.join(add_names(city, star.cities, "city_id", "city_name"), "city_id").where(
        average(None) > F.col("city_avg")
    )
    return above.select("business_id", F.col("business_name").alias("name"), "city_name", average(2).alias("b_avg"))


def business_rank(star: Star, min_reviews: int = MIN) -> DataFrame:
    """All businesses ranked by rounded average; equal averages share a rank, no rank is left out."""
    rows = _listed(business_measures(star, min_reviews))
    ranked = add_names(
        ranking.dense_rank_of_levels(rows, "avg_rating", "rating_rank"), star.cities, "city_id", "city_name", "left"
    )
    columns = ["business_id", "business_name", "city_name", "avg_rating", "review_count", "rating_rank"]
    return ranked.select(*columns).orderBy("rating_rank", "business_name", "business_id")


def rank_in_city(star: Star, min_reviews: int = MIN) -> DataFrame:
    """Businesses ranked within their city by unrounded average."""
    rows = business_measures(star, min_reviews).where("city_id IS NOT NULL").select(
        "business_id", F.col("business_name").alias("name"), "city_id", average(None).alias("_avg")
    )
    ranked = ranking.rank_within(rows, "city_id", "_avg", "city_rank")
    return add_names(ranked, star.cities, "city_id", "city_name").select(
        "business_id", "city_name", "name", F.round("_avg", 2).alias("avg_rating"), "city_rank"
    )


def city_quartiles(star: Star, descending: bool = False) -> DataFrame:
    """Cities in four groups by number of reviews."""
    cities = _by_dimension(star, "city_name").select("city_name", F.col("reviews").alias("review_count"))
    tiled = ranking.tiles(cities, 4, "review_count", "city_name", "quartile", descending)
    return tiled.select("city_name", "review_count", "quartile").orderBy(F.desc("review_count"), "city_name")


def best_city_per_category(star: Star, min_reviews: int = MIN) -> DataFrame:
    """The city with the highest rounded average in each category; all of them where several share it.

    The maximum per category is an ordinary aggregate, so no task has to sort the cities of a category.
    """
    known = named(per_business(star.reviews), star.businesses).where("category_id IS NOT NULL")
    places = by_name(known, star.cities, "city_id", "city_name", "category_id")
    pairs = (
        add_names(places, star.categories, "category_id", "category_name")
        .where(F.col("reviews") >= min_reviews)
        .select("category_name", "city_name", average(2).alias("avg_rating"), F.col("reviews").alias("review_count"))
    )
    best = pairs.groupBy("category_name").agg(F.max("avg_rating").alias("avg_rating"))
    return (
        pairs.join(best, ["category_name", "avg_rating"])
        .select("category_name", "city_name", "avg_rating", "review_count", F.lit(1).cast("bigint").alias("rnk"))
        .orderBy(F.desc("avg_rating"), "category_name", "city_name")
    )


def declining_businesses(
    star: Star, as_of: Column, min_reviews: int = MIN, months: int = 6, digits: int | None = 2,
    limit: int | None = 20,
) -> DataFrame:
    """Businesses whose average of the last months lies below their overall average.

    Both averages come from one pass over the reviews. Undated reviews are not recent.
    """
    recent = F.col("review_date") >= F.add_months(as_of, -months)
    rating = rating_units(F.col("rating"))
    measured = (
        star.reviews.groupBy("business_id")
        .agg(
            F.sum(rating).alias("all_sum"), F.count("rating").alias("total_reviews"),
            F.sum(F.when(recent, rating)).alias("new_sum"), F.sum(flag(recent)).alias("new_count"),
        )
        .where((F.col("total_reviews") >= min_reviews) & (F.col("new_count") > 0))
        .select(
            "business_id", "total_reviews",
            mean_rating(F.col("all_sum"), F.col("total_reviews"), digits).alias("all_time_avg"),
            mean_rating(F.col("new_sum"), F.col("new_count"), digits).alias("recent_avg"),
        )
        .where(F.col("recent_avg") < F.col("all_time_avg"))
    )
    change = F.col("recent_avg") - F.col("all_time_avg")
    found = (
        measured.join(star.businesses.select("business_id", F.col("name").alias("business_name")), "business_id")
        .select(
            "business_id", "business_name", "all_time_avg", "recent_avg",
            (change if digits is None else F.round(change, digits)).alias("rating_change"), "total_reviews",
        )
        .orderBy("rating_change", "business_name", "business_id")
    )
    return found if limit is None else found.limit(limit)


