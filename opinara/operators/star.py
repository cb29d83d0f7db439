"""Dimensions and fact out of canonical reviews.

Keys are digests of the natural key, so a fact row computes its foreign keys by itself: loading needs no join
and repeating it gives the same keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.sources.files import ORDER
from opinara.sources.warehouse import conform

_PART = "\u001f"
_NO_CITY = "\u001e"


def name_key(name: Column) -> Column:
    return F.sha2(name, 256)


def business_key(name: Column, city: Column) -> Column:
    return F.sha2(F.concat_ws(_PART, F.coalesce(name, F.lit("Unknown")), F.coalesce(city, F.lit(_NO_CITY))), 256)


def build_cities(rows: DataFrame) -> DataFrame:
    names = rows.select(F.col("city").alias("city_name")).where("city_name IS NOT NULL").distinct()
    return conform(names.withColumn("city_id", name_key(F.col("city_name"))), "cities")


def build_categories(rows: DataFrame) -> DataFrame:
    names = rows.select(F.col("category").alias("category_name")).where("category_name IS NOT NULL").distinct()
    return conform(names.withColumn("category_id", name_key(F.col("category_name"))), "categories")


def build_businesses(rows: DataFrame) -> DataFrame:
    """One business per name and city; the first review read decides category, position and foreign id.

    The first aggregation leaves one row per distinct combination, in plain hash buffers; only those few meet
    the second one, which picks the earliest.
    """
    details = ["category", "latitude", "longitude", "external_id", "source"]
    combos = (
        rows.select(
            F.coalesce("business_name", F.lit("Unknown")).alias("name"), "city", "category", "latitude", "longitude",
            F.col("business_id").alias("external_id"), "source", ORDER,
        )
        .groupBy("name", "city", *details)
        .agg(F.min(ORDER).alias(ORDER))
    )
    first = combos.groupBy("name", "city").agg(F.min_by(F.struct(*details), ORDER).alias("first"))
    return conform(
        first.select(
            business_key(F.col("name"), F.col("city")).alias("business_id"), "name",
            name_key(F.col("city")).alias("city_id"), name_key(F.col("first.category")).alias("category_id"),
            "first.latitude", "first.longitude", "first.external_id", "first.source",
        ),
        "businesses",
    )


def build_reviews(rows: DataFrame) -> DataFrame:
    """Fact rows; scores come along when the rows have them."""
    return conform(
        rows.withColumns(
            {
                "business_id": business_key(F.col("business_name"), F.col("city")),
                "review_date": F.col("date").cast("date"),
                "review_year": F.year("date"),
                "review_month": F.month("date"),
            }
        ),
        "reviews",
    )
