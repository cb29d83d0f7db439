"""The canonical review frame and the star schema."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

S, D, I, DT = T.StringType(), T.DoubleType(), T.IntegerType(), T.DateType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


ROLES = {
    "rating": D,
    "review_text": S,
    "business_name": S,
    "city": S,
    "category": S,
    "date": S,
    "latitude": D,
    "longitude": D,
    "business_id": S,
    "state": S,
}

CITIES = _struct(
    ("city_id", S, False), ("city_name", S, False), ("state", S, True), ("country", S, True),
    ("latitude", D, True), ("longitude", D, True),
)
CATEGORIES = _struct(("category_id", S, False), ("category_name", S, False))
BUSINESSES = _struct(
    ("business_id", S, False), ("external_id", S, True), ("name", S, False), ("city_id", S, True),
    ("category_id", S, True), ("address", S, True), ("latitude", D, True), ("longitude", D, True),
    ("source", S, False),
)
REVIEWS = _struct(
    ("review_id", S, False), ("business_id", S, False), ("rating", D, False), ("review_text", S, True),
    ("review_date", DT, True), ("review_year", I, True), ("review_month", I, True), ("source", S, False),
    ("sentiment_compound", D, True), ("sentiment_positive", D, True), ("sentiment_neutral", D, True),
    ("sentiment_negative", D, True), ("sentiment_label", S, True),
)
KEYWORDS = _struct(
    ("keyword_id", S, False), ("review_id", S, False), ("keyword", S, False), ("complaint_category", S, True),
    ("source", S, True),
)
TABLES = {
    "cities": CITIES, "categories": CATEGORIES, "businesses": BUSINESSES, "reviews": REVIEWS,
    "keywords": KEYWORDS,
}
#: Every platform has folders of its own, so one is loaded again without touching the others.
PARTITION_COLUMNS = {"businesses": ["source"], "reviews": ["source", "review_year"], "keywords": ["source"]}


def create_tables(spark: SparkSession, location: str) -> None:
    """Declare the five tables over the Parquet folders below ``location``; existing ones stay. A business that several
    platforms know has a row per platform here; :func:`opinara.sources.warehouse.read_table` merges them."""
    for name, schema in TABLES.items():
        if not spark.catalog.tableExists(name):
            keys = PARTITION_COLUMNS.get(name, [])
            plain = [f for f in schema.fields if f.name not in keys]
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain + [schema[k] for k in keys])
            parts = f"PARTITIONED BY ({', '.join(keys)})" if keys else ""
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts} LOCATION '{location}/{name}'")
