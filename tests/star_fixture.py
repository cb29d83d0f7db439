"""A small hand-made star."""

from opinara.sources.warehouse import Star


def make_star(spark, reviews=(), businesses=None, keywords=()):
    """``reviews``: (business_id, rating, date text or None, label or None)."""
    businesses = businesses or [
        ("b1", "Alpha", "c1", "k1"), ("b2", "Beta", "c1", "k2"), ("b3", "Gamma", "c2", "k1"), ("b4", "Delta", None, None),
        ("b5", "Alpha", "c2", "k2"),
    ]
    rows = []
    for i, (business, rating, day, label) in enumerate(reviews):
        year, month = (int(day[:4]), int(day[5:7])) if day else (None, None)
        rows.append((f"r{i}", business, rating, f"text {i}", day, year, month, "google_maps", label))
    review_df = spark.createDataFrame(
        rows,
        "review_id string, business_id string, rating double, review_text string, day string, review_year int, "
        "review_month int, source string, sentiment_label string",
    ).selectExpr("*", "cast(day as date) as review_date").drop("day")
    return Star(
        cities=spark.createDataFrame(
            [("c1", "Ankara", 39.9, 32.8), ("c2", "Bursa", None, None), ("c3", "Ceyhan", 37.0, 35.8)],
            "city_id string, city_name string, latitude double, longitude double",
        ),
        categories=spark.createDataFrame([("k1", "Cafe"), ("k2", "Hotel")], "category_id string, category_name string"),
        businesses=spark.createDataFrame(
            businesses, "business_id string, name string, city_id string, category_id string"
        ),
        reviews=review_df,
        keywords=spark.createDataFrame(
            [(str(i), f"r{i}", c, c) for i, c in enumerate(keywords)],
            "keyword_id string, review_id string, keyword string, complaint_category string",
        ),
    )
