import datetime as dt

import pytest
from pyspark.sql import functions as F

from opinara.plans import businesses, ratings, trends, views
from tests.star_fixture import make_star

REVIEWS = [
    ("b1", 5.0, "2024-01-05", "Positive"), ("b1", 4.0, "2024-01-06", "Positive"), ("b1", 1.0, "2024-06-01", "Negative"),
    ("b2", 2.0, "2024-02-01", "Negative"), ("b2", 3.0, None, "Neutral"), ("b4", 4.5, "2024-02-02", None),
    ("b5", 5.0, "2024-06-02", "Positive"),
]


@pytest.fixture(scope="module")
def star(spark):
    return make_star(spark, REVIEWS)


@pytest.fixture(scope="module")
def empty(spark):
    return make_star(spark)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_kpis(star, empty):
    assert rows(ratings.kpi_summary(star)) == [(7, 3.5, 42.9, 28.6, 14.3, 5, 3)]
    assert rows(ratings.kpi_summary(empty)) == [(0, None, None, None, None, 5, 3)]
    assert rows(ratings.overall_average(empty)) == [(None,)]
    assert rows(ratings.scored_counts(star)) == [(7, 6)]


def test_empty_tables(empty):
    for plan in (
        ratings.rating_distribution, ratings.average_by_city, ratings.top_businesses, ratings.needs_attention,
        ratings.above_city_average, ratings.business_rank, ratings.rank_in_city, ratings.city_quartiles,
        ratings.best_city_per_category, trends.monthly_volume, trends.growth, trends.running_average,
        ratings.sentiment_counts, views.monthly_trends, views.city_map, businesses.bands,
    ):
        assert rows(plan(empty)) == [], plan.__name__


def test_distribution_truncates(star):
    assert rows(ratings.rating_distribution(star)) == [(1, 1, 14.29), (2, 1, 14.29), (3, 1, 14.29), (4, 2, 28.57), (5, 2, 28.57)]


def test_minimum_counts(star):
    assert rows(ratings.average_by_city(star, min_reviews=2)) == [("Ankara", 3.0, 5)]
    assert rows(ratings.average_by_city(star, min_reviews=1), "city_name") == [("Bursa",), ("Ankara",)]
    assert rows(ratings.average_by_city(star, min_reviews=1, limit=1), "city_name") == [("Bursa",)]
    assert rows(ratings.average_by_city(star, min_reviews=6)) == []


def test_outer_and_inner_dimensions(star):
    top = rows(ratings.top_businesses(star, min_reviews=1), "business_name", "city_name", "category_name")
    assert ("Delta", None, None) in top
    inner = rows(ratings.extreme_businesses_with_city(star, min_reviews=1), "business_name")
    assert ("Delta",) not in inner and inner[0] == ("Alpha",)


def test_rounded_threshold(spark):
    star = make_star(spark, [("b1", 3.0, None, None)] * 63 + [("b1", 4.0, None, None)] * 62)  # 3.496
    assert rows(ratings.needs_attention(star)) == []
    assert rows(ratings.needs_attention(star, threshold=3.51), "avg_rating") == [(3.5,)]


def test_above_city_average(star):
    assert rows(ratings.above_city_average(star), "name", "b_avg") == [("Alpha", 3.33)]


def test_rank_ties(spark):
    star = make_star(spark, [("b1", 4.0, None, None), ("b2", 4.0, None, None), ("b3", 2.0, None, None), ("b5", 4.0, None, None)])
    got = {r[0]: r[1] for r in rows(ratings.business_rank(star, 1), "business_id", "rating_rank")}
    assert got == {"b1": 1, "b2": 1, "b5": 1, "b3": 2}
    got = {r[0]: r[1] for r in rows(ratings.rank_in_city(star, 1), "business_id", "city_rank")}
    assert got == {"b1": 1, "b2": 1, "b5": 1, "b3": 2}
    best = rows(ratings.best_city_per_category(star, 1), "category_name", "city_name")
    assert sorted(best) == [("Cafe", "Ankara"), ("Hotel", "Ankara"), ("Hotel", "Bursa")]


def test_declining(star):
    as_of = F.lit(dt.date(2024, 7, 1))
    got = rows(ratings.declining_businesses(star, as_of, min_reviews=1, months=2),
               "business_name", "all_time_avg", "recent_avg", "rating_change")
    assert got == [("Alpha", 3.33, 1.0, -2.33)]
    assert rows(ratings.declining_businesses(star, F.lit(dt.date(2030, 1, 1)), min_reviews=1)) == []


def test_growth_uses_the_month_before_that_has_reviews(star):
    assert rows(trends.growth(star)) == [
        ("2024-01", 2, None, None), ("2024-02", 2, 2, 0.0), ("2024-06", 2, 2, 0.0),
    ]


def test_running_average(star):
    got = rows(trends.running_average(star, window=2))
    assert got == [("2024-01", 4.5, 4.5), ("2024-02", 3.25, 3.875), ("2024-06", 3.0, 3.125)]


def test_views_keep_everything(star, empty):
    summary = {r["business_id"]: r for r in views.business_summary(star).collect()}
    assert summary["b3"]["total_reviews"] == 0 and summary["b3"]["average_rating"] is None
    assert summary["b3"]["positive_pct"] is None and summary["b3"]["positive_reviews"] == 0
    cities = {r["city_name"]: tuple(r) for r in views.city_summary(star).collect()}
    assert cities["Ceyhan"] == ("Ceyhan", 0, 0, None, None)
    assert cities["Bursa"] == ("Bursa", 2, 1, 5.0, 100.0)
    assert {r["total_reviews"] for r in views.city_summary(empty).collect()} == {0}
    assert rows(views.city_map(star)) == [("Ankara", 39.9, 32.8, 3.0, 5)]


def test_profile_merges_equal_names(star):
    assert rows(businesses.profile(star, "Alpha")) == [("Alpha", 3.75, 4, 75.0, 25.0, 0.0)]
    assert rows(businesses.profile(star, "Alpha", city="Bursa"), "review_count") == [(1,)]
    assert rows(businesses.profile(star, "nobody")) == []
    assert rows(businesses.profile_trend(star, "Alpha")) == [("2024-01", 4.5, 2), ("2024-06", 3.0, 2)]


def test_comparison(star):
    got = {r["name"]: r for r in businesses.comparison(star, ["Alpha", "Beta"]).collect()}
    assert tuple(got["Alpha"])[1:] == pytest.approx((75.0, 75.0, 100.0, 75.0, 4 / 50))
    assert tuple(got["Beta"])[1:] == pytest.approx((50.0, 0.0, 50.0, 50.0, 2 / 50))
    assert tuple(businesses.rating_gap(star, "Alpha", "Beta").first()) == (3.75, 2.5, 4, 2, 1.25)
    shares = {(r["name"], r["sentiment"]): r["pct"] for r in businesses.sentiment_breakdown(star, ["Alpha", "Beta"]).collect()}
    assert shares[("Beta", "Neutral")] == 50.0 and len(shares) == 6


def test_sample_reviews(star):
    assert businesses.sample_reviews(star, limit=3).count() == 3
    got = rows(businesses.sample_reviews(star, sentiment="Positive", business_name="Alpha", city_name="Ankara"), "rating")
    assert sorted(got) == [(4.0,), (5.0,)]
    assert businesses.sample_reviews(star, seed=1).count() == 7
    assert rows(businesses.sample_reviews(star, sentiment="none")) == []


def test_names(star):
    assert rows(businesses.business_names(star)) == [("Alpha",), ("Beta",), ("Delta",), ("Gamma",)]
    assert rows(businesses.city_names(star)) == [("Ankara",), ("Bursa",), ("Ceyhan",)]
    assert rows(businesses.category_names(star)) == [("Cafe",), ("Hotel",)]


def test_shares_add_up(star):
    assert sum(r["pct"] for r in ratings.sentiment_counts(star).collect()) == pytest.approx(100, abs=0.05)
    labelled = ratings.sentiment_counts(star, digits=None, labelled_only=True).collect()
    assert sum(r["pct"] for r in labelled) == pytest.approx(100)
    total = sum(r["review_count"] for r in ratings.city_performance(star, 1).collect())
    assert total == 6
