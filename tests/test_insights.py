from opinara.plans import insights
from tests.star_fixture import make_star


def findings(star, **options):
    return [tuple(r)[1:] for r in insights.insights(star, **options).collect()]


def test_every_rule(spark):
    reviews = (
        [("b1", 5.0, "2024-01-01", "Positive")] * 2
        + [("b1", 5.0, "2024-02-01", "Positive")] * 2
        + [("b1", 5.0, "2024-03-01", "Neutral")] * 2
        + [("b5", 2.0, "2024-04-01", "Negative")] * 2
        + [("b5", 2.0, "2024-05-01", "Negative")] * 3
        + [("b5", 2.0, "2024-06-01", "Negative")] * 4
    )
    star = make_star(spark, reviews, keywords=["Service", "Service", "Parking"])
    got = findings(star)
    assert [(r[0], r[1], r[2]) for r in got] == [
        (1, "critical", "High Negative Sentiment Alert"),
        (2, "warning", "1 Business Need Attention"),
        (3, "warning", "Cities Below National Average"),
        (4, "success", "Top Performing Cities"),
        (5, "warning", "Top Complaint: Service"),
        (6, "info", "Cafe Outperforms Others"),
        (7, "success", "Growing Review Volume"),
    ]
    details = {r[0]: r[3] for r in got}
    assert details[1].startswith("60.0% of reviews are negative.")
    assert details[2] == (
        "1 businesses have an average rating below 3.5★. The lowest-rated is 'Alpha' (2.0★ across 9 reviews)."
    )
    assert details[3] == (
        "Bursa has average ratings (2.00★) significantly below the national average of 3.20★."
    )
    assert details[4] == "Ankara is performing above the national average with ratings of 5.00★."
    assert details[5].startswith("'Service' accounts for 66.7% of all negative feedback")
    assert details[6] == "'Cafe' category leads with 5.00★, while 'Hotel' lags at 2.00★ — a gap of 3.00 stars."
    assert details[7].startswith("Recent review volume is 50% higher")
    actions = [tuple(r) for r in insights.recommendations(insights.insights(star)).orderBy("rule_order").collect()]
    assert [a[1] for a in actions] == [1, 2, 3, 4, 5, 6, 7]
    assert actions[4][2].startswith("Prioritise improvements to service experience.")


def test_quiet_star(spark):
    star = make_star(spark, [("b1", 4.0, "2024-01-01", "Positive"), ("b2", 4.0, "2024-02-01", "Neutral")] * 5)
    assert [r[0] for r in findings(star)] == [6]
    assert findings(make_star(spark)) == []


def test_sentiment_levels(spark):
    def level(positive, negative):
        labels = ["Positive"] * positive + ["Negative"] * negative + ["Neutral"] * (10 - positive - negative)
        star = make_star(spark, [("b4", 4.0, None, label) for label in labels])
        return [(r[1], r[2]) for r in findings(star) if r[0] == 1]

    assert level(7, 3) == [("success", "Strong Positive Sentiment")]
    assert level(6, 3) == [("critical", "High Negative Sentiment Alert")]
    assert level(6, 2) == [("warning", "Elevated Negative Feedback")]
    assert level(6, 1) == []


def test_declining_volume(spark):
    months = [("2024-01-01", 5), ("2024-02-01", 5), ("2024-03-01", 5), ("2024-04-01", 1), ("2024-05-01", 1), ("2024-06-01", 1)]
    star = make_star(spark, [("b4", 4.0, day, None) for day, n in months for _ in range(n)])
    trend = [r for r in findings(star) if r[0] == 7]
    assert trend[0][2:4] == (
        "Declining Review Activity", "Recent review volume has dropped by 80% compared to earlier periods.",
    )
    short = make_star(spark, [("b4", 4.0, day, None) for day, n in months[:2] for _ in range(n)])
    assert [r for r in findings(short) if r[0] == 7] == []


def test_by_group(spark):
    star = make_star(spark, [("b1", 1.0, None, "Negative")] * 5 + [("b2", 5.0, None, "Positive")] * 5, keywords=["Service"] * 6)
    got = insights.insights(star, by="sentiment_label").collect()
    assert {(r["scope"], r["title"]) for r in got} == {
        ("Negative", "High Negative Sentiment Alert"), ("Negative", "1 Business Need Attention"),
        ("Positive", "Strong Positive Sentiment"), ("Negative", "Top Complaint: Service"),
        ("Positive", "Top Complaint: Service"),
    }


def test_a_mean_of_averages_is_rounded_on_its_decimals(spark):
    pairs = [(a / 100, b / 100) for a in range(340, 360) for b in range(340, 360) if (a + b) % 2 and repr((a / 100 + b / 100) / 2).endswith("99999999997")]
    assert pairs  # means that end in 5, stored a little below
    cities = [(str(i), f"city {j}", rating, 5) for i, pair in enumerate(pairs) for j, rating in enumerate(pair)]
    rows = spark.createDataFrame(cities, "scope string, city_name string, avg_rating double, review_count long")
    overall = spark.createDataFrame([(str(i), 2.0) for i in range(len(pairs))], "scope string, national_avg double")
    got = {r.scope: r.detail for r in insights.city_gaps(rows, overall).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[str(i)].endswith(f"ratings of {(round(100 * a) + round(100 * b) + 1) / 200:.2f}★.")
