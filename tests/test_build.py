import csv
import datetime as dt

import pytest
from pyspark.sql import functions as F

from opinara.operators import cleaning, sentiment, star
from opinara.plans import build, feedback, ratings, views
from opinara.sources import files, warehouse
from opinara.sources.files import ORDER

HEADER = ["place_name", "place_category", "city", "review_rating", "review_text", "review_date", "latitude", "place_id"]
ROWS = [
    ["Kafe", "Cafe", "istanbul", "5", "Great food,\n“friendly” staff", "2024-01-10", "41.0", "g1"],
    ["Kafe", "Bar", "istanbul", "1", "Slow service, dirty", "2024-02-10", "", "g2"],
    ["Kafe", "Cafe", "istanbul", "1", "Slow service, dirty", "2024-02-10", "41.0", "g1"],
    ["Kafe", "Cafe", "istanbul", "1", "Slow service, dirty", "2024-02-10", "41.0", "g1"],
    ["Kafe", "Cafe", "ankara", "4", "<b>nice</b>", "2 hafta önce", "39.9", "g3"],
    ["Otel", "Hotel", "", "9", "bad", "2024-02-10", "", "g4"],
    ["Otel", "Hotel", "", "2", "terrible smell", "2024-02-11", "", "g4"],
    ["Otel", "Hotel", "", "2", "  ", "2024-02-11", "", "g4"],
]


@pytest.fixture()
def raw_folder(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    with open(folder / "reviews.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([HEADER, *ROWS])
    return str(folder)


def content(df):
    return sorted(map(str, df.collect()))


def test_build_and_rerun(spark, raw_folder, tmp_path):
    where = str(tmp_path / "star")
    assert not build.is_ready(spark, where)
    built = build.build(spark, raw_folder, where, preferred="reviews.csv", audit_path=str(tmp_path / "audit"), multi_line=True)
    assert build.is_ready(spark, where)

    assert sorted(r["city_name"] for r in built.cities.collect()) == ["Ankara", "Istanbul", "Unknown"]
    assert sorted(r["category_name"] for r in built.categories.collect()) == ["Bar", "Cafe", "Hotel"]
    rows = {(r["name"], r["city_name"]): r for r in built.businesses.join(built.cities.select("city_id", "city_name"), "city_id")
            .join(built.categories, "category_id").collect()}
    assert set(rows) == {("Kafe", "Istanbul"), ("Kafe", "Ankara"), ("Otel", "Unknown")}
    first = rows[("Kafe", "Istanbul")]
    assert (first["category_name"], first["external_id"], first["latitude"]) == ("Cafe", "g1", 41.0)

    reviews = built.reviews.collect()
    assert len(reviews) == 5
    great = next(r for r in reviews if r["rating"] == 5.0)
    assert great["review_text"] == 'Great food, "friendly" staff'
    assert (great["review_date"], great["review_year"], great["review_month"]) == (dt.date(2024, 1, 10), 2024, 1)
    assert great["sentiment_label"] == "Positive"
    assert {r["review_date"] for r in reviews if r["rating"] == 4.0} == {None}

    audit = files.read_json(spark, str(tmp_path / "audit")).first()
    assert (audit["initial_rows"], audit["duplicates_removed"], audit["final_rows"]) == (8, 1, 5)
    assert audit["column_roles"]["rating"] == "review_rating" and audit["column_roles"]["state"] is None
    assert audit["initial_columns"] == HEADER and audit["rating_range"] == [1.0, 5.0]
    assert audit["sample_dates"] == ["2024-01-10", "2024-02-10", "2024-02-10"]
    assert audit["source_file"].endswith("reviews.csv") and audit["filled_place_name"] == 0

    mentions = {(r["category"], r["count"]) for r in feedback.top_complaints(built).collect()}
    assert mentions == {("Waiting Time", 2), ("Service", 2), ("Cleanliness", 3)}
    assert ratings.kpi_summary(built).first()["total_businesses"] == 3
    assert {r["total_reviews"] for r in views.business_summary(built).collect()} == {3, 1}

    before = {name: content(getattr(built, name)) for name in ("cities", "categories", "businesses", "reviews", "keywords")}
    raw = files.read_csv(spark, files.find_csv(spark, raw_folder), multi_line=True)
    assert build.store(build.prepare(build.ordered(raw)), where) == 7
    again = warehouse.read_star(spark, where)
    assert before == {name: content(getattr(again, name)) for name in before}


@pytest.mark.parametrize("sample", [None, 4])
def test_observed_counts_equal_the_audit(spark, raw_folder, tmp_path, sample):
    """What the write job observes is what the exact audit counts, and the log does not clean again."""
    raw = build.ordered(files.read_csv(spark, files.find_csv(spark, raw_folder), multi_line=True), sample)
    counts = cleaning.CleaningCounts()
    staged = build.stage(build.prepare(raw, counts=counts), str(tmp_path / "star"))
    exact = cleaning.audit(raw).first().asDict()
    observed = cleaning.observed_audit(counts, staged)
    assert observed.first().asDict() == exact
    assert "FileScan csv" not in observed._jdf.queryExecution().executedPlan().toString()
    empty = raw.where("false")
    counts = cleaning.CleaningCounts()
    staged = build.stage(build.prepare(empty, counts=counts), str(tmp_path / "empty"))
    assert cleaning.observed_audit(counts, staged).first().asDict() == cleaning.audit(empty).first().asDict()


def test_scores_are_written_back_without_a_shuffle(spark, tmp_path):
    """Reviews and scores bucketed by key: the join reads buckets side by side."""
    reviews = spark.range(500).select(F.col("id").cast("string").alias("review_id"), F.lit("x").alias("review_text"))
    scores = reviews.where("CAST(review_id AS INT) % 5 != 0").select("review_id", *[F.lit(0.5).alias(c) for c in sentiment.SCORE_COLUMNS[:-1]], F.lit("Positive").alias("sentiment_label"))
    left = warehouse.write_keyed(reviews, "keyed_reviews", str(tmp_path / "reviews"))
    right = warehouse.write_keyed(scores, "keyed_scores", str(tmp_path / "scores"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = sentiment.attach_scores(left, right)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        got = joined.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE keyed_reviews")
        spark.sql("DROP TABLE keyed_scores")
    assert len(got) == 500 and {r["review_id"] for r in got if r["sentiment_label"] is None} == {str(i) for i in range(0, 500, 5)}


def test_registered_views(spark, raw_folder, tmp_path):
    built = build.build(spark, raw_folder, str(tmp_path / "star"), multi_line=True)
    warehouse.register(built)
    views.register_views(built)
    got = warehouse.query(
        spark,
        "SELECT b.name, count(*) AS n FROM reviews r JOIN businesses b ON r.business_id = b.business_id "
        "WHERE b.name = :name GROUP BY b.name", {"name": "Kafe"},
    )
    assert tuple(got.first()) == ("Kafe", 4)
    assert spark.table("vw_city_summary").count() == 3
    for name in ("cities", "categories", "businesses", "reviews", "keywords", "vw_business_summary", "vw_city_summary",
                 "vw_monthly_trends"):
        spark.catalog.dropTempView(name)


def test_sampled_build(spark, raw_folder, tmp_path):
    built = build.build(spark, raw_folder, str(tmp_path / "star"), sample_rows=3, audit_path=str(tmp_path / "audit"), multi_line=True)
    audit = files.read_json(spark, str(tmp_path / "audit")).first()
    assert (audit["initial_rows"], audit["sample_size"]) == (3, 3)
    assert built.reviews.count() == audit["final_rows"]


def test_business_without_city_column(spark):
    rows = spark.createDataFrame(
        [("A", None, "k1", 1.0, 2.0, "x", "s", 2), ("A", None, "k2", 3.0, 4.0, "y", "s", 1), (None, None, None, None, None, None, "s", 3)],
        f"business_name string, city string, category string, latitude double, longitude double, business_id string, "
        f"source string, {ORDER} bigint",
    )
    got = {r["name"]: r for r in star.build_businesses(rows).collect()}
    assert set(got) == {"A", "Unknown"}
    assert got["A"]["external_id"] == "y" and got["A"]["city_id"] is None
    assert star.build_cities(rows).count() == 0
    assert star.build_categories(rows).count() == 2


def test_build_reads_every_file_of_the_folder(spark, raw_folder, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i, row in enumerate(ROWS[:2]):
        with open(folder / f"part{i}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([HEADER, row])
    raw = files.read_csv(spark, files.find_csv(spark, str(folder)), multi_line=True)
    assert raw.count() == 2


def test_two_platforms_in_either_order_and_again(spark, raw_folder, tmp_path):
    """Each platform's rows are its own; a business that both know is one, whichever came first."""
    folder = tmp_path / "yelp"
    folder.mkdir()
    rows = [["Kafe", "istanbul", "3", "good but slow", "2024-05-01", "y1"], ["Bar Uno", "Reno", "1", "rude and dirty", "2023-05-01", "y2"]]

    def write(rows):
        with open(folder / "yelp.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([["name", "city", "stars", "text", "date", "business_id"], *rows])

    write(rows)
    loads = {"google_maps": raw_folder, "yelp": str(folder)}
    tables = ("cities", "categories", "businesses", "reviews", "keywords")
    found = []
    for order in (["google_maps", "yelp"], ["yelp", "google_maps"]):
        where = str(tmp_path / "-".join(order))
        for platform in order:
            assert not build.is_ready(spark, where, platform)
            built = build.build(spark, loads[platform], where, platform, multi_line=True)
        found.append({name: content(getattr(built, name)) for name in tables})
    assert found[0] == found[1]
    kafe = built.businesses.where("name = 'Kafe' AND external_id = 'g1'").collect()
    assert len(kafe) == 1 and kafe[0]["source"] == "google_maps" and built.businesses.where("external_id = 'y1'").count() == 0
    assert {r["source"]: r["count"] for r in built.reviews.groupBy("source").count().collect()} == {"google_maps": 5, "yelp": 2}

    write(rows[:1])  # a year of the platform's reviews is gone: loading it again takes them out, and nothing else
    raw = files.read_csv(spark, files.find_csv(spark, str(folder)), multi_line=True)
    build.store(build.prepare(build.ordered(raw), "yelp"), where, platform="yelp")
    again = warehouse.read_star(spark, where)
    assert content(again.reviews.where("source = 'google_maps'")) == content(built.reviews.where("source = 'google_maps'"))
    assert [r["review_year"] for r in again.reviews.where("source = 'yelp'").collect()] == [2024]
    assert again.keywords.where("source = 'yelp'").count() == 0 and again.businesses.where("name = 'Bar Uno'").count() == 0
