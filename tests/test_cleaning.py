import datetime as dt

import pytest
from pyspark.sql import functions as F

from opinara.operators import cleaning, profiling
from opinara.sources import files

COLUMNS = "stars string, text string, name string, city string, date string, extra string, size double"
ROWS = [
    ("4", "good<br>food", "A", "nyc", "2024-03-05", None, 1.0),
    ("4", "good<br>food", "A", "nyc", "2024-03-05", None, 1.0),
    ("5", " ", "A", "nyc", "2024-03-05", "x", None),
    ("abc", "t", "A", None, None, "x", None),
    ("0.5", "t", "A", None, None, "x", None),
    ("6", "t", "A", None, None, "x", None),
    (None, "t", "A", None, None, "x", None),
    ("NaN", "t", "A", None, None, "x", None),
    ("1", "<p></p>", None, "New York", "2 hafta önce", "x", None),
    ("5", "‘x’", "B", None, None, "x", None),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_clean(raw):
    rows = cleaning.clean(raw).orderBy("name", "city").collect()
    got = [(r["stars"], r["text"], r["name"], r["city"], r["date"], r["extra"], r["size"]) for r in rows]
    assert got == [
        (4.0, "good food", "A", "New York City", dt.date(2024, 3, 5), "Unknown", 1.0),
        (5.0, "'x'", "B", "Unknown", None, "x", None),
        (1.0, "", "Unknown", "New York City", None, "x", None),
    ]
    assert len({r["review_id"] for r in rows}) == 3


def test_audit(raw):
    row = cleaning.audit(raw).first().asDict()
    assert row == {
        "initial_rows": 10, "duplicates_removed": 1, "invalid_ratings_removed": 5, "blank_reviews_removed": 1,
        "final_rows": 3, "total_rows_removed": 7, "retention_pct": 30.0, "null_dates": 2, "cities_before": 2,
        "cities_after": 2, "filled_name": 1, "filled_extra": 1,
    }
    empty = cleaning.audit(raw.where("false")).first()
    assert empty["initial_rows"] == 0 and empty["retention_pct"] is None


def test_review_ids_do_not_depend_on_partitioning(raw):
    ids = {r["review_id"] for r in cleaning.clean(raw).collect()}
    assert ids == {r["review_id"] for r in cleaning.clean(raw.repartition(5)).collect()}


def test_first_copy_gives_the_order(spark):
    df = files.with_order(spark.createDataFrame([("a",), ("b",), ("a",)], "x string").coalesce(1))
    got = {r["x"]: (r["_copies"], r["_order"]) for r in cleaning.collapse_copies(df).collect()}
    assert got == {"a": (2, 0), "b": (1, 1)}


def test_numeric_dates(spark):
    df = spark.createDataFrame(
        [("4", "good", 1700000000000), ("3", "bad", None)], "stars string, text string, time bigint"
    )
    got = {r["text"]: r["time"] for r in cleaning.clean(df).collect()}
    assert got == {"good": dt.date(2023, 11, 14), "bad": None}


def test_missing_roles(spark):
    with pytest.raises(ValueError, match="rating"):
        cleaning.clean(spark.createDataFrame([("x",)], "text string"))
    with pytest.raises(ValueError, match="review_text"):
        cleaning.audit(spark.createDataFrame([("5",)], "stars string"))


def test_no_city_or_date_column(spark):
    df = spark.createDataFrame([("5", "ok")], "stars string, text string")
    assert cleaning.clean(df).select("stars", "text").first() == (5.0, "ok")
    assert cleaning.audit(df).first()["final_rows"] == 1


def test_profile(spark, raw, tmp_path):
    nulls = {r["column"]: (r["null_count"], r["null_pct"], r["dtype"]) for r in profiling.null_summary(raw).collect()}
    assert nulls["size"] == (8, 80.0, "double") and nulls["text"] == (0, 0.0, "string")
    assert profiling.null_summary(raw).first()["column"] == "size"
    assert profiling.duplicate_rows(raw).first()[0] == 1
    assert tuple(profiling.overview(raw).first()) == (10, 7, 1)
    top = [tuple(r) for r in profiling.top_values(raw, "city", 2).collect()]
    assert top == [(None, 6, 60.0), ("nyc", 3, 30.0)]
    report = profiling.report(raw, "sample")
    assert "- Rows: 10" in report and "| size | double | 8 | 80.0 |" in report
    assert profiling.duplicate_rows(raw.where("false")).first()[0] == 0
    for _ in range(2):
        profiling.write_report(raw, "sample", str(tmp_path / "report"))
    assert "- Duplicate rows: 1" in [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
