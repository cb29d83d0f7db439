import json

import pytest
from pyspark.sql import functions as F

from opinara import schema, settings
from opinara.sources import files, roles, sampling, warehouse


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_csv_quotes_line_breaks_and_missing_values(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'name,text,stars\n"Çay ""1""","line one\nline two, more",5\nB,N/A,\n"NA",x,4\n')
    df = files.read_csv(spark, path, multi_line=True)
    assert [tuple(r) for r in df.orderBy("stars").collect()] == [
        ("B", None, None), (None, "x", "4"), ('Çay "1"', "line one\nline two, more", "5"),
    ]
    assert all(f.dataType.typeName() == "string" for f in df.schema.fields)


def test_csv_without_rows_or_file(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_csv(spark, write(tmp_path, "empty.csv", "a,b\n"))
    with pytest.raises(FileNotFoundError):
        files.find_csv(spark, str(tmp_path / "nowhere"))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.find_csv(spark, str(tmp_path / "none"))


def test_find_csv(spark, tmp_path):
    for name in ("b.csv", "a.csv", "wanted.csv", "c.txt"):
        write(tmp_path, name, "x\n1\n")
    def names(preferred=None):
        return [path.rsplit("/", 1)[1] for path in files.find_csv(spark, str(tmp_path), preferred)]

    assert names("wanted.csv") == ["wanted.csv"]
    assert names("missing.csv") == names() == ["a.csv", "b.csv", "wanted.csv"]


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', 1), ("two\nlines", None, 2)], "p string, q string, n int")
    files.write_csv(df, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == [("a,b", 'say "x"', "1"), ("two\nlines", None, "2")]
    for _ in range(2):
        files.write_json(df, str(tmp_path / "json"))
    assert files.read_json(spark, str(tmp_path / "json")).count() == 2
    lines = [json.loads(x) for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["n"] for x in lines} == {1, 2} and any(x["q"] is None for x in lines)


def test_numeric_columns(spark):
    df = spark.createDataFrame([("1", "a", None), ("2.5", "2", None)], "x string, y string, z string")
    assert files.numeric_columns(df) == ["x", "z"]
    assert files.with_numbers(df).schema["x"].dataType.typeName() == "double"
    assert files.with_numbers(df, ["y"]).select("y").collect()[0][0] is None


def test_roles(spark):
    df = spark.createDataFrame([("5", "good", "A")], "review_rating string, review_text string, place_name string")
    found = roles.resolve_roles(df)
    assert (found["rating"], found["review_text"], found["business_name"], found["city"]) == (
        "review_rating", "review_text", "place_name", None,
    )
    assert roles.find_role(["City", "city_name"], settings.PLATFORMS["google_maps"]["city"]) == "City"
    row = roles.canonical(df).first()
    assert (row["rating"], row["business_name"], row["city"], row["source"]) == (5.0, "A", None, "google_maps")
    assert roles.canonical(df).columns == [*schema.ROLES, "source"]


def test_platforms_together(spark):
    maps = spark.createDataFrame([("4", "ok", "M", "Izmir")], "stars string, text string, name string, City string")
    yelp = spark.createDataFrame([("3", "meh", "Y", "Reno")], "stars string, text string, name string, city string")
    trip = spark.createDataFrame([("5", "wow", "T")], "bubble_rating string, review_body string, hotel_name string")
    df = roles.union_platforms({"google_maps": maps, "yelp": yelp, "tripadvisor": trip})
    got = {tuple(r) for r in df.select("source", "rating", "business_name", "city").collect()}
    assert got == {("google_maps", 4.0, "M", "Izmir"), ("yelp", 3.0, "Y", "Reno"), ("tripadvisor", 5.0, "T", None)}


def test_exact_sample(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    for n in (1, 17, 1000, 4999):
        got = sampling.exact_sample(df, n, key="id")
        assert got.count() == n and got.distinct().count() == n and got.columns == ["id", "v"]
    first = {r["id"] for r in sampling.exact_sample(df, 100, key="id").collect()}
    again = {r["id"] for r in sampling.exact_sample(df.repartition(7), 100, key="id").collect()}
    other = {r["id"] for r in sampling.exact_sample(df, 100, seed=1, key="id").collect()}
    assert first == again and first != other
    assert sampling.exact_sample(df, 5000).count() == 5000
    assert sampling.exact_sample(df, 10).count() == 10


def test_sample_is_a_filter(spark):
    """No shuffle, no sort: whatever is drawn is read once more."""
    df = spark.range(5000)
    found = sampling.exact_sample(df, 1000, key="id")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = df.withColumn("d", F.md5(F.concat(F.col("id").cast("string"), F.lit(":42")))).orderBy("d").limit(1000)
    assert {r[0] for r in found.collect()} == {r["id"] for r in want.collect()}


def test_sample_with_a_bad_guess(spark, monkeypatch):
    """All digests far from where the n-th is looked for first; and many equal ones at the cut."""
    df = spark.range(400)
    for digest in (F.lpad(F.hex("id"), 32, "0"), F.concat(F.lit("ffff"), F.lpad(F.hex("id"), 28, "0")), F.lit("7" * 32)):
        monkeypatch.setattr(sampling, "draw", lambda key, seed, digest=digest: F.lower(digest))
        assert sampling.exact_sample(df, 100, key="id").distinct().count() == 100
    assert sampling.exact_sample(df, 0, key="id").count() == 0


def test_table_round_trip_and_upsert(spark, tmp_path):
    where = str(tmp_path / "star")
    cities = spark.createDataFrame([("1", "A"), ("2", "B")], "city_id string, city_name string")
    warehouse.append_new(cities, "cities", where)
    warehouse.append_new(spark.createDataFrame([("2", "B"), ("3", "C")], cities.schema), "cities", where)
    stored = warehouse.read_table(spark, "cities", where)
    assert stored.columns == schema.CITIES.names
    assert sorted(r["city_name"] for r in stored.collect()) == ["A", "B", "C"]
    assert warehouse.read_table(spark, "reviews", where) is None
    reviews = spark.createDataFrame(
        [("r1", "b", 4.0, 2020), ("r2", "b", 3.0, None)], "review_id string, business_id string, rating double, review_year int"
    )
    for _ in range(2):
        warehouse.write_table(reviews, "reviews", where)
    stored = warehouse.read_table(spark, "reviews", where)
    assert stored.schema.names == schema.REVIEWS.names
    assert sorted((r["review_id"], r["review_year"]) for r in stored.collect()) == [("r1", 2020), ("r2", None)]


def test_declared_tables_and_sql(spark, tmp_path):
    schema.create_tables(spark, str(tmp_path / "declared"))
    schema.create_tables(spark, str(tmp_path / "declared"))
    try:
        assert set(spark.table("reviews").columns) == set(schema.REVIEWS.names)
        assert warehouse.query(spark, "SELECT count(*) AS n FROM reviews WHERE rating > :r", {"r": 3}).first()["n"] == 0
    finally:
        for name in schema.TABLES:
            spark.sql(f"DROP TABLE {name}")
