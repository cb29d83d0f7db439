"""Review tables read out of the test tables, each over its whole input.

The rating star takes line items for reviews and parts for businesses; suppliers are businesses that nobody has
reviewed and their nations cities without reviews. The text star takes documents for reviews, with the quality
label for their sentiment and their source for the business.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.words import word_stretches
from opinara.operators import complaints
from opinara.sources.files import ORDER

AS_OF = "2001-11-04"
ATTENTION = 3.0
NAMES = ["large ring", "hot bolt"]

# Phrases that occur in the documents, some of them with letters outside ASCII.
COMPLAINTS = {
    "Articles": ["the", "der", "les", "el"],
    "Linking": ["und", "et", "of the", "and the"],
    "Places": ["from the", "für", "sous", "por"],
    "Rare": ["ononst", "hehely", "orantion"],
    "Accents": ["é", "más", "qué", "à", "où", "sí", "él"],
}
LEXICON = {"the": 1.0, "and": -0.5, "with": 2.0, "der": -1.5, "que": 1.25, "les": -2.25, "was": -1.0, "for": 0.75}
BOOSTERS = {"in": 0.25, "of": -0.125, "la": 0.5}
NEGATIONS = ["is", "und", "et"]
SMALL = "abcdefghijklmnopqrstuvwxyz"
PIVOTS = ["with", "avec", "mit", "con"]
POSITIVE_WORDS = ["the", "with", "que", "for"]
NEGATIVE_WORDS = ["and", "der", "les", "was"]


SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A test table; the schema is stated, so no file is opened before the query runs."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


LINE_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


class RatingStar:
    """The star, each table read when a query first asks for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def _read(self, table: str) -> DataFrame:
        return read(self._spark, self._folder, table)

    @cached_property
    def _part(self) -> DataFrame:
        return self._read("part")

    @cached_property
    def _nation(self) -> DataFrame:
        return self._read("nation")

    @cached_property
    def reviews(self) -> DataFrame:
        dated = F.when(F.col("l_linenumber") != 7, F.to_date("l_shipdate"))
        flag = F.col("l_returnflag")
        return self._read("lineitem").select(
            F.concat_ws("-", *LINE_ID).alias("review_id"),
            F.col("l_partkey").alias("business_id"),
            (F.lit(1) + F.pmod(F.col("l_quantity").cast("int"), F.lit(5))).cast("double").alias("rating"),
            F.lit(None).cast("string").alias("review_text"),
            dated.alias("review_date"),
            F.year(dated).alias("review_year"),
            F.month(dated).alias("review_month"),
            F.col("l_linestatus").alias("source"),
            F.when(flag == "N", "Positive").when(flag == "A", "Neutral").when(flag == "R", "Negative").alias(
                "sentiment_label"
            ),
        )

    @cached_property
    def businesses(self) -> DataFrame:
        parts = self._part.select(
            F.col("p_partkey").alias("business_id"),
            F.col("p_name").alias("name"),
            F.when(F.col("p_partkey") % 20 != 0, F.col("p_brand")).alias("city_id"),
            F.col("p_type").alias("category_id"),
        )
        suppliers = (
            self._read("supplier")
            .join(self._nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                (-1 - F.col("s_suppkey")).alias("business_id"),
                F.col("s_name").alias("name"),
                F.col("n_name").alias("city_id"),
                F.lit(None).cast("string").alias("category_id"),
            )
        )
        return parts.unionByName(suppliers)

    @cached_property
    def cities(self) -> DataFrame:
        number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("double")
        brands = self._part.select("p_brand").distinct().select(
            F.col("p_brand").alias("city_id"),
            F.col("p_brand").alias("city_name"),
            F.when(number % 5 != 0, number).alias("latitude"),
            (-number).alias("longitude"),
        )
        nowhere = F.lit(None).cast("double")
        places = self._nation.select(
            F.col("n_name").alias("city_id"), F.col("n_name").alias("city_name"),
            nowhere.alias("latitude"), nowhere.alias("longitude"),
        )
        return brands.unionByName(places)

    @cached_property
    def categories(self) -> DataFrame:
        kinds = self._part.select(F.col("p_type").alias("category_id")).distinct()
        return kinds.withColumn("category_name", F.col("category_id"))

    @cached_property
    def keywords(self) -> DataFrame:
        return complaints.keyword_rows(text_reviews(self._spark, self._folder), COMPLAINTS)


def line_mentions(star: RatingStar) -> DataFrame:
    """Complaint mentions of the negative line items, with their source and month."""
    category = F.when(F.col("rating") <= 2, "Service").when(F.col("rating") == 3, "Waiting Time").otherwise("Price / Value")
    return star.reviews.where("sentiment_label = 'Negative'").select(
        "review_id", category.alias("complaint_category"), "source", month_of_review().alias("month"),
    )


def month_of_review():
    label = F.format_string("%04d-%02d", "review_year", "review_month")
    return F.when(F.col("review_year").isNotNull(), label).otherwise("undated")


def rating_star(spark: SparkSession, folder: str) -> RatingStar:
    return RatingStar(spark, folder)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def plain_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"), F.col("source").alias("business_name")
    )


def text_reviews(spark: SparkSession, folder: str) -> DataFrame:
    quality = read(spark, folder, "labels").select("doc_id", "quality")
    return (
        documents(spark, folder)
        .join(quality, "doc_id", "left")
        .select(
            F.col("doc_id").alias("review_id"),
            F.col("text").alias("review_text"),
            F.col("source").alias("business_name"),
            F.when(F.col("quality") == 1, "Positive").when(F.col("quality") == 0, "Negative").otherwise("Neutral").alias(
                "sentiment_label"
            ),
        )
    )


def phrase_table(spark: SparkSession, folder: str) -> DataFrame:
    """Two neighbouring words of the benchmark's items as phrases, and their longer words; by the item's number, a category."""
    items = read(spark, folder, "benchmark").select(F.concat(F.lit("topic "), F.col("item_id") % 7).alias("category"), F.lower("text").alias("text"))
    phrases = items.select("category", F.explode(word_stretches(F.col("text"), 2)).alias("phrase"))
    return phrases.where(F.col("phrase").rlike(r"[^\p{L}\p{N}_]") | (F.length("phrase") > 8))


def loud_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents, some with words in capitals, exclamation and question marks."""
    n, text = F.length("review_text"), F.col("review_text")
    capitals = F.replace(F.replace(text, F.lit(" the "), F.lit(" THE ")), F.lit(" in "), F.lit(" IN "))
    text = F.when(n % 3 == 0, capitals).when(n % 11 == 0, F.translate(text, SMALL, SMALL.upper())).otherwise(text)
    text = F.concat(text, F.repeat(F.lit("!"), (n % 7).cast("int")), F.repeat(F.lit("?"), (n % 5).cast("int")))
    return text_reviews(spark, folder).withColumn("review_text", text)


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """A raw delivery with everything cleaning has to deal with; equal documents make the copies."""
    n = F.col("n_chars")
    text = F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301"))
    text = F.replace(text, F.lit(". "), F.lit(".\u00a0<br/>\u2019\t "))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (n % 1000).cast("int"))
    return documents(spark, folder).select(
        F.when(n % 11 == 0, "abc").when(n % 11 == 1, "0.5").when(n % 11 == 2, "6").when(n % 11 == 3, None)
        .when(n % 11 == 4, "5d").when(n % 11 == 5, "4f").when(n % 11 == 6, "0x1p1")
        .otherwise((n % 5 + 1).cast("string")).alias("stars"),
        F.when(n % 13 == 0, F.lit("\u00a0\t ")).otherwise(text).alias("text"),
        F.concat(F.lit("Shop "), (n % 10).cast("string")).alias("name"),
        F.when(n % 7 == 0, None).when(n % 7 == 1, " NYC ").when(n % 7 == 2, F.concat(F.lit("o'fallon-"), "lang"))
        .otherwise(F.col("lang")).alias("city"),
        F.when(n % 3 == 0, day.cast("string")).when(n % 3 == 1, F.date_format(day, "MM/dd/yyyy"))
        .otherwise("2 hafta önce").alias("date"),
        F.when(n % 2 == 0, "Dinner").alias("visit_details"),
    )


def canonical_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their part as cleaned reviews, read in the order of the part key."""
    part = read(spark, folder, "part")
    return (
        read(spark, folder, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("-", *LINE_ID).alias("review_id"),
            (F.lit(1) + F.pmod(F.col("l_quantity").cast("int"), F.lit(5))).cast("double").alias("rating"),
            F.lit(None).cast("string").alias("review_text"),
            F.col("p_name").alias("business_name"),
            F.when(F.col("p_partkey") % 20 != 0, F.col("p_brand")).alias("city"),
            F.col("p_type").alias("category"),
            F.when(F.col("l_linenumber") != 7, F.to_date("l_shipdate")).alias("date"),
            F.col("p_size").cast("double").alias("latitude"),
            F.lit(None).cast("double").alias("longitude"),
            F.col("p_partkey").cast("string").alias("business_id"),
            F.lit("google_maps").alias("source"),
            F.col("p_partkey").alias(ORDER),
        )
    )
