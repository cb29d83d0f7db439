"""From raw review files to the stored star schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions.words import row_digest
from opinara.operators import cleaning, complaints, sentiment, star
from opinara.sources import files, sampling, warehouse
from opinara.sources.roles import canonical


def ordered(
    raw: DataFrame, sample_rows: int | None = None, numeric: Sequence[str] | None = settings.NUMERIC_COLUMNS
) -> DataFrame:
    """The raw rows to work on: in reading order, numbers as numbers, a sample of an exact size if one is wanted.

    ``numeric`` names the number columns that play no role; None finds them out, in one more pass over the file.
    """
    rows = files.with_order(files.with_numbers(raw, numeric))
    if not sample_rows:
        return rows
    return sampling.exact_sample(rows, sample_rows, key=row_digest([c for c in rows.columns if c != files.ORDER]))


def prepare(
    rows: DataFrame, platform: str = settings.DEFAULT_SOURCE, dictionaries: dict | None = None, counts: cleaning.CleaningCounts | None = None
) -> DataFrame:
    """Clean, canonical and scored reviews of one platform, as one plan."""
    cleaned = canonical(cleaning.clean(rows, platform, counts=counts), platform)
    return sentiment.score_reviews(cleaned, **(dictionaries or {}))


def stage(rows: DataFrame, location: str, platform: str = settings.DEFAULT_SOURCE) -> DataFrame:
    """The prepared rows written once, so that the table jobs neither clean nor score them again."""
    staged = f"{location}/_staged_{platform}"
    rows.write.mode("overwrite").parquet(staged)
    return rows.sparkSession.read.schema(rows.schema).parquet(staged)


def store(rows: DataFrame, location: str, complaint_words: Mapping | None = None, platform: str = settings.DEFAULT_SOURCE) -> int:
    """Writes one platform's rows to the five tables and returns the number of its complaint mentions.

    What the platform had in businesses, reviews and mentions is replaced, other platforms' rows stay; cities and categories
    are names, and new ones are added. So platforms may come in any order, and one of them again.

    ``rows`` are read by each table's job: give them as :func:`stage` returns them.
    """
    warehouse.append_new(star.build_cities(rows), "cities", location)
    warehouse.append_new(star.build_categories(rows), "categories", location)
    warehouse.write_table(star.build_businesses(rows), "businesses", location, platform)
    warehouse.write_table(star.build_reviews(rows), "reviews", location, platform)
    return store_keywords(rows.sparkSession, location, complaint_words, platform)


def store_keywords(
    spark: SparkSession, location: str, complaint_words: Mapping | None = None, platform: str = settings.DEFAULT_SOURCE
) -> int:
    """Tags a platform's stored negative reviews anew, replaces its mentions and returns their number."""
    reviews = warehouse.read_table(spark, "reviews", location).where(F.col("source") == platform)
    warehouse.write_table(complaints.keyword_rows(reviews, complaint_words), "keywords", location, platform)
    return warehouse.read_table(spark, "keywords", location).where(F.col("source") == platform).count()


def is_ready(spark: SparkSession, location: str, platform: str = settings.DEFAULT_SOURCE) -> bool:
    """Whether stored, scored reviews of the platform exist."""
    reviews = warehouse.read_table(spark, "reviews", location)
    return reviews is not None and not reviews.where((F.col("source") == platform) & F.col("sentiment_label").isNotNull()).isEmpty()


def build(
    spark: SparkSession, raw_folder: str, location: str, platform: str = settings.DEFAULT_SOURCE,
    preferred: str | None = None, sample_rows: int | None = None, audit_path: str | None = None,
    multi_line: bool = False,
) -> warehouse.Star:
    """Reads, cleans, scores, tags and stores one platform's reviews, all files of a folder, unless that has been done."""
    if not is_ready(spark, location, platform):
        paths = files.find_csv(spark, raw_folder, preferred)
        rows = ordered(files.read_csv(spark, paths, multi_line), sample_rows)
        counts = cleaning.CleaningCounts() if audit_path else None
        staged = stage(prepare(rows, platform, counts=counts), location, platform)
        if audit_path:
            files.write_json(cleaning.log_document(rows, platform, ", ".join(paths), sample_rows, counts=counts, cleaned=staged), audit_path)
        store(staged, location, platform=platform)
    return warehouse.read_star(spark, location)
