"""Complaint categories by dictionary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions.numbers import percent
from opinara.functions.text import bind
from opinara.functions.words import any_phrase, is_run_bound, phrases_found, stretch_rows
from opinara.operators.lookup import look_up

Dictionary = Mapping[str, Sequence[str]]


def categories(text: Column, complaints: Dictionary | None = None) -> Column:
    """Array of the categories that have a phrase in the text, in dictionary order.

    All phrases are looked up in one pass over the words; the few that don't begin and end with a word are searched for.
    """
    chosen = settings.COMPLAINTS if complaints is None else complaints
    names = list(chosen)
    whole: dict[str, list[int]] = {}
    odd: dict[int, list[str]] = {}
    for number, phrases in enumerate(chosen.values()):
        for phrase in {p.lower() for p in phrases}:
            if is_run_bound(phrase):
                whole.setdefault(phrase, []).append(number)
            else:
                odd.setdefault(number, []).append(phrase)

    def of(lowered: Column) -> Column:
        found = phrases_found(lowered, whole)
        if odd:
            searched = [F.when(lowered.rlike(any_phrase(phrases)), F.lit(number)) for number, phrases in odd.items()]
            found = F.array_sort(F.array_distinct(F.concat(found, F.array_compact(F.array(*searched)))))
        return F.transform(found, lambda n: F.get(F.array(*[F.lit(name) for name in names]), n))

    return bind(F.lower(F.coalesce(text, F.lit(""))), of)


def tag(df: DataFrame, text_column: str = "review_text", complaints: Dictionary | None = None) -> DataFrame:
    return df.withColumn("complaint_categories", categories(F.col(text_column), complaints))


def _relevant(df: DataFrame, label_column: str | None) -> DataFrame:
    if label_column and label_column in df.columns:
        return df.where(F.col(label_column) == settings.NEGATIVE)
    return df


def mentions(
    df: DataFrame, text_column: str, complaints: Dictionary | None = None, keep: Sequence[str] = (),
    label_column: str | None = "sentiment_label",
) -> DataFrame:
    """One row per review and category, of the negative reviews where there are labels."""
    found = F.explode(categories(F.col(text_column), complaints)).alias("category")
    return _relevant(df, label_column).select(*keep, found)


def mentions_by_table(
    df: DataFrame, phrases: DataFrame, key: str = "review_id", text_column: str = "review_text", longest: int = 3
) -> DataFrame:
    """(key, category): the categories whose phrases a text has, by a table (category, phrase) of any size.

    Phrases of up to ``longest`` words that begin and end with a word are found, in any case, as :func:`categories` finds
    them. Every stretch of so many words is looked up, whatever the number of phrases.
    """
    wanted = phrases.select(F.lower("phrase").alias("stretch"), "category").where("stretch IS NOT NULL AND category IS NOT NULL")
    wanted = wanted.groupBy("stretch").agg(F.collect_set("category").alias("categories"))
    rows = stretch_rows(df, F.lower(F.col(text_column)), longest, key)
    found = look_up(rows, wanted, "stretch")
    return found.select(key, F.explode("categories").alias("category")).distinct()


def ranked_shares(counted: DataFrame, category: str, digits: int | None = 2) -> DataFrame:
    """Adds the share of all mentions; there are as many rows as categories."""
    whole = F.sum("count").over(Window.partitionBy())
    return counted.withColumn("pct", percent(F.col("count"), whole, digits)).orderBy(F.desc("count"), category)


def frequency(
    df: DataFrame, text_column: str = "review_text", label_column: str | None = "sentiment_label",
    complaints: Dictionary | None = None,
) -> DataFrame:
    """Mentions per category with their share of all mentions."""
    found = mentions(df, text_column, complaints, label_column=label_column)
    return ranked_shares(found.groupBy("category").agg(F.count("*").alias("count")), "category")


def busiest(df: DataFrame, business_column: str, n: int = 20, label_column: str | None = "sentiment_label") -> DataFrame:
    """The ``n`` businesses with the most (negative) reviews."""
    return (
        _relevant(df, label_column)
        .where(F.col(business_column).isNotNull())
        .groupBy(business_column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), business_column)
        .limit(n)
    )


def business_profile(
    df: DataFrame, text_column: str, business_column: str, label_column: str | None = "sentiment_label",
    top_n: int = 20, complaints: Dictionary | None = None,
) -> DataFrame:
    """Mentions per category for the busiest businesses. Reviews of others are left out before tagging."""
    chosen = busiest(df, business_column, top_n, label_column).select(business_column)
    kept = _relevant(df, label_column).join(chosen, business_column, "left_semi")
    return (
        mentions(kept, text_column, complaints, [F.col(business_column).alias("business")], None)
        .groupBy("business", "category")
        .agg(F.count("*").alias("count"))
    )


def keyword_rows(
    reviews: DataFrame, complaints: Dictionary | None = None, id_column: str = "review_id",
    text_column: str = "review_text",
) -> DataFrame:
    """The complaint mentions table of scored reviews."""
    found = mentions(reviews, text_column, complaints, [F.col(id_column).cast("string").alias("review_id")])
    return found.select(
        F.sha2(F.concat_ws("\u001f", "review_id", "category"), 256).alias("keyword_id"),
        "review_id",
        F.col("category").alias("keyword"),
        F.col("category").alias("complaint_category"),
    )
