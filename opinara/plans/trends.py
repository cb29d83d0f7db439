"""Monthly series. A window over months sees a dozen rows per year of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions.dates import year_month
from opinara.functions.numbers import maybe_round, percent
from opinara.operators.rollup import average, per_month, share
from opinara.sources.warehouse import Star


def months(star: Star) -> DataFrame:
    label = year_month(F.col("review_year"), F.col("review_month")).alias("year_month")
    return per_month(star.reviews).where("review_month IS NOT NULL").select("*", label)


def monthly_volume(star: Star) -> DataFrame:
    return (
        months(star)
        .select(
            F.col("review_year").alias("year"), F.col("review_month").alias("month"), "year_month",
            F.col("reviews").alias("review_count"),
        )
        .orderBy("year", "month")
    )


def monthly_volume_of_years(star: Star) -> DataFrame:
    """Volume of every year that is known, also where the month is not."""
    known = per_month(star.reviews).select("review_year", "review_month", F.col("reviews").alias("review_count"))
    return known.orderBy("review_year", "review_month")


def monthly_average(star: Star) -> DataFrame:
    return (
        months(star)
        .select(
            F.col("review_year").alias("year"), F.col("review_month").alias("month"), "year_month",
            average(3).alias("avg_rating"), F.col("reviews").alias("review_count"),
        )
        .orderBy("year", "month")
    )


def monthly_sentiment(star: Star) -> DataFrame:
    return (
        months(star)
        .select(
            "review_year", "review_month", "year_month", F.col("reviews").alias("total"),
            share("positive", 2).alias("positive_pct"), share("negative", 2).alias("negative_pct"),
            share("neutral", 2).alias("neutral_pct"),
        )
        .orderBy("review_year", "review_month")
    )


def growth(star: Star) -> DataFrame:
    """Change of volume against the month before that has reviews."""
    before = F.lag("review_count").over(Window.orderBy("year_month"))
    change = percent(F.col("review_count") - F.col("prev_month_count"), F.col("prev_month_count"), 2)
    return (
        months(star)
        .select("year_month", F.col("reviews").alias("review_count"))
        .withColumn("prev_month_count", before)
        .withColumn("growth_pct", change)
    )


def running_average(star: Star, window: int = 3, digits: int | None = 3) -> DataFrame:
    """Mean of the monthly averages of ``window`` months up to each; rounded averages go in when rounding."""
    frame = Window.orderBy("year_month").rowsBetween(-(window - 1), 0)
    averages = months(star).select("year_month", average(digits).alias("avg_rating"))
    return averages.withColumn(f"running_avg_{window}m", maybe_round(F.avg("avg_rating").over(frame), digits))


def volume_change(months: DataFrame, group: str | None = None, k: int = settings.TREND_MONTHS) -> DataFrame:
    """Mean volume of the last ``k`` months against the first ``k``, in percent; nothing for fewer months."""
    keys = [group] if group else []
    rows = Window.partitionBy(*keys)
    early = F.row_number().over(rows.orderBy("year_month"))
    late = F.row_number().over(rows.orderBy(F.desc("year_month")))
    volume = F.col("review_count")
    return (
        months.withColumns({"_early": early, "_late": late})
        .groupBy(*keys)
        .agg(
            F.avg(F.when(F.col("_late") <= k, volume)).alias("recent"),
            F.avg(F.when(F.col("_early") <= k, volume)).alias("earlier"),
            F.count("*").alias("months"),
        )
        .where((F.col("months") >= k) & (F.col("earlier") != 0))
        .withColumn("change_pct", percent(F.col("recent") - F.col("earlier"), F.col("earlier"), None))
    )
