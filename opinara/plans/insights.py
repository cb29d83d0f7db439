"""Rules over the aggregates, phrased as findings with a recommended action.

Every rule is a grouped aggregate with a projection, so it can be evaluated for all reviews at once or for each
value of a review column (``by``), in the same job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions.dates import year_month
from opinara.functions.numbers import percent
from opinara.operators.rollup import SUMS, average, by_name, named, regroup, share, sums
from opinara.plans.trends import volume_change
from opinara.sources.warehouse import Star

SCOPE = "scope"
COLUMNS = [SCOPE, "rule_order", "type", "title", "detail", "action"]


def _finding(rows: DataFrame, order: int, kind, title, detail, action) -> DataFrame:
    def column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return rows.select(
        SCOPE, F.lit(order).alias("rule_order"), column(kind).alias("type"), column(title).alias("title"),
        column(detail).alias("detail"), column(action).alias("action"),
    )


def _text(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def _half_up(value: Column, digits: int) -> Column:
    """Rounded on the 15 decimals of a double: a mean of 3.515 that is stored as 3.5149999999999997 is 3.52."""
    return F.round(value.cast("decimal(38,15)"), digits).cast("double")


# The wording of every finding below is a fixed value.


def sentiment_health(kpis: DataFrame) -> DataFrame:
    positive, negative, rating = (F.coalesce(c, F.lit(0.0)) for c in ("positive_pct", "negative_pct", "avg_rating"))
    is_strong = positive >= settings.STRONG_POSITIVE
    is_high = ~is_strong & (negative >= settings.HIGH_NEGATIVE)
    is_elevated = ~is_strong & ~is_high & (negative >= settings.ELEVATED_NEGATIVE)

    def pick(strong, high, elevated) -> Column:
        return F.when(is_strong, strong).when(is_high, high).otherwise(elevated)

    return _finding(
        kpis.where(is_strong | is_high | is_elevated), 1,
        pick("success", "critical", "warning"),
        pick("Strong Positive Sentiment", "High Negative Sentiment Alert", "Elevated Negative Feedback"),
        pick(
            _text(
                "%.1f%% of reviews are positive, indicating generally satisfied customers with an average rating "
                "of %.2f★.", positive, rating,
            ),
            _text(
                "%.1f%% of reviews are negative. This level of negative sentiment requires immediate management "
                "attention.", negative,
            ),
            _text("%.1f%% of all reviews are negative. Overall average rating is %.2f★.", negative, rating),
        ),
        pick(
            "Maintain quality standards and leverage positive reviews in marketing.",
            "Initiate customer recovery program. Respond to all negative reviews within 24 hours.",
            "Review complaint categories and develop targeted action plans.",
        ),
    )


def attention(businesses: DataFrame, threshold: float = settings.RATING_ALERT) -> DataFrame:
    """``businesses``: scope, business_id, business_name, avg_rating, review_count of those below the threshold."""
    place = F.struct("avg_rating", "business_name", "business_id", "review_count")
    worst = businesses.groupBy(SCOPE).agg(F.count("*").alias("n"), F.min(place).alias("worst"))
    n = F.col("n")
    return _finding(
        worst, 2,
        F.when(n > settings.CRITICAL_COUNT, "critical").otherwise("warning"),
        F.concat(n.cast("string"), F.when(n > 1, F.lit(" Businesses")).otherwise(" Business"), F.lit(" Need Attention")),
        _text(
            f"%d businesses have an average rating below {threshold}★. The lowest-rated is '%s' (%.1f★ across %d "
            "reviews).", n, F.col("worst.business_name"), F.col("worst.avg_rating"), F.col("worst.review_count"),
        ),
        "Conduct service quality audits for these locations. Review negative feedback themes to identify root causes.",
    )


def city_gaps(cities: DataFrame, overall: DataFrame) -> DataFrame:
    """``cities``: scope, city_name, avg_rating, review_count; ``overall``: scope, national_avg."""
    rows = cities.join(overall.where("national_avg <> 0"), SCOPE)
    gap = settings.CITY_GAP
    side = F.when(F.col("avg_rating") < F.col("national_avg") - gap, "low").when(
        F.col("avg_rating") > F.col("national_avg") + gap, "high"
    )
    order = Window.partitionBy(SCOPE, "side").orderBy(F.desc("review_count"), "city_name")
    listed = (
        rows.withColumn("side", side)
        .where("side IS NOT NULL")
        .withColumn("at", F.row_number().over(order))
        .where(F.col("at") <= settings.CITY_LIST)
        .groupBy(SCOPE, "side")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "city_name"))).alias("names"),
            _half_up(F.avg("avg_rating"), 2).alias("mean"), F.max("national_avg").alias("national_avg"),
        )
        .withColumn("list", F.array_join("names.city_name", ", "))
    )
    many = F.size("names") > 1
    low = _finding(
        listed.where("side = 'low'"), 3, "warning", "Cities Below National Average",
        _text(
            "%s %s average ratings (%.2f★) significantly below the national average of %.2f★.",
            F.col("list"), F.when(many, "have").otherwise("has"), F.col("mean"), F.col("national_avg"),
        ),
        "Investigate location-specific factors such as local competition, staffing issues, or regional customer "
        "expectations.",
    )
    high = _finding(
        listed.where("side = 'high'"), 4, "success", "Top Performing Cities",
        _text(
            "%s %s performing above the national average with ratings of %.2f★.",
            F.col("list"), F.when(many, "are").otherwise("is"), F.col("mean"),
        ),
        "Study best practices from these locations and replicate successful approaches in underperforming cities.",
    )
    return low.unionByName(high)


def top_complaint(complaints: DataFrame) -> DataFrame:
    """``complaints``: scope, category, count."""
    top = (
        complaints.groupBy(SCOPE)
        .agg(F.min(F.struct((-F.col("count")).alias("rank"), "category", "count")).alias("top"),
             F.sum("count").alias("total"))
        .select(SCOPE, "top.category", percent(F.col("top.count"), F.col("total"), None).alias("pct"))
    )
    name = F.col("category")
    return _finding(
        top, 5, "warning", F.concat(F.lit("Top Complaint: "), name),
        _text(
            "'%s' accounts for %.1f%% of all negative feedback — the most frequently mentioned issue in customer "
            "reviews.", name, F.col("pct"),
        ),
        F.concat(
            F.lit("Prioritise improvements to "), F.lower(name),
            F.lit(" experience. Set measurable targets and monitor weekly."),
        ),
    )


def category_gap(categories: DataFrame) -> DataFrame:
    """``categories``: scope, category_name, avg_rating."""
    place = F.struct((-F.col("avg_rating")).alias("rank"), "category_name", "avg_rating")
    ends = (
        categories.groupBy(SCOPE)
        .agg(F.min(place).alias("best"), F.max(place).alias("worst"), F.count("*").alias("n"))
        .where("n >= 2")
    )
    best, worst = F.col("best.category_name"), F.col("worst.category_name")
    high, low = F.col("best.avg_rating"), F.col("worst.avg_rating")
    return _finding(
        ends, 6, "info", F.concat(best, F.lit(" Outperforms Others")),
        _text(
            "'%s' category leads with %.2f★, while '%s' lags at %.2f★ — a gap of %.2f stars.",
            best, high, worst, low, high - low,
        ),
        F.concat(
            F.lit("Investigate what '"), best,
            F.lit("' businesses do differently. Consider cross-category training and process sharing."),
        ),
    )


def review_trend(months: DataFrame) -> DataFrame:
    """``months``: scope, year_month, review_count."""
    change = F.col("change_pct")
    moved = volume_change(months, SCOPE).where(F.abs(change) > settings.TREND_CHANGE)
    is_up = change > 0
    return _finding(
        moved, 7, F.when(is_up, "success").otherwise("warning"),
        F.when(is_up, "Growing Review Volume").otherwise("Declining Review Activity"),
        F.when(
            is_up,
            _text(
                "Recent review volume is %.0f%% higher than earlier periods, indicating increased customer engagement.",
                change,
            ),
        ).otherwise(
            _text("Recent review volume has dropped by %.0f%% compared to earlier periods.", F.abs(change))
        ),
        F.when(is_up, "Capitalise on growth momentum. Encourage reviews through loyalty programs.").otherwise(
            "Investigate causes of reduced engagement. Consider review solicitation campaigns."
        ),
    )


def combine(*findings: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), findings).orderBy(SCOPE, "rule_order")


def insights(
    star: Star, by: str | None = None, threshold: float = settings.RATING_ALERT,
    min_reviews: int = settings.MIN_REVIEWS,
) -> DataFrame:
    """All findings, for all reviews or for each value of the review column ``by``.

    The facts are read once: reviews are summed per scope, business and month, and both the businesses' and the months'
    sums are added up from that exchange. Mentions that have the column ``by`` themselves are counted without the reviews.
    """
    # one scope for all reviews still depends on a column: a literal would turn the joins by scope into cross joins
    every = F.coalesce(F.concat(F.lit("all"), F.substring(F.col("review_id").cast("string"), 1, 0)), F.lit("all"))
    scope = F.col(by).cast("string") if by else every
    reviews = star.reviews.withColumn(SCOPE, scope)
    label = F.when(F.col("review_year").isNotNull() & F.col("review_month").isNotNull(), year_month(F.col("review_year"), F.col("review_month")))
    base = sums(reviews.where("business_id IS NOT NULL").withColumn("year_month", label), SCOPE, "business_id", "year_month")
    # no count is below zero: the filter asks for every sum, so the two plans over it are one exchange
    base = base.where(F.greatest(*SUMS) >= 0)
    rows = named(regroup(base, SCOPE, "business_id").drop("businesses"), star.businesses)
    total = regroup(rows, SCOPE)
    frequent = F.col("reviews") >= min_reviews
    by_city = by_name(rows, star.cities, "city_id", "city_name", SCOPE).where(frequent)
    by_category = by_name(rows, star.categories, "category_id", "category_name", SCOPE).where(frequent)
    low = rows.where(frequent & (average(2) < threshold))
    rated = [average(2).alias("avg_rating"), F.col("reviews").alias("review_count")]
    dated = base.groupBy(SCOPE, "year_month").agg(F.sum("reviews").alias("review_count"), F.count("year_month").alias("dated"))
    months = dated.where("dated > 0").drop("dated")
    found = [
        sentiment_health(
            total.select(SCOPE, share("positive").alias("positive_pct"), share("negative").alias("negative_pct"),
                         average(2).alias("avg_rating"))
        ),
        attention(low.select(SCOPE, "business_id", "business_name", *rated), threshold),
        city_gaps(by_city.select(SCOPE, "city_name", *rated), total.select(SCOPE, average(3).alias("national_avg"))),
        category_gap(by_category.select(SCOPE, "category_name", average(2).alias("avg_rating"))),
        review_trend(months),
    ]
    if star.keywords is not None:
        mentions = star.keywords.where("complaint_category IS NOT NULL")
        if by and by in mentions.columns:
            mentions = mentions.withColumn(SCOPE, F.col(by).cast("string"))
        elif by:
            mentions = mentions.join(reviews.select("review_id", SCOPE), "review_id")
        else:
            mentions = mentions.withColumn(SCOPE, F.lit("all"))
        found.append(
            top_complaint(mentions.groupBy(SCOPE, F.col("complaint_category").alias("category"))
                          .agg(F.count("*").alias("count")))
        )
    return combine(*found)


def recommendations(findings: DataFrame) -> DataFrame:
    """The actions, in the order of the findings."""
    return findings.where(F.coalesce("action", F.lit("")) != "").select(SCOPE, "rule_order", "action")
