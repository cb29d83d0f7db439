"""Name -> Spark query, every one over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import dates, text
from opinara.functions.numbers import sentiment_label
from opinara.operators import cleaning, complaints, profiling, sentiment, star, terms
from opinara.plans import businesses, feedback, insights, ratings, trends, views
from opinara.sources import roles, warehouse
from opinara.sources.sampling import exact_sample
from workload import tables
from workload.tables import canonical_reviews, plain_reviews, rating_star, raw_reviews, read, text_reviews

Query = Callable[[SparkSession, str], DataFrame]


def _as_of():
    return F.lit(tables.AS_OF).cast("date")


def _on_star(plan: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: plan(rating_star(spark, folder), *args, **kwargs)


def _on_text(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: operator(text_reviews(spark, folder), *args, **kwargs)


def _on_plain_text(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: operator(plain_reviews(spark, folder), *args, **kwargs)


def _wide(query: Query) -> Query:
    """Integer columns as bigint, unrounded averages with nine decimals: what the SQL side returns."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query(spark, folder)
        return df.select(
            *[
                F.col(f.name).cast("bigint").alias(f.name) if f.dataType.typeName() in ("integer", "short", "byte")
                else F.round(f.name, 9).alias(f.name) if f.dataType.typeName() == "double"
                else F.col(f.name)
                for f in df.schema.fields
            ]
        )

    return run


def city_names_of(spark: SparkSession, folder: str) -> DataFrame:
    """Names of every kind the tables have, spelled in several ways, as city names."""
    sources = [
        read(spark, folder, "nation").select(F.col("n_name").alias("city")),
        read(spark, folder, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("'s "), "c_name").alias("city")),
        read(spark, folder, "part").select(F.concat_ws("-", "p_name", "p_type").alias("city")),
        read(spark, folder, "documents").select(F.col("text").alias("city")),
        read(spark, folder, "events").select(
            F.when(F.col("event_type") == "view", "Bombay").when(F.col("event_type") == "click", " nyc\t")
            .when(F.col("event_type") == "purchase", " ").alias("city")
        ),
    ]
    all_names = sources[0]
    for more in sources[1:]:
        all_names = all_names.unionByName(more)
    cities = all_names.distinct()
    return cities.select("city", text.standard_city(F.col("city")).alias("standard_city"))


def parsed_dates(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate")
    seconds = F.unix_date(F.to_date(day)).cast("bigint") * 86400 + 3600
    raw = read(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format(day, "yyyy-MM-dd").alias("iso"),
        F.date_format(day, "MM/dd/yyyy").alias("us"),
        F.date_format(day, "d MMM yyyy").alias("written"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T01:30:00+05:00")).alias("zoned"),
        seconds.alias("s"), (seconds * 1000).alias("ms"), F.col("o_orderpriority").alias("none"),
    )
    key = F.col("o_orderkey")
    bad = F.when(key % 5 == 3, F.when(key % 2 == 0, "1e19").otherwise("NaN")).when(key % 10 == 4, "12:30:00").otherwise("T12:30")
    mixed = F.when(key % 5 == 0, F.col("s").cast("string")).when(key % 5 == 1, F.col("ms").cast("string")).when(key % 5 == 2, F.col("iso"))
    raw = raw.withColumn("mixed", mixed.otherwise(bad))
    names = ("iso", "us", "written", "zoned", "s", "ms", "none", "mixed")
    return raw.select("o_orderkey", *[dates.parse_date(F.col(c)).alias(f"{c}_date") for c in names])


def clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", F.col("html").alias("review_text"))
    return cleaning.normalise_text(cleaning.drop_blank(pages, "review_text"), "review_text")


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean(raw_reviews(spark, folder)).drop("review_id", "_order")


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    rows = complaints.tag(plain_reviews(spark, folder), complaints=tables.COMPLAINTS)
    return rows.select("review_id", F.array_join("complaint_categories", "|").alias("complaint_categories"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = plain_reviews(spark, folder).select("review_id", "review_text")
    return sentiment.score_reviews(
        rows, lexicon=tables.LEXICON, boosters=tables.BOOSTERS, negations=tables.NEGATIONS
    ).drop("review_text")


def _rules() -> sentiment.Rules:
    return sentiment.Rules(pivots=tables.PIVOTS)


def scored_as_written(spark: SparkSession, folder: str) -> DataFrame:
    """Capitals, marks and pivots count, with the dictionaries in the plan."""
    rows = tables.loud_reviews(spark, folder).select("review_id", "review_text")
    return sentiment.score_reviews(
        rows, lexicon=tables.LEXICON, boosters=tables.BOOSTERS, negations=tables.NEGATIONS, rules=_rules()
    ).drop("review_text")


def scored_with_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """All documents by a lexicon learnt from the labelled ones."""
    lexicon = sentiment.lexicon_from_labels(text_reviews(spark, folder))
    return sentiment.score_with_lexicon(
        tables.loud_reviews(spark, folder), lexicon, boosters=tables.BOOSTERS, negations=tables.NEGATIONS, rules=_rules()
    )


def attached(spark: SparkSession, folder: str) -> DataFrame:
    """Quality labels written to the documents as scores, matched by key."""
    labels = read(spark, folder, "labels").select(
        F.col("doc_id").alias("review_id"),
        (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment_compound"),
        F.col("quality").cast("double").alias("sentiment_positive"),
        F.lit(0.0).alias("sentiment_neutral"),
        F.col("toxic").cast("double").alias("sentiment_negative"),
        sentiment_label((F.col("quality") - F.col("toxic")).cast("double")).alias("sentiment_label"),
    )
    return sentiment.attach_scores(plain_reviews(spark, folder).drop("review_text"), labels)


def _built(build: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, folder: build(canonical_reviews(spark, folder)).select(*columns)


def _findings(by: str | None) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = rating_star(spark, folder)
        if by:
            data.keywords = tables.line_mentions(data)
            data.reviews = data.reviews.withColumn("month", tables.month_of_review())
        return insights.insights(data, by=by, threshold=tables.ATTENTION)

    return run


def platform_union(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as one platform's delivery and documents as another's, in one canonical frame."""
    maps = read(spark, folder, "lineitem").select(
        F.col("l_quantity").cast("string").alias("rating"), F.col("l_returnflag").alias("text"),
        F.col("l_partkey").cast("string").alias("gmap_id"), F.col("l_linestatus").alias("city"),
    )
    yelp = read(spark, folder, "documents").select(
        (F.col("doc_id") % 5 + 1).cast("string").alias("stars"), "text", F.col("source").alias("name"), F.col("lang").alias("city")
    )
    return roles.union_platforms({"google_maps": maps, "yelp": yelp}).select(
        "source", "rating", "review_text", "business_name", "city", "business_id"
    )


def sql_with_params(spark: SparkSession, folder: str) -> DataFrame:
    read(spark, folder, "lineitem").createOrReplaceTempView("parameterised_lines")
    text = "SELECT l_returnflag, count(*) AS n FROM parameterised_lines WHERE l_linestatus = :status AND l_linenumber >= :least GROUP BY l_returnflag"
    return warehouse.query(spark, text, {"status": "O", "least": 3})


def all_queries() -> dict[str, Query]:
    plain: dict[str, Query] = {
        "kpi_summary": _on_star(ratings.kpi_summary),
        "rating_distribution": _on_star(ratings.rating_distribution),
        "rating_distribution_raw": _on_star(ratings.rating_distribution_raw),
        "avg_rating_by_city": _on_star(ratings.average_by_city),
        "avg_rating_by_city_all": _on_star(ratings.average_by_city, limit=None),
        "avg_rating_by_category": _on_star(ratings.average_by_category),
        "top_businesses": _on_star(ratings.top_businesses),
        "bottom_businesses": _on_star(ratings.bottom_businesses),
        "top_businesses_with_city": _on_star(ratings.extreme_businesses_with_city, best=True),
        "bottom_businesses_with_city": _on_star(ratings.extreme_businesses_with_city, best=False),
        "needs_attention": _on_star(ratings.needs_attention, threshold=tables.ATTENTION),
        "monthly_volume": _on_star(trends.monthly_volume),
        "monthly_volume_year_only": _on_star(trends.monthly_volume_of_years),
        "monthly_avg_rating": _on_star(trends.monthly_average),
        "monthly_sentiment": _on_star(trends.monthly_sentiment),
        "city_performance": _on_star(ratings.city_performance),
        "category_performance": _on_star(ratings.category_performance),
        "category_volume": _on_star(ratings.category_volume, n=4),
        "overall_avg": _on_star(ratings.overall_average),
        "positive_share_by_category": _on_star(ratings.positive_share_by_category),
        "business_profile": _on_star(businesses.profile, tables.NAMES[0]),
        "business_profile_trend": _on_star(businesses.profile_trend, tables.NAMES[0]),
        "business_comparison": _on_star(businesses.comparison, tables.NAMES),
        "rating_gap": _on_star(businesses.rating_gap, *tables.NAMES),
        "sentiment_breakdown": _on_star(businesses.sentiment_breakdown, tables.NAMES),
        "rating_bands": _on_star(businesses.bands),
        "sentiment_counts": _on_star(ratings.sentiment_counts),
        "sentiment_share_labelled": _on_star(ratings.sentiment_counts, digits=None, labelled_only=True),
        "label_shares": lambda s, f: sentiment.label_shares(rating_star(s, f).reviews),
        "above_city_average": _on_star(ratings.above_city_average),
        "view_business_summary": _on_star(views.business_summary),
        "view_city_summary": _on_star(views.city_summary),
        "view_monthly_trends": _on_star(views.monthly_trends),
        "city_map": _on_star(views.city_map),
        "growth_rate": _on_star(trends.growth),
        "running_avg_rounded": _on_star(trends.running_average),
        "running_avg_raw": _on_star(trends.running_average, digits=None),
        "business_rank": _on_star(ratings.business_rank),
        "rank_in_city": _on_star(ratings.rank_in_city),
        "city_quartile_asc": _on_star(ratings.city_quartiles),
        "city_quartile_desc": _on_star(ratings.city_quartiles, descending=True),
        "best_city_per_category": _on_star(ratings.best_city_per_category),
        "declining_rounded": lambda s, f: ratings.declining_businesses(rating_star(s, f), _as_of()),
        "declining_raw": lambda s, f: ratings.declining_businesses(
            rating_star(s, f), _as_of(), min_reviews=10, digits=None, limit=None
        ),
        "volume_change": lambda s, f: trends.volume_change(trends.monthly_volume(rating_star(s, f))),
        "sample_reviews": _on_star(businesses.sample_reviews, sentiment="Negative", city_name="Brand#7", seed=7),
        "business_names": _on_star(businesses.business_names),
        "city_names": _on_star(businesses.city_names),
        "category_names": _on_star(businesses.category_names),
        "null_summary": lambda s, f: profiling.null_summary(rating_star(s, f).reviews),
        "value_frequency": lambda s, f: profiling.top_values(rating_star(s, f).reviews, "review_date", 20),
        "duplicate_rows": lambda s, f: profiling.duplicate_rows(read(s, f, "documents")),
        "profile_overview": lambda s, f: profiling.overview(read(s, f, "lineitem")),
        "scored_counts": _on_star(ratings.scored_counts),
        "clean_pages": clean_pages,
        "clean_reviews": cleaned,
        "cleaning_metrics": lambda s, f: cleaning.audit(raw_reviews(s, f)),
        "standardise_city": city_names_of,
        "parse_dates": parsed_dates,
        "build_cities": _built(star.build_cities, "city_id", "city_name"),
        "build_categories": _built(star.build_categories, "category_id", "category_name"),
        "build_businesses": _built(
            star.build_businesses, "business_id", "external_id", "name", "city_id", "category_id", "latitude", "source"
        ),
        "build_reviews": _built(
            star.build_reviews, "review_id", "business_id", "rating", "review_date", "review_year", "review_month", "source"
        ),
        "sample_exact": lambda s, f: exact_sample(read(s, f, "documents"), 500, key="doc_id"),
        "word_frequency": _on_plain_text(terms.word_frequency),
        "word_frequency_by_label": _on_text(terms.word_frequency_by_label),
        "theme_counts": _on_plain_text(terms.theme_counts, positive=tables.POSITIVE_WORDS, negative=tables.NEGATIVE_WORDS),
        "complaint_tags": tagged,
        "complaint_frequency": _on_text(complaints.frequency, complaints=tables.COMPLAINTS),
        "complaint_frequency_all": _on_plain_text(complaints.frequency, label_column=None, complaints=tables.COMPLAINTS),
        "busiest_businesses": _on_text(complaints.busiest, "business_name", 5),
        "business_complaints": _on_text(
            complaints.business_profile, "review_text", "business_name", top_n=5, complaints=tables.COMPLAINTS
        ),
        "phrase_mentions": lambda s, f: complaints.mentions_by_table(plain_reviews(s, f), tables.phrase_table(s, f), longest=2),
        "keyword_rows": _on_text(complaints.keyword_rows, tables.COMPLAINTS),
        "top_complaints": _on_star(feedback.top_complaints),
        "tfidf_keywords": _on_plain_text(terms.tfidf_keywords),
        "themes_by_label": _on_text(terms.themes_by_label),
        "platform_union": platform_union,
        "sql_with_params": sql_with_params,
        "sentiment_scores": scored,
        "sentiment_as_written": scored_as_written,
        "sentiment_with_lexicon": scored_with_lexicon,
        "learnt_lexicon": _on_text(sentiment.lexicon_from_labels),
        "attached_scores": attached,
        "insights": _findings(None),
        "insights_by_source": _findings("source"),
        "insights_by_month": _findings("month"),
        "recommendations": lambda s, f: insights.recommendations(_findings(None)(s, f)),
    }
    return {name: _wide(query) for name, query in plain.items()}
