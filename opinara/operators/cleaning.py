"""Cleaning of a raw review frame, step by step, and the audit of those steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from opinara import settings
from opinara.functions import dates, numbers, text
from opinara.functions.words import row_digest
from opinara.sources.files import ORDER, SPELLING, with_order
from opinara.sources.roles import resolve_roles

COPIES = "_copies"


class CleaningCounts:
    """The audit's counts, observed by the job that writes the cleaned rows.

    Spark takes what a task observed once, when the first of its attempts succeeds, in the last stage of a job; the counts stand
    behind the only shuffle of :func:`clean`, so they are in that stage, and tasks that are lost and run again count once.
    Another shuffle between cleaning and the write would end that.
    """

    def __init__(self) -> None:
        self.distinct, self.kept = Observation(), Observation()

    def found(self) -> dict[str, int]:
        """All counts; waits for the first job on the cleaned rows."""
        return {**self.distinct.get, **self.kept.get}


def collapse_copies(df: DataFrame) -> DataFrame:
    """One row per distinct row, nulls being equal, with the number of copies and the first reading order.

    Copies meet in the map-side aggregation already, so a row that is repeated millions of times reaches the
    shuffle once per task.
    """
    ordered = df if ORDER in df.columns else with_order(df)
    columns = [c for c in ordered.columns if c != ORDER]
    return ordered.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(
        F.count("*").alias(COPIES), F.min(ORDER).alias(ORDER)
    )


def with_review_id(df: DataFrame, platform: str = settings.DEFAULT_SOURCE) -> DataFrame:
    """Key of a distinct raw row: a digest of the platform and all its values, the same on every run."""
    columns = [c for c in df.columns if c not in (ORDER, COPIES)]
    return df.withColumn("review_id", row_digest(columns, F.lit(platform)))


def keep_valid_ratings(df: DataFrame, column: str) -> DataFrame:
    return df.where(numbers.is_valid_rating(F.col(column))).withColumn(column, numbers.to_number(F.col(column)))


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(~text.is_blank(F.col(column)))


def normalise_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.normalise(F.col(column)))


def standardise_city(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.standard_city(F.col(column)))


def parse_dates(df: DataFrame, column: str, unit: str | None = None) -> DataFrame:
    return df.withColumn(column, dates.parse_date(F.col(column), unit))


def fill_unknown(df: DataFrame) -> DataFrame:
    """``Unknown`` for what is missing in text columns; dates and numbers stay null."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name != SPELLING]
    return df.na.fill(settings.UNKNOWN, subset=texts)


def _required_roles(raw: DataFrame, platform: str) -> dict[str, str | None]:
    roles = resolve_roles(raw, platform)
    for role in ("rating", "review_text"):
        if roles[role] is None:
            raise ValueError(f"no {role} column; expected one of {settings.PLATFORMS[platform][role]}")
    return roles


def _free_texts(raw: DataFrame, roles: dict[str, str | None]) -> list[str]:
    """Text columns that are filled and otherwise left as they are."""
    keyed = {roles[r] for r in ("rating", "date", "city", "review_text", "latitude", "longitude")}
    return [f.name for f in raw.schema.fields if f.dataType.typeName() == "string" and f.name not in keyed]


def clean(
    raw: DataFrame, platform: str = settings.DEFAULT_SOURCE, date_unit: str | None = None, counts: CleaningCounts | None = None
) -> DataFrame:
    """The raw columns cleaned in place, one row per review kept, with ``review_id`` and reading order.

    With ``counts``, the first job on the result fills them, and the city's spelling stays as a column of its own.
    """
    roles = _required_roles(raw, platform)
    rows = collapse_copies(raw).transform(with_review_id, platform)
    if counts:
        valid = numbers.is_valid_rating(F.col(roles["rating"]))
        seen = {"initial_rows": F.col(COPIES), "distinct_rows": F.lit(1), "valid_rating_rows": numbers.flag(valid)}
        rows = rows.observe(counts.distinct, *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in seen.items()])
        rows = rows.withColumn(SPELLING, F.col(roles["city"]) if roles["city"] else F.lit(None).cast("string"))
    rows = (
        rows.drop(COPIES)
        .transform(keep_valid_ratings, roles["rating"])
        .transform(drop_blank, roles["review_text"])
        .transform(normalise_text, roles["review_text"])
    )
    if roles["city"]:
        rows = standardise_city(rows, roles["city"])
    if roles["date"]:
        rows = parse_dates(rows, roles["date"], date_unit)
    for place in ("latitude", "longitude"):
        if roles[place]:
            rows = rows.withColumn(roles[place], numbers.to_number(F.col(roles[place])))
    if counts:
        missing = {"null_dates": F.col(roles["date"])} if roles["date"] else {}
        missing |= {f"filled_{name}": F.col(f"`{name}`") for name in _free_texts(raw, roles)}
        nulls = [F.count(F.when(c.isNull(), 1)).alias(name) for name, c in missing.items()]
        rows = rows.observe(counts.kept, F.count(F.lit(1)).alias("final_rows"), *nulls)
    return fill_unknown(rows)


def audit(raw: DataFrame, platform: str = settings.DEFAULT_SOURCE, date_unit: str | None = None) -> DataFrame:
    """One row of counts: rows before and after each step, dates lost, fills, city spellings, retention.

    Copies are found by a digest of the whole row, so only digests, flags and city spellings are shuffled, never texts.
    All counts are summed over the distinct raw rows, per city spelling first. They are result columns, not
    accumulators: a task that runs twice does not count twice.
    """
    roles = _required_roles(raw, platform)
    valid = numbers.is_valid_rating(F.col(roles["rating"]))
    kept = valid & ~text.is_blank(F.col(roles["review_text"]))
    flags = {"valid_rating_rows": valid, "final_rows": kept}
    if roles["date"]:
        flags["null_dates"] = kept & dates.parse_date(F.col(roles["date"]), date_unit).isNull()
    for name in _free_texts(raw, roles):
        flags[f"filled_{name}"] = kept & F.col(f"`{name}`").isNull()
    spelling = F.col(roles["city"]) if roles["city"] else F.lit(None).cast("string")
    digest = row_digest([c for c in raw.columns if c != ORDER])
    slim = raw.select(digest.alias("_digest"), spelling.alias("_city"), *[numbers.flag(f).alias(name) for name, f in flags.items()])
    distinct = slim.groupBy("_digest", "_city", *flags).agg(F.count("*").alias("initial_rows"))
    counts = ["initial_rows", "distinct_rows", *flags]
    per_spelling = distinct.withColumn("distinct_rows", F.lit(1)).groupBy("_city").agg(*[F.sum(name).alias(name) for name in counts])
    totals = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts]
    if roles["city"]:
        used = F.when(F.col("final_rows") > 0, F.col("_city"))
        standard = F.when(F.col("final_rows") > 0, text.standard_city(F.col("_city")))
        totals += [F.count(used).alias("cities_before"), F.count_distinct(standard).alias("cities_after")]
    return _summary(per_spelling.agg(*totals))


def _summary(found: DataFrame) -> DataFrame:
    """Rows lost at each step, and the share left, from the rows counted before and after."""
    first, last = F.col("initial_rows"), F.col("final_rows")
    return found.select(
        "initial_rows",
        (first - F.col("distinct_rows")).alias("duplicates_removed"),
        (F.col("distinct_rows") - F.col("valid_rating_rows")).alias("invalid_ratings_removed"),
        (F.col("valid_rating_rows") - last).alias("blank_reviews_removed"),
        "final_rows",
        (first - last).alias("total_rows_removed"),
        numbers.percent(last, first, 2).alias("retention_pct"),
        *[name for name in found.columns if name.startswith(("null_", "cities_", "filled_"))],
    )


def observed_audit(counts: CleaningCounts, cleaned: DataFrame, platform: str = settings.DEFAULT_SOURCE) -> DataFrame:
    """The row of :func:`audit` from observed ``counts`` and the stored ``cleaned`` rows, of which only cities are read."""
    found = counts.found()
    cities = [F.count_distinct(SPELLING).alias("cities_before"), F.count_distinct(text.standard_city(F.col(SPELLING))).alias("cities_after")]
    return _summary(cleaned.agg(*cities).select(*[F.lit(n).cast("bigint").alias(name) for name, n in found.items()], "*"))


def log_document(
    raw: DataFrame, platform: str = settings.DEFAULT_SOURCE, source_file: str | None = None,
    sample_size: int | None = None, date_unit: str | None = None, counts: CleaningCounts | None = None, cleaned: DataFrame | None = None,
) -> DataFrame:
    """The audit with what it was run on: file, columns, roles, limits, and the first three parsed dates.

    With ``counts`` and the stored canonical rows ``cleaned``, nothing is cleaned for it.
    """
    roles = _required_roles(raw, platform)
    dated = []
    if roles["date"]:
        rows = raw if ORDER in raw.columns else with_order(raw)
        days = rows.select(dates.parse_date(F.col(roles["date"]), date_unit).alias("day"), ORDER) if cleaned is None else cleaned.select(F.col("date").alias("day"), ORDER)
        dated = [str(row["day"]) for row in days.where("day IS NOT NULL").orderBy(ORDER).limit(3).collect()]
    found = audit(raw, platform, date_unit) if cleaned is None else observed_audit(counts, cleaned, platform)

    def texts(values: Sequence[str]) -> F.Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return found.select(
        F.lit(source_file).alias("source_file"),
        F.lit(sample_size).cast("bigint").alias("sample_size"),
        texts([c for c in raw.columns if c != ORDER]).alias("initial_columns"),
        F.struct(*[F.lit(name).cast("string").alias(role) for role, name in roles.items()]).alias("column_roles"),
        F.array(F.lit(settings.RATING_MIN), F.lit(settings.RATING_MAX)).alias("rating_range"),
        texts(["html_strip", "encoding_fix", "whitespace_collapse"]).alias("text_operations"),
        texts(dated).alias("sample_dates"),
        "*",
    )
