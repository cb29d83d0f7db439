"""Profile of any table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.numbers import percent
from opinara.functions.words import row_digest


def null_summary(df: DataFrame) -> DataFrame:
    """Missing values per column: one aggregation row, turned into a row per column."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    )
    entries = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("null_count"), F.lit(kinds[c]).alias("dtype"))
                for c in df.columns
            ]
        )
    )
    return (
        counts.select("_rows", entries.alias("e"))
        .select(
            "e.column", "e.null_count", percent(F.col("e.null_count"), F.col("_rows"), 2).alias("null_pct"), "e.dtype"
        )
        .orderBy(F.desc("null_count"), "column")
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The most frequent values, a missing one counting as a value, with their share of all rows."""
    total = df.agg(F.count("*")).scalar()
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    return (
        counts.orderBy(F.desc("count"), F.asc_nulls_first("value"))
        .limit(n)
        .select("value", "count", percent(F.col("count"), total, 2).alias("pct"))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows; only digests of the rows are shuffled."""
    groups = df.select(row_digest(df.columns).alias("_row")).groupBy("_row").agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns and duplicate rows, from one grouping."""
    groups = df.select(row_digest(df.columns).alias("_row")).groupBy("_row").agg(F.count("*").alias("_n"))
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    return groups.agg(
        rows.alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        (rows - F.count("*")).alias("duplicate_rows"),
    )


def report(df: DataFrame, title: str, sample_rows: int = 5) -> str:
    """The profile as Markdown: overview, columns, a few rows."""
    facts = overview(df).first()
    lines = [
        f"# Data profile: {title}", "", "## Overview", "",
        f"- Rows: {facts['total_rows']:,}", f"- Columns: {facts['total_columns']:,}",
        f"- Duplicate rows: {facts['duplicate_rows']:,}", "", "## Columns", "",
        "| Column | Type | Nulls | Null % |", "|---|---|---|---|",
    ]
    lines += [
        f"| {r['column']} | {r['dtype']} | {r['null_count']:,} | {r['null_pct']} |" for r in null_summary(df).collect()
    ]
    lines += ["", "## Sample", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    for row in df.take(sample_rows):
        lines.append("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |")
    return "\n".join(lines) + "\n"


def write_report(df: DataFrame, title: str, path: str) -> None:
    """Stores the Markdown profile as a text file."""
    text = report(df, title)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
