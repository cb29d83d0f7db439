"""The star schema as Parquet folders."""

from __future__ import annotations

from dataclasses import dataclass, fields
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from opinara import schema


@dataclass(frozen=True)
class Star:
    """Three dimensions, the review fact and the complaint mentions."""

    cities: DataFrame
    categories: DataFrame
    businesses: DataFrame
    reviews: DataFrame
    keywords: DataFrame | None = None


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of a star table; columns the frame lacks are null."""
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.TABLES[table].fields
        ]
    )


def write_table(df: DataFrame, table: str, location: str, source: str | None = None) -> None:
    """Replaces a table, or what one ``source`` has in it, years that it no longer has included. Rebalancing evens out the
    files and splits a year that holds most of the rows."""
    keys = schema.PARTITION_COLUMNS.get(table, [])
    rows, path = conform(df, table), f"{location}/{table}"
    if source is not None:
        keys = [k for k in keys if k != "source"]
        rows, path = rows.drop("source"), f"{path}/source={quote(source)}"
    if keys:
        rows = rows.hint("rebalance", *keys)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def append_new(df: DataFrame, table: str, location: str) -> None:
    """Adds the rows whose key the stored dimension does not have yet."""
    key = schema.TABLES[table].fields[0].name
    rows = conform(df, table)
    known = read_table(df.sparkSession, table, location)
    if known is not None:
        rows = rows.join(known.select(key), key, "left_anti")
    rows.write.mode("append").parquet(f"{location}/{table}")


def write_keyed(df: DataFrame, table: str, path: str, key: str = "review_id", buckets: int | None = None) -> DataFrame:
    """Replaces the catalog table ``table`` at ``path``, bucketed and sorted by ``key``, one file per bucket, and reads it.

    Tables of the same number of buckets are joined by that key without a shuffle. The number is the session's shuffle
    partitions if not given; for large tables give one that makes a bucket a task's work.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(buckets, key)
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def read_table(spark: SparkSession, table: str, location: str) -> DataFrame | None:
    """A stored table, None if there is none. A business that several platforms know is one row: that of the first platform
    by the alphabet, whichever was loaded first."""
    try:
        stored = spark.read.schema(schema.TABLES[table]).parquet(f"{location}/{table}")
    except AnalysisException:
        return None
    columns = schema.TABLES[table].names
    if table != "businesses":
        return stored.select(*columns)
    merged = stored.groupBy(columns[0]).agg(F.min_by(F.struct(*columns[1:]), "source").alias("first"))
    return merged.select(columns[0], *[F.col(f"first.{c}").alias(c) for c in columns[1:]])


def read_star(spark: SparkSession, location: str) -> Star:
    return Star(**{f.name: read_table(spark, f.name, location) for f in fields(Star)})


def register(star: Star) -> None:
    """Temporary views under the table names, for SQL."""
    for f in fields(Star):
        table = getattr(star, f.name)
        if table is not None:
            table.createOrReplaceTempView(f.name)


def query(spark: SparkSession, text: str, params: dict | None = None) -> DataFrame:
    """A SQL text with ``:name`` markers over the registered views."""
    return spark.sql(text, args=params or {})
