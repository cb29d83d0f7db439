"""Ranks, tiles and top rows that do not gather a large group in one task.

Rows with equal values are counted first: a window over the values sees a row per value. Names that tie at one value are
counted per first letters, and only names that share those as well are numbered by a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
LETTERS = 4


def _edge(rows: DataFrame, group: str, level: Column, wanted: Column, best_first: Column) -> DataFrame:
    """Per group, the level in which the ``wanted``-th row lies and how many rows are wanted from that level; a group has a
    row here if it has any."""
    before = Window.partitionBy(group).orderBy(best_first).rowsBetween(*BEFORE)
    levels = rows.groupBy(group, level.alias("_level"), wanted.alias("_wanted")).agg(F.count("*").alias("_rows"))
    levels = levels.withColumn("_above", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(F.col("_above") < F.col("_wanted"))
    last = levels.groupBy(group).agg(F.max(F.struct("_above", "_level", "_wanted")).alias("_last"))
    missing = F.col("_last._wanted") - F.col("_last._above")
    return F.broadcast(last.select(group, F.col("_last._level").alias("_edge"), missing.alias("_missing")))


def top_k(df: DataFrame, group: str, measure: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the largest ``measure``; equal ones by the text ``tie``, which has to tell them apart.

    Counts of rows per measure show how far down the k-th lies. Of the rows with just that measure, counts per first letters
    show how far the alphabet reaches, and only the rows that begin with those letters are numbered. One row per group is
    broadcast, so there have to be few groups.
    """
    start = F.substring(tie, 1, LETTERS)
    placed = df.join(_edge(df, group, F.col(measure), F.lit(k), F.desc("_level")), group)
    above = placed.where(F.col(measure) > F.col("_edge")).drop("_edge", "_missing")
    level = placed.where(F.col(measure) == F.col("_edge")).drop("_edge").withColumnRenamed("_missing", "_wanted")
    level = level.join(_edge(level, group, start, F.col("_wanted"), F.asc("_level")), group).drop("_wanted")
    sure = level.where(start < F.col("_edge")).drop("_edge", "_missing")
    numbered = level.where(start == F.col("_edge")).withColumn("_number", F.row_number().over(Window.partitionBy(group).orderBy(tie)))
    return above.unionByName(sure).unionByName(numbered.where(F.col("_number") <= F.col("_missing")).drop("_edge", "_missing", "_number"))


def dense_rank_of_levels(df: DataFrame, value: str, name: str) -> DataFrame:
    """Dense rank, highest first, of a value with few distinct levels (a rating rounded to two places has 401).

    Only the levels are ranked, and the ranked levels are sent to the rows.
    """
    levels = df.select(value).distinct()
    ranked = levels.withColumn(name, F.dense_rank().over(Window.orderBy(F.col(value).desc())).cast("bigint"))
    level = ranked.withColumnRenamed(value, "_level")
    return df.join(level, F.col(value).eqNullSafe(F.col("_level"))).drop("_level")


def rank_within(df: DataFrame, group: str, value: str, name: str, width: float = 1e-4) -> DataFrame:
    """``rank()`` per group by a bounded value, highest first, for groups of any size.

    Equal values are counted first. The distinct values of a group are ranked inside narrow value ranges, and
    each range adds the rows in the ranges above it; a group has as many ranges as fit between the limits of the
    value. The rank goes back to the rows by group and value, a join that Spark splits where one key is hot.
    """
    levels = (
        df.groupBy(group, value)
        .agg(F.count("*").alias("_ties"))
        .withColumn("_range", F.floor(F.col(value) / F.lit(width)))
    )
    before = (Window.unboundedPreceding, -1)
    ranges = (
        levels.groupBy(group, "_range")
        .agg(F.sum("_ties").alias("_rows"))
        .withColumn("_above", F.sum("_rows").over(Window.partitionBy(group).orderBy(F.desc("_range")).rowsBetween(*before)))
        .drop("_rows")
    )
    inside = F.sum("_ties").over(Window.partitionBy(group, "_range").orderBy(F.desc(value)).rowsBetween(*before))
    ranked = levels.withColumn("_inside", inside).join(ranges, [group, "_range"])
    rank = (F.lit(1) + F.coalesce("_above", F.lit(0)) + F.coalesce("_inside", F.lit(0))).cast("bigint")
    return df.join(ranked.select(group, value, rank.alias(name)), [group, value])


def tiles(df: DataFrame, n: int, value: str, tie: str, name: str, descending: bool = False) -> DataFrame:
    """``ntile(n)`` over all rows by ``value``, then by the text ``tie``: sizes differ by one at most, larger tiles come first.

    A row's place is the number of rows with values before its own, those with its value and earlier first letters, and its
    place among the rest. There are few values when they are counts: their sum is the number of what was counted.
    """
    levels = df.groupBy(value).agg(F.count("*").alias("_rows"))
    whole, by_value = Window.partitionBy(), Window.orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(*BEFORE)
    levels = levels.select(
        F.col(value).alias("_value"), F.coalesce(F.sum("_rows").over(by_value), F.lit(0)).alias("_lower"), F.sum("_rows").over(whole).alias("_total")
    )
    rows = df.withColumn("_start", F.substring(tie, 1, LETTERS))
    letters = rows.groupBy(value, "_start").agg(F.count("*").alias("_rows"))
    earlier = F.sum("_rows").over(Window.partitionBy(value).orderBy("_start").rowsBetween(*BEFORE))
    letters = letters.select(value, "_start", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    here = F.row_number().over(Window.partitionBy(value, "_start").orderBy(tie))
    numbered = rows.join(letters, [value, "_start"]).withColumn("_here", here).join(levels, F.col(value) == F.col("_value"))
    at = F.col("_lower") + F.col("_earlier") + F.col("_here") - 1
    size, larger = F.floor(F.col("_total") / n), F.col("_total") % n
    in_larger = larger * (size + 1)
    tile = F.when(at < in_larger, F.floor(at / (size + 1)) + 1).otherwise(
        larger + F.floor(F.try_divide(at - in_larger, size)) + 1
    )
    return numbered.select(*df.columns, tile.cast("bigint").alias(name))
