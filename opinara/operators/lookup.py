"""Joining words of texts with a table of words, where a few words make up most of all texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that every task holds at most; no other word has more than one row in so many.
FREQUENT = 100_000
#: Hash values by which most words that no entry has are left out before anything is shuffled.
SLOTS = 1 << 21


def _slot(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).alias("_slot")


def _possible(rows: DataFrame, taken: DataFrame, word: str) -> DataFrame:
    """The rows whose word shares its slot with an entry; there are ``SLOTS`` numbers to broadcast at most."""
    return rows.withColumn("_slot", _slot(word)).join(F.broadcast(taken), "_slot", "left_semi").drop("_slot")


def look_up(
    rows: DataFrame, entries: DataFrame, word: str, counted: DataFrame | None = None, always: Column | None = None, slim: Sequence[Column | str] | None = None
) -> DataFrame:
    """``rows`` with a word among the ``entries``, an inner join; rows for which ``always`` holds are kept anyway.

    ``entries`` has a row per word, of any number, and no nulls. ``counted`` has the words to count if not those of ``rows``; of
    ``rows`` the columns ``slim`` are kept, which is what has to be shuffled. Words that no entry can have, by their slot, are left
    out first. The most frequent words, ``FREQUENT`` at most, reach every task by broadcast, with what the entries say of
    them: their rows stay where they are. The other words' rows are joined with the entries by a shuffle.
    """
    always = F.lit(False) if always is None else always
    slim = [c for c in rows.columns if c != word] if slim is None else list(slim)
    values = [c for c in entries.columns if c != word]
    taken = entries.select(_slot(word)).distinct()
    counted = (rows if counted is None else counted).where(F.col(word).isNotNull())
    counts = _possible(counted.select(word), taken, word).groupBy(word).agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy().orderBy(F.desc("_rows"))  # a row per count, not per word
    levels = counts.groupBy("_rows").agg(F.count("*").alias("_words")).withColumn("_words", F.sum("_words").over(whole))
    often = counts.join(F.broadcast(levels.where(F.col("_words") <= FREQUENT).select("_rows")), "_rows", "left_semi")
    often = often.orderBy(F.desc("_rows"), word).limit(FREQUENT)  # says so to Spark; there are no more
    often = F.broadcast(often.join(entries, word, "left").select(word, F.lit(True).alias("_often"), *values))  # FREQUENT rows
    split = rows.join(often, word, "left")
    near = split.where(always | F.col(values[0]).isNotNull()).select(word, *slim, *values)
    rest = split.where(~always & F.col("_often").isNull()).drop("_often", *values)
    rest = _possible(rest, taken, word).select(word, *slim).join(entries, word)
    return near.unionByName(rest)
