"""Samples of an exact size, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import settings

def draw(key: Column, seed: int) -> Column:
    """A random-looking text per key and seed; the rows with the smallest ones are a random sample."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def _threshold(share: float) -> str:
    """The digest below which this share of all digests lies."""
    if share >= 1:
        return "g"  # above every hex digit
    return f"{int(max(0.0, share) * 2**128):032x}"


def _cut(digests: DataFrame, n: int, total: int) -> tuple[str, int, int]:
    """The ``n``-th smallest digest, how many are smaller and how many equal.

    The n-th lies near the share n / total: only digests within six standard deviations of it are told apart, the smaller
    ones are just counted and the others left out. Should the n-th lie outside, the range is made wider.
    """
    margin = 6 * n**0.5 + 16
    while True:
        low = _threshold((n - margin) / total)
        inside = digests.where(F.col("_draw") < _threshold((n + margin) / total))
        band = F.when(F.col("_draw") < low, "").otherwise(F.col("_draw")).alias("band")
        upto = F.sum("rows").over(Window.orderBy("band"))
        counts = inside.groupBy(band).agg(F.count("*").alias("rows")).withColumn("upto", upto)
        found = counts.where(F.col("upto") >= n).orderBy("band").first()
        if found is not None and found["band"]:
            return found["band"], found["upto"] - found["rows"], found["rows"]
        margin *= 4


def exact_sample(
    df: DataFrame, n: int, seed: int = settings.SAMPLE_SEED, key: str | Column | None = None
) -> DataFrame:
    """``n`` rows without replacement, or all rows when there are no more than that.

    The sample is the rows with the ``n`` smallest digests of their key. A count and one pass over the keys find the n-th
    smallest digest; the sample itself is a filter over ``df``, without a shuffle. With a unique ``key`` it is the same for
    every partitioning; of rows with equal keys, and without a key (the reading order is drawn), it depends on the files'
    order.
    """
    id_column = F.monotonically_increasing_id() if key is None else F.col(key) if isinstance(key, str) else key
    rows = df.withColumn("_draw", draw(id_column, seed))
    total = df.count()
    if total <= n:
        return df
    if n <= 0:
        return df.limit(0)
    last, smaller, equal = _cut(rows.select("_draw"), n, total)
    if smaller + equal == n:
        return rows.where(F.col("_draw") <= last).select(*df.columns)
    some = rows.where(F.col("_draw") == last).limit(n - smaller)
    return rows.where(F.col("_draw") < last).unionByName(some).select(*df.columns)
