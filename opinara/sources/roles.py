"""From the columns a platform delivers to the canonical review frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import schema, settings
from opinara.sources.files import ORDER, SPELLING


def find_role(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate that is a column; upper and lower case differ."""
    present = set(columns)
    return next((name for name in candidates if name in present), None)


def resolve_roles(df: DataFrame, platform: str = settings.DEFAULT_SOURCE) -> dict[str, str | None]:
    return {role: find_role(df.columns, names) for role, names in settings.PLATFORMS[platform].items()}


def canonical(df: DataFrame, platform: str = settings.DEFAULT_SOURCE, source: str | None = None) -> DataFrame:
    """The ten role columns with fixed types, plus source, review key and reading order.

    A role without a column is null; a date that has been parsed stays a date.
    """
    roles = resolve_roles(df, platform)
    typed = []
    for role, kind in schema.ROLES.items():
        name = roles[role]
        if name is None:
            column = F.lit(None).cast("date" if role == "date" else kind)
        elif role == "date":
            column = F.col(f"`{name}`")
        else:
            column = F.col(f"`{name}`").try_cast(kind)
        typed.append(column.alias(role))
    kept = [F.col(c) for c in ("review_id", ORDER, SPELLING) if c in df.columns]
    return df.select(*kept, *typed, F.lit(source or platform).alias("source"))


def union_platforms(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One canonical frame out of one raw or cleaned frame per platform.

    Reading orders follow the platforms' order here, then each platform's own.
    """
    parts = []
    for place, (platform, df) in enumerate(frames.items()):
        part = canonical(df, platform)
        if ORDER in part.columns:
            own = F.col(ORDER).cast("decimal(20,0)")
            part = part.withColumn(ORDER, (F.lit(str(place << 63)).cast("decimal(38,0)") + own).cast("decimal(38,0)"))
        parts.append(part)
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)
