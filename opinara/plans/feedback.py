"""Complaints as stored in the mentions table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.complaints import ranked_shares
from opinara.sources.warehouse import Star


def top_complaints(star: Star, digits: int | None = None) -> DataFrame:
    """Mentions per category with their share of all mentions, most frequent first."""
    known = star.keywords.where("complaint_category IS NOT NULL")
    counts = known.groupBy(F.col("complaint_category").alias("category")).agg(F.count("*").alias("count"))
    return ranked_shares(counts, "category", digits)
