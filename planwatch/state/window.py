"""Scan windows and high-water marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_windows(sources: DataFrame, today: Column, overlap_weeks: int = 6, months_back: int = 6, months_ahead: int = 3) -> DataFrame:
    """sources (covered_from, backfill_from, last_success, oldest_open dates) with start and end of the next scan.

    Back to the backfill day until it is covered, else to the last success less the overlap, else some months; at least the
    overlap, and always to the oldest open meeting.
    """
    overlap = 7 * overlap_weeks
    backfill = F.col("backfill_from").isNotNull() & (F.col("covered_from").isNull() | (F.col("covered_from") > F.col("backfill_from")))
    start = (
        F.when(backfill, F.col("backfill_from"))
        .when(F.col("last_success").isNotNull(), F.date_sub("last_success", overlap))
        .otherwise(F.add_months(today, -months_back))
    )
    return sources.withColumn("start", F.least(start, F.date_sub(today, overlap), F.col("oldest_open"))).withColumn("end", F.add_months(today, months_ahead))


def may_move_mark(covered_from: Column, end: Column, today: Column) -> Column:
    """Whether a slice scanned by hand joins what is covered; the first one must reach today."""
    return F.when(covered_from.isNull(), end >= today).otherwise(end >= F.date_sub(covered_from, 1))


def earlier(old: Column, new: Column) -> Column:
    return F.least(old, new)
