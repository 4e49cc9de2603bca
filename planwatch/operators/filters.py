"""Row predicates and filters. A predicate is a column; a filter takes and gives a frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import text as T


def relevant_meeting(committee: Column, cancelled: Column, patterns: Sequence[str] = D.COMMITTEE_PATTERNS) -> Column:
    """Not cancelled, and of a committee that a pattern finds."""
    return ~F.coalesce(cancelled, F.lit(False)) & T.matches_any(committee, patterns)


def within(day: Column, start: Column, end: Column) -> Column:
    return day.between(start, end)


def is_public(flag: Column) -> Column:
    """Public unless said otherwise: a missing flag counts as public."""
    return F.coalesce(flag, F.lit(True))


def excluded_domain(host: Column, domains: Sequence[str] = D.EXCLUDED_DOMAINS) -> Column:
    return reduce(lambda a, d: a | (host == d) | F.endswith(host, F.lit("." + d)), domains, F.lit(False))


def small_ownership(tenure: Column, units: Column, least: int = D.OWNERSHIP_LEAST_UNITS) -> Column:
    """Homes for sale alone, and known to be fewer than least."""
    return (tenure == "EIGENTUM") & units.isNotNull() & (units < least)


def needs_analysis(status: Column, failures: Column, most_failures: int = 3) -> Column:
    return status.isin(*D.UNSETTLED) & ~((status == "FEHLER") & (failures >= most_failures))


def unclear(units: Sequence[Column], tenure: Column) -> Column:
    return F.coalesce(*units).isNull() | (tenure == "UNKLAR")


def found_by_machine(source: Column, origin: Column, manual_sources: Sequence[str]) -> Column:
    return ~source.isin(*manual_sources) & (F.coalesce(origin, F.lit("radar")) == "radar")


def of_municipality(municipality: Column, place: Column, name: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", F.coalesce(municipality, F.lit("")), F.coalesce(place, F.lit("")))), F.lit(name.lower()))


def multi_filter(df: DataFrame, chosen: Mapping[str, Sequence | None]) -> DataFrame:
    """Rows whose columns have one of the values chosen for them; nothing chosen is no condition."""
    for name, values in chosen.items():
        if values:
            df = df.where(F.col(name).isin(*values))
    return df


def search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows in one of whose columns the query stands literally, case ignored; an empty query finds all."""
    query = query.strip().lower()
    if not query:
        return df
    hits = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(query)) for c in columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def web_filter(df: DataFrame, chosen: Mapping[str, Sequence | None], distance: str, most_km: float | None = None, units: str | None = None) -> DataFrame:
    """multi_filter, at most most_km away, and with units known if a column is named for them."""
    df = multi_filter(df, chosen)
    if most_km is not None:
        df = df.where(F.col(distance) <= most_km)
    return df.where(F.col(units).isNotNull()) if units else df


def open_meetings(meetings: DataFrame, documents: DataFrame, today: Column, since: Column, minutes: str = "niederschrift", requires_minutes: str | None = None) -> DataFrame:
    """Past meetings since a day, not cancelled, that lack a page or minutes.

    meetings: meeting_id, date, url, cancelled; documents: meeting_id, kind. requires_minutes: a boolean column of
    meetings, for sources that never have any.
    """
    has = documents.where(F.col("kind") == minutes).select(F.col("meeting_id").alias("k")).distinct()
    rows = meetings.join(has, F.col("meeting_id") == F.col("k"), "left")
    lacks = F.col("k").isNull() & (F.coalesce(F.col(requires_minutes), F.lit(True)) if requires_minutes else F.lit(True))
    rows = rows.where((F.col("date") < today) & (F.col("date") >= since) & ~F.coalesce("cancelled", F.lit(False)))
    return rows.where(F.col("url").isNull() | lacks).drop("k")


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns named that df has, in that order."""
    return df.select(*[c for c in columns if c in df.columns])
