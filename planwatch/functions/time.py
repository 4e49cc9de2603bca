"""Calendar functions as columns. The day of reference is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..defaults import ZONE


def months_on(day: Column, months: int) -> Column:
    """The day so many months on, at most the month's last."""
    return F.add_months(day, months)


def next_slot(now: Column, weekday: int, hour: int, minute: int = 0) -> Column:
    """The next timestamp after now on that weekday (Monday: 0) at that time; now itself counts as past."""
    today = F.date_trunc("day", now)
    days = F.pmod(F.lit(weekday) - F.weekday(now), F.lit(7))
    at = F.timestamp_add("MINUTE", F.lit(60 * hour + minute), F.timestamp_add("DAY", days, today))
    return F.when(at > now, at).otherwise(F.timestamp_add("DAY", F.lit(7), at))


def local_format(instant: Column, pattern: str = "dd.MM.yyyy HH:mm", zone: str = ZONE) -> Column:
    """A UTC time in the zone's clock, as text; a dash for null."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(instant, zone), pattern), F.lit("–"))


def whole_days(since: Column, now: Column) -> Column:
    """Full 24 hours between two instants."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(since)) / 86400).cast("int")


def days_ago(since: Column, now: Column) -> Column:
    n = whole_days(since, now)
    return F.when(n <= 0, F.lit("heute")).when(n == 1, F.lit("gestern")).otherwise(F.concat(F.lit("vor "), n.cast("string"), F.lit(" Tagen")))
