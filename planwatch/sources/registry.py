"""Source systems by name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import datasource, html, records

READERS: dict[str, Callable] = {
    "html_calendar": html.calendar_meetings,
    "html_list": html.list_meetings,
    "html_agenda": html.agenda_documents,
    "html_list_agenda": html.list_documents,
    "oparl": records.oparl_meetings,
    "ckan": records.ckan_documents,
    "ckan_meetings": records.ckan_meetings,
    "rss": records.feed_articles,
    "link_list": records.press_links,
}


def reader(system: str) -> Callable:
    """The reader of a system's stored payloads; a system that there is none for is an error."""
    if system not in READERS:
        raise ValueError(f"no reader for the source system {system!r}; there are: {', '.join(sorted(READERS))}")
    return READERS[system]


def meetings(spark: SparkSession, path: str, source_id: str, system: str, start: dt.date, end: dt.date, **how: object) -> DataFrame:
    """The adapters' contract: a source's meetings from start to end, of the stored payloads below path. Only pages of those months are opened.

    how goes to the system's reader. A system without a calendar, or none at all, is an error; so is a page that isn't what its system sends.
    """
    read, pages = reader(system), datasource.payloads(spark, path, system, source_id, start, end, strict="true")
    days = F.lit(start), F.lit(end)
    if system == "oparl":
        rows = datasource.body_as(pages, f"data array<struct<{records.MEETING}>>")
        sound = records.checked(rows, F.col("error").isNull(), f"{source_id}: a page that isn't JSON of meetings")
        found = read(sound.select(F.inline("data")), source_id, *days)
    elif system == "ckan":
        rows = records.checked(datasource.body_as(pages, records.PACKAGE), F.col("error").isNull(), f"{source_id}: a page that isn't JSON of a search")
        found = records.ckan_meetings(rows, source_id, start=days[0], end=days[1], **how)
    elif system in ("html_calendar", "html_list"):
        found = read(pages.select(F.regexp_extract("page", r"(\d+)", 1).alias("page_id"), F.col("body").alias("html"), "month"), source_id, *days, **how)
    else:
        raise ValueError(f"{system} has no calendar")
    return records.checked_rows(found, records.MEETING_COLUMNS)
