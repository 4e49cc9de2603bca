"""Key figures, counts, leads, monitoring and change sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import time as TM


def key_figures(df: DataFrame, open_statuses: Sequence[str], units: str = "units", subsidised: str = "units_subsidised", status: str = "status", lead: str = "lead") -> DataFrame:
    """One row: projects, sums of homes (null if none is known), open ones and leads."""
    return df.agg(
        F.count("*").alias("projects"),
        F.sum(units).alias("units"),
        F.sum(subsidised).alias("units_subsidised"),
        F.count_if(F.col(status).isin(*open_statuses)).alias("open"),
        F.count_if(F.coalesce(F.col(lead), F.lit("")) != "").alias("leads"),
    )


def provenance(df: DataFrame, source: str, real: Sequence[str]) -> DataFrame:
    """One row: how many rows are from the sources of real ones, and how many are invented (any other source, or none)."""
    own = F.coalesce(F.col(source).isin(*real), F.lit(False))
    return df.agg(F.count_if(own).alias("real"), F.count_if(~own).alias("invented"))


def count_by_status(df: DataFrame, status: str, order: Sequence[str]) -> DataFrame:
    """status, n, position: the statuses of the pipeline in its order, then others by name."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(status))
    return df.groupBy(status).agg(F.count("*").alias("n")).withColumn("position", F.when(place > 0, place).otherwise(F.lit(len(order) + 1))).orderBy("position", status)


def sum_or_zero(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum for each key, zero where no value is known; greatest first."""
    return df.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total")).orderBy(F.desc("total"), key)


def run_counters(df: DataFrame, by: str, flags: Mapping[str, Column], distinct: Mapping[str, str]) -> DataFrame:
    """Rows, flagged rows and distinct values for each key."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()], *[F.countDistinct(c).alias(k) for k, c in distinct.items()]
    )


def daily_usage(log: DataFrame, at: str) -> DataFrame:
    return log.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


def usage_on(log: DataFrame, at: str, day: Column) -> DataFrame:
    """The count of one day; zero if there was none."""
    return log.where(F.to_date(at) == day).agg(F.count("*").alias("n"))


def documents_by_paper(docs: DataFrame, paper: str, position: str, columns: Sequence[str], meeting: str | None = None) -> DataFrame:
    """Per paper its documents in order and its first number that isn't null. Documents without a paper are the meeting's own: with meeting
    named, papers are told apart by it, so that these don't fall into one row for all meetings."""
    whole = F.sort_array(F.collect_list(F.struct(position, *columns)))
    return docs.groupBy(*([meeting] if meeting else []), paper).agg(whole.alias("documents"), F.min_by("number", F.when(F.col("number").isNotNull(), F.col(position))).alias("number"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def short_term_leads(df: DataFrame, key: str, units: str = "units", status: str = "status") -> DataFrame:
    """Rows with a lead badge that aren't archived: permits, applications, hints; larger ones first, unknown sizes last."""
    order = F.array(*[F.lit(b) for b in (D.BADGE_PERMIT, D.BADGE_APPLICATION, D.BADGE_HINT)])
    rows = df.where((F.col("lead") != "") & (F.coalesce(F.col(status), F.lit("")) != D.ARCHIVED))
    return rows.orderBy(F.array_position(order, F.col("lead")), F.col(units).desc_nulls_last(), key)


def web_leads(df: DataFrame, key: str, units: str = "units", status: str = "status") -> DataFrame:
    """Finds with a phase that aren't archived: started buildings first, then permits; larger ones first."""
    rows = df.where(F.col("phase").isin(*D.PHASE_RANK) & (F.coalesce(F.col(status), F.lit("")) != D.ARCHIVED))
    return rows.orderBy((F.col("phase") != "BAUBEGINN").cast("int"), F.col(units).desc_nulls_last(), key)


def oldest_open(open_meetings: DataFrame) -> DataFrame:
    """source_id, oldest_open: the earliest of each source's open meetings."""
    return open_meetings.groupBy("source_id").agg(F.min("date").alias("oldest_open"))


def distinct_warnings(log: DataFrame, source: str, text: str, position: str) -> DataFrame:
    """source, warnings array: each warning once, where it first came up."""
    first = log.groupBy(source, text).agg(F.min(position).alias("__at"))
    return first.groupBy(source).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", text))), lambda w: w[text]).alias("warnings"))


def projects_by_change(projects: DataFrame, status: str | None = None) -> DataFrame:
    """Projects, those of a status if one is named, the last changed first."""
    rows = projects.where(F.col("status") == status) if status is not None else projects
    return rows.orderBy(F.col("updated_at").desc_nulls_last(), "id")


def sources_by_name(sources: DataFrame) -> DataFrame:
    return sources.orderBy("name", "source_id")


def status_log(log: DataFrame, project_id: int) -> DataFrame:
    """A project's status changes, the oldest first."""
    return log.where(F.col("project_id") == project_id).orderBy("changed_at", "new_status")


def finds_by_distance(finds: DataFrame) -> DataFrame:
    """Finds, the nearest first (unknown distances before all), then the last changed."""
    return finds.orderBy(F.col("distance_km").asc_nulls_first(), F.col("updated_at").desc_nulls_last(), "id")


def source_monitor(sources: DataFrame) -> DataFrame:
    """sources (name, last_run, last_success, last_error) with state and local times."""
    state = (
        F.when(F.col("last_run").isNull(), F.lit("never run"))
        .when(F.col("last_error").isNotNull() & (F.col("last_success").isNull() | (F.col("last_error") > F.col("last_success"))), F.lit("error"))
        .otherwise(F.lit("ok"))
    )
    return sources.withColumn("state", state).withColumn("last_run_local", TM.local_format(F.col("last_run"))).withColumn("last_success_local", TM.local_format(F.col("last_success")))


def last_run_notice(sources: DataFrame, now: Column, most_days: int = 14) -> DataFrame:
    """last_run, warn, age of the latest run of all sources; a warning if there was none or it is older than most_days."""
    last = sources.agg(F.max("last_run").alias("last_run"))
    return last.withColumn("warn", F.col("last_run").isNull() | (TM.whole_days(F.col("last_run"), now) > most_days)).withColumn("age", TM.days_ago(F.col("last_run"), now))


def changes(original: DataFrame, edited: DataFrame, key: str, statuses: Sequence[str] | None = None, most_note: int = 2000) -> DataFrame:
    """key, status, notes of edited rows that differ from the original of the same key; unknown keys are left out.

    A status that isn't one of statuses goes back to the original's; notes are cut.
    """
    old = original.select(key, F.col("status").alias("old_status"), F.col("notes").alias("old_notes"))
    rows = edited.select(key, "status", F.substring("notes", 1, most_note).alias("notes")).join(old, key)
    if statuses:
        rows = rows.withColumn("status", F.when(F.col("status").isin(*statuses), F.col("status")).otherwise(F.col("old_status")))
    return rows.where(~F.col("status").eqNullSafe(F.col("old_status")) | ~F.col("notes").eqNullSafe(F.col("old_notes"))).select(key, "status", "notes")


def papers_of_project(bridge: DataFrame, papers: DataFrame, meetings: DataFrame) -> DataFrame:
    """The papers of projects with their meetings, by date."""
    return bridge.join(papers, "paper_id").join(meetings, "meeting_id").orderBy("project_id", "date", "paper_id")


def unknown_requested(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return requested.join(known.select(key).distinct(), key, "left_anti")
