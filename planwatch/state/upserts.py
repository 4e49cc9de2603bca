"""Rule tables of the domain's tables, and merges that need more than rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..operators.filters import needs_analysis
from .snapshot import merged

MEETING_KEYS = ("source_id", "external_id")
MEETING_RULES = {c: "overwrite" for c in ("committee", "date", "time", "place", "url", "cancelled")}
DOCUMENT_KEYS = ("source_id", "external_id")
DOCUMENT_RULES = {c: "overwrite" for c in ("meeting_id", "paper_id", "title", "kind", "url")} | {"sha256": "keep", "path": "keep"}
PROJECT_KEYS = ("source_id", "project_key")
EXTRACTED = ("name", "street", "number", "parcel", "place", "units", "units_rent", "units_subsidised", "subsidised_share", "period", "applicant", "summary", "tenure", "stage", "confidence", "quote", "page")
PROJECT_RULES = {c: "overwrite" for c in EXTRACTED} | {c: "keep" for c in ("status", "notes", "source_url", "origin")}
FIND_KEYS = ("url",)
FIND_RULES = (
    {"title": "overwrite", "excerpt": "overwrite", "phase": "rank", "units": "fill", "quote": "with:units", "published": "fill", "tenure": "unless:UNKLAR"}
    | {c: "keep" for c in ("domain", "place", "state", "distance_km", "query", "status", "notes")}
)
SOURCE_KEYS = ("source_id",)
SOURCE_RULES = {"last_run": "overwrite", "last_success": "fill", "last_error": "fill", "error": "overwrite", "covered_from": "least"}


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table and those of rows whose keys it lacks, once each."""
    return table.unionByName(rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti"))


def upsert_meetings(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Meetings merged by id; before, a stored row without a page takes the id of a batch row with one of the same source, day and
    committee, if that id isn't stored yet."""
    where = ["source_id", "date", "committee"]
    real = batch.where("url is not null").join(table.select(*MEETING_KEYS), list(MEETING_KEYS), "left_anti")
    real = real.groupBy(*where).agg(F.min("external_id").alias("__real"))
    empty = table.where("url is null").groupBy(*where).agg(F.min("external_id").alias("external_id"))
    adopted = empty.join(real, where).select(*MEETING_KEYS, "__real")
    table = table.join(adopted, list(MEETING_KEYS), "left").withColumn("external_id", F.coalesce("__real", "external_id")).drop("__real")
    return merged(table, batch, MEETING_KEYS, MEETING_RULES)


def dedup_papers(papers: DataFrame, batch: DataFrame, most_failures: int = 3) -> DataFrame:
    """batch (source_id, external_id, content_hash, ...) with known and needs_analysis: a known hash only if its last analysis is unsettled."""
    keys = ["source_id", "external_id", "content_hash"]
    old = papers.select(*keys, F.col("status").alias("__status"), F.col("failures").alias("__failures"), F.lit(True).alias("__known"))
    return (
        batch.join(old, keys, "left")
        .withColumn("known", F.coalesce("__known", F.lit(False)))
        .withColumn("needs_analysis", ~F.col("known") | needs_analysis(F.col("__status"), F.col("__failures"), most_failures))
        .drop("__status", "__failures", "__known")
    )


def analysis_results(papers: DataFrame, results: DataFrame, batch_id: int) -> DataFrame:
    """papers with status, time and failures of results (keys, status, analysed_at); a failure counts once a batch, however often it is replayed."""
    keys = ["source_id", "external_id", "content_hash"]
    new = results.select(*keys, F.col("status").alias("__s"), F.col("analysed_at").alias("__t"))
    replay = F.coalesce(F.col("last_batch"), F.lit(-1)) == batch_id
    return (
        papers.join(new, keys, "left")
        .withColumn("failures", F.when((F.col("__s") == "FEHLER") & ~replay, F.col("failures") + 1).otherwise(F.col("failures")))
        .withColumn("last_batch", F.when(F.col("__s").isNotNull(), F.lit(batch_id)).otherwise(F.col("last_batch")))
        .withColumn("status", F.coalesce("__s", "status"))
        .withColumn("analysed_at", F.coalesce("__t", "analysed_at"))
        .drop("__s", "__t")
    )


def upsert_projects(table: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Projects by key: every extracted column follows the last paper, to null too; what people keep stays. New ones start as 'Neu'."""
    start = batch.withColumn("status", F.lit("Neu")).withColumn("notes", F.lit(""))
    return merged(table, start, PROJECT_KEYS, PROJECT_RULES)


def upsert_finds(table: DataFrame | None, batch: DataFrame) -> DataFrame:
    start = batch.withColumn("status", F.lit("Neu")).withColumn("notes", F.lit(""))
    return merged(table, start, FIND_KEYS, FIND_RULES, ranks=D.PHASE_RANK)


def set_values(table: DataFrame, wanted: DataFrame, key: str, column: str, at: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """table with column set to each key's last value in wanted (key, column, at), null included; a value not allowed is an error.

    For notes, page addresses and, with ORIGINS as what is allowed, the origin. Unknown keys set nothing.
    """
    last = wanted.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(column), F.col(at))[column].alias("__value"))
    value = F.col("__value")
    if allowed:
        value = F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"no such {column}: "), F.coalesce(value, F.lit("null")))).cast("string"))
    rows = table.join(last.withColumn("__value", value).withColumn("__set", F.lit(True)), F.col(key) == F.col("__key"), "left")
    return rows.withColumn(column, F.when(F.col("__set"), F.col("__value")).otherwise(F.col(column))).select(table.columns)


def latest(log: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The last value of each key in an append-only log."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def status_changes(projects: DataFrame, wanted: DataFrame, at: str) -> DataFrame:
    """Log rows (project_id, old_status, new_status, changed_at) of wanted (project_id, status, at), unchanged ones too; unknown ids are an error."""
    old = projects.select("project_id", F.col("status").alias("old_status"), F.lit(True).alias("__known"))
    rows = wanted.join(old, "project_id", "left")
    known = F.when(F.col("__known"), F.col("project_id")).otherwise(F.raise_error(F.concat(F.lit("no project "), F.col("project_id").cast("string"))).cast("bigint"))
    return rows.select(known.alias("project_id"), "old_status", F.col("status").alias("new_status"), F.col(at).alias("changed_at"))
