"""Whole runs: a source's meetings to analysed papers, and search results to finds. Errors of one source stay with it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators.filters import relevant_meeting
from ..state import upserts
from ..state.budget import decided
from . import papers as P


def collected(
    meetings: DataFrame,
    documents: DataFrame,
    pages: DataFrame,
    known: DataFrame,
    patterns: Sequence[str],
    keywords: Sequence[str],
    triage: Callable[[Column], Column],
    extract: Callable[[Column], Column],
    cache: DataFrame | None = None,
    per_source: int = 40,
    per_run: int = 300,
) -> DataFrame:
    """source_id, external_id (the paper's), content_hash, status, extraction of a run over stored meetings and documents.

    Meetings that aren't cancelled and whose committee a pattern finds; their documents (source_id, meeting_id, paper_id, external_id,
    sha256), by paper, those of the meeting itself as a paper of their own; a paper that is known with the same hash and settled isn't analysed
    again. pages: source_id, external_id of a document, page, text. known: source_id, external_id, content_hash, status, failures.
    """
    wanted = meetings.where(relevant_meeting(F.col("committee"), F.col("cancelled"), patterns)).select("source_id", F.col("external_id").alias("meeting_id")).distinct()
    paper = F.coalesce("paper_id", F.concat(F.lit("meeting "), F.col("meeting_id")))
    docs = documents.join(wanted, ["source_id", "meeting_id"], "left_semi").withColumn("paper_id", paper).dropDuplicates(["source_id", "paper_id", "external_id"])
    hashes = P.paper_hashes(docs).withColumnRenamed("paper_id", "external_id")
    todo = upserts.dedup_papers(known, hashes).where("needs_analysis").select("source_id", F.col("external_id").alias("paper_id"), "content_hash")
    held = docs.select("source_id", "paper_id", "external_id").join(pages, ["source_id", "external_id"])
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("external_id", "page", "text"))), lambda p: p["text"])
    texts = held.groupBy("source_id", "paper_id").agg(in_order.alias("pages"))
    rows = todo.join(texts, ["source_id", "paper_id"], "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<string>"))).withColumn("seq", F.xxhash64("source_id", "paper_id"))
    out = P.analysed(rows, keywords, triage, extract, cache, per_source, per_run)
    return out.select("source_id", F.col("paper_id").alias("external_id"), "content_hash", "status", "extraction")


def web_run(places: DataFrame, templates: Mapping[str, Sequence[str]], search: Callable[[DataFrame], DataFrame], finds: DataFrame | None, year: int) -> tuple[DataFrame, DataFrame]:
    """All finds after a run, with is_new, and the rejected results with their reasons.

    search takes the jobs (place, distance_km, phase, query, nearest places first) and gives results (url, title, content, place, state,
    distance_km, query, seq); what it looks up, and within which budget, is its own.
    """
    jobs = C.search_jobs(C.by_distance(places), templates).withColumnRenamed("name", "place")
    out = C.judged(search(jobs), year)
    good = out.where("reject_reason is null").withColumn("url", F.col("key"))
    batch = good.select("url", "title", "excerpt", "phase", "units", "quote", F.lit(None).cast("date").alias("published"), "tenure", "domain", "place", "state", "distance_km", "query", "seq")
    return upserts.upsert_finds(finds, batch), out.where("reject_reason is not null").select("url", "title", "reject_reason")


def canned(results: DataFrame, place: str = "place", phase: str = "phase") -> Callable[[DataFrame], DataFrame]:
    """A search for web_run that looks up stored results (place, phase, url, title, content, seq) of a job's place and phase; a job without any has none."""
    held = results.select(F.col(place).alias("__place"), F.col(phase).alias("__phase"), "url", "title", "content", "seq")

    def search(jobs: DataFrame) -> DataFrame:
        found = jobs.join(held, (F.col("place") == F.col("__place")) & (F.col("phase") == F.col("__phase")))
        return found.drop("__place", "__phase", "phase")

    return search


def sent_jobs(jobs: DataFrame, order: Sequence[str], outcomes: DataFrame, per_run: int, day_rest: int | None = None, most_errors: int = 5) -> DataFrame:
    """jobs (query, ...) with reason, null for those that are sent: a run's limit, the day's, and the brake after most_errors failures in a row.

    outcomes (query, failed, fatal) are what came of queries, as the search recorded them; a query without one succeeded. A fatal one, an account that is closed,
    stops all that come after it. jobs are in the order of the columns of order, which must be total.
    """
    told = outcomes.groupBy(F.col("query").alias("__q")).agg(F.max("failed").alias("__failed"), F.max("fatal").alias("__fatal"))
    rows = jobs.join(told, F.col("query") == F.col("__q"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("__failed", "__fatal")})
    out = decided(rows, list(order), "__failed", per_run, day_rest, most_errors=most_errors, fatal="__fatal", run_first=True)
    return out.drop("__q", "__failed", "__fatal")


def each_source(spark: SparkSession, sources: Sequence[str], run: Callable[[str], int]) -> DataFrame:
    """source_id, rows, error: run for each of a few sources, whatever becomes of the others.

    What run raises is recorded as that source's error; what isn't an error of its data or payloads (a programming mistake) is raised.
    """
    out = []
    for source in sources:
        try:
            out.append((source, run(source), None))
        except (PySparkException, ValueError) as e:
            out.append((source, None, str(e).splitlines()[0]))
    return spark.createDataFrame(out, "source_id string, rows long, error string")
