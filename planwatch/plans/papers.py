"""The analysis of papers: cheap tests first, the injected model last and within its budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import text as T
from ..functions.hashing import content_hash
from ..operators.excerpt import excerpt
from ..operators.filters import small_ownership
from ..state.budget import admitted

#: What a model step gives; the fields of EXTRACTION are null where a paper isn't relevant.
EXTRACTION = "units int, units_rent int, units_subsidised int, subsidised_share double, tenure string, stage string, confidence double, quote string"


def paper_hashes(documents: DataFrame) -> DataFrame:
    """source_id, paper_id, content_hash: of all its documents' hashes."""
    return documents.groupBy("source_id", "paper_id").agg(content_hash(F.collect_list("sha256")).alias("content_hash"))


def needs_ocr(pages: Column, chars_per_page: int = 20) -> Column:
    return F.aggregate(pages, F.lit(0), lambda a, p: a + F.length(F.coalesce(p, F.lit("")))) < chars_per_page * F.size(pages)


def valid(x: Column) -> Column:
    """Whether an extraction keeps to its ranges: shares and confidence from 0 to 1, counts not negative, a short quote, known words."""
    counts = [F.coalesce(x[c] >= 0, F.lit(True)) for c in ("units", "units_rent", "units_subsidised")]
    return (
        counts[0] & counts[1] & counts[2]
        & F.coalesce(x["subsidised_share"].between(0, 1), F.lit(True)) & x["confidence"].between(0, 1)
        & F.coalesce(F.length(x["quote"]) <= D.QUOTE_MOST, F.lit(True)) & x["tenure"].isin(*D.TENURES) & x["stage"].isin(*D.STAGES)
    )


def analysed(
    papers: DataFrame,
    keywords: Sequence[str],
    triage: Callable[[Column], Column],
    extract: Callable[[Column], Column],
    cache: DataFrame | None = None,
    per_source: int = 40,
    per_run: int = 300,
    repair: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """papers (source_id, paper_id, content_hash, pages, seq) with status, reason and extraction.

    In order: no pages is not relevant; a cached extraction counts; all pages without text need OCR; no keyword is not relevant; the
    model's triage may say NEIN; beyond the budget nothing is asked; an invalid extraction is an error; few homes for sale aren't
    relevant. triage and extract take the excerpt (a column) and give a word and a struct of EXTRACTION; repair, if given, takes
    the excerpt and an invalid struct and gives another one, once.
    """
    rows = papers
    if cache is not None:
        rows = rows.join(cache.select("content_hash", F.col("extraction").alias("cached")), "content_hash", "left")
    else:
        rows = rows.withColumn("cached", F.lit(None).cast(f"struct<{EXTRACTION.replace(' ', ':').replace(',:', ',')}>"))
    rows = rows.withColumn("excerpt", F.when(F.size("pages") > 0, excerpt(F.col("pages"), keywords)))
    asked = (F.size("pages") > 0) & F.col("cached").isNull() & ~needs_ocr(F.col("pages")) & (F.coalesce("excerpt", F.lit("")) != "")
    rows = rows.withColumn("asked", asked)
    calls = admitted(rows.where("asked").select("source_id", "paper_id", "seq"), "source_id", ["seq", "paper_id"], per_source, per_run)
    rows = rows.join(calls.select("source_id", "paper_id", "admitted"), ["source_id", "paper_id"], "left")
    go = F.coalesce("admitted", F.lit(False))
    rows = rows.withColumn("triage", F.when(go, triage(F.col("excerpt"))))
    rows = rows.withColumn("found", F.when(go & (F.col("triage") != "NEIN"), extract(F.col("excerpt"))))
    if repair is not None:
        broken = go & F.col("found").isNotNull() & ~F.coalesce(valid(F.col("found")), F.lit(False))
        rows = rows.withColumn("found", F.when(broken, repair(F.col("excerpt"), F.col("found"))).otherwise(F.col("found")))
    final = F.coalesce("cached", "found")
    small = F.coalesce(small_ownership(final["tenure"], final["units"]), F.lit(False))
    status = (
        F.when(F.coalesce(F.size("pages"), F.lit(0)) <= 0, F.lit("NICHT_RELEVANT"))
        .when(F.col("cached").isNull() & needs_ocr(F.col("pages")), F.lit("OCR_NOETIG"))
        .when(F.col("cached").isNull() & ~F.col("asked"), F.lit("NICHT_RELEVANT"))
        .when(F.col("cached").isNull() & ~go, F.lit("BUDGET_ERSCHOEPFT"))
        .when(F.col("triage") == "NEIN", F.lit("NICHT_RELEVANT"))
        .when(~F.coalesce(valid(final), F.lit(False)), F.lit("FEHLER"))
        .when(small, F.lit("NICHT_RELEVANT"))
        .otherwise(F.lit("RELEVANT"))
    )
    return rows.withColumn("status", status).withColumn("extraction", F.when(F.col("status") == "RELEVANT", final)).withColumn("new_for_cache", F.col("found")).drop("cached", "found", "asked")


def rule_triage(text: Column) -> Column:
    """A stand-in for a model: housing words make a paper relevant."""
    return F.when(T.contains_any(text, D.HOUSING_WORDS), F.lit("JA")).otherwise(F.lit("NEIN"))


def rule_extract(text: Column) -> Column:
    """A stand-in for a model: what the rules can read."""
    units = T.unit_count(text)
    none = F.lit(None)
    return F.struct(
        units["units"].alias("units"), none.cast("int").alias("units_rent"), none.cast("int").alias("units_subsidised"), none.cast("double").alias("subsidised_share"),
        T.tenure(text).alias("tenure"), F.lit("UNKLAR").alias("stage"), F.lit(0.5).alias("confidence"), units["quote"].alias("quote"),
    )
