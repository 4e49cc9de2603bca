"""The frames behind the overview: badges, key figures and leads in one lazy chain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import badges as B
from ..operators import reports as R


def project_frame(projects: DataFrame, sources: DataFrame, stage_labels: Mapping[str, str]) -> DataFrame:
    """projects with tier, review, lead and display columns."""
    tiers = sources.select("source_id", F.col("tier").alias("__tier"))
    rows = projects.join(tiers, "source_id", "left").withColumn("tier", F.coalesce(F.col("__tier").cast("string"), F.lit("?"))).drop("__tier")
    texts = [F.col(c) for c in ("period", "summary", "quote", "name") if c in rows.columns]
    return (
        B.with_review(rows)
        .withColumn("lead", B.lead_badge(F.col("stage"), texts))
        .withColumn("stage_label", B.labelled(F.col("stage"), stage_labels))
        .withColumn("units_shown", B.units_shown(F.col("units")))
    )


def overview(projects: DataFrame, sources: DataFrame, stage_labels: Mapping[str, str], open_statuses: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Key figures and short-term leads."""
    frame = project_frame(projects, sources, stage_labels)
    return R.key_figures(frame, open_statuses), R.short_term_leads(frame, "project_id")
