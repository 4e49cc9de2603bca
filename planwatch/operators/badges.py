"""Derived columns of the project and find tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import text as T


def column_or(df: DataFrame, name: str, missing: object) -> Column:
    return F.col(name) if name in df.columns else F.lit(missing)


def review_reasons(df: DataFrame, least_confidence: float = D.REVIEW_CONFIDENCE, rent_least: int = D.RENT_LEAST_UNITS, ownership_least: int = D.OWNERSHIP_LEAST_UNITS) -> Column:
    """array<string> of why a project needs a look: tenure unclear, no count of homes, low confidence.

    A missing tenure column counts as unclear, a null tenure doesn't; a null confidence counts as 0, a missing column as 1.
    """
    tenure, share = column_or(df, "tenure", "UNKLAR"), column_or(df, "subsidised_share", None)
    counts = [F.col(c) for c in ("units", "units_rent", "units_subsidised") if c in df.columns] or [F.lit(None)]
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0)) if "confidence" in df.columns else F.lit(1.0)
    percent = lambda x: F.bround(x * 100).cast("int").cast("string")
    around = lambda x, texts: F.concat(F.lit(texts[0]), percent(x), F.lit(texts[1]))
    known = F.when(share.isNull(), F.lit(D.REVIEW_NO_SHARE)).otherwise(around(share.cast("double"), D.REVIEW_SHARE))
    task = F.lit(D.REVIEW_TENURE.format("{0}", rent_least, ownership_least))
    reasons = F.array(
        F.when(tenure == "UNKLAR", F.replace(task, F.lit("{0}"), known)),
        F.when(F.coalesce(*counts).isNull(), F.lit(D.REVIEW_UNITS)),
        F.when(confidence < least_confidence, around(confidence, D.REVIEW_UNSURE)),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def with_review(df: DataFrame) -> DataFrame:
    reasons = review_reasons(df)
    return df.withColumn("review_task", F.array_join(reasons, " · ")).withColumn("review", F.when(F.size(reasons) > 0, F.lit(D.BADGE_REVIEW)).otherwise(F.lit("")))


def lead_badge(stage: Column, texts: Sequence[Column], hint_words: Sequence[str] = D.HINT_WORDS) -> Column:
    """The badge of a short-term lead: permit, application, or a hint in the texts of early projects; empty for none."""
    stage = F.coalesce(stage, F.lit("UNKLAR"))
    text = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    return (
        F.when(stage == "BAUGENEHMIGUNG", F.lit(D.BADGE_PERMIT))
        .when(stage == "BAUANTRAG", F.lit(D.BADGE_APPLICATION))
        .when(stage.isin(*D.HINT_STAGES) & T.contains_any(text, hint_words), F.lit(D.BADGE_HINT))
        .otherwise(F.lit(""))
    )


def labelled(value: Column, labels: Mapping[str, str], default: Column | None = None) -> Column:
    """The label of a value by a map; the default, or the value itself, where it has none."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("string")
    return F.coalesce(found, value if default is None else default)


def units_shown(units: Column) -> Column:
    return F.coalesce(F.concat(units.cast("string"), F.lit(" WE")), F.lit("WE offen"))


def provenance(url: Column, verified: Sequence[str], demo_prefix: str) -> Column:
    return F.when(url.isin(*verified), F.lit("verified")).when(F.startswith(url, F.lit(demo_prefix)), F.lit("demo")).otherwise(F.lit(""))


def subject(n: Column, one: str, many: str) -> Column:
    """A line with the number of new rows, in the singular or the plural."""
    return F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def dashed(df: DataFrame, optional: str | None = None) -> DataFrame:
    """Null texts as a dash; the optional column goes if no row has anything in it."""
    if optional in df.columns and not df.where(F.coalesce(F.col(optional), F.lit("")) != "").limit(1).count():
        df = df.drop(optional)
    return df.fillna("–", subset=[c for c, t in df.dtypes if t == "string"])
