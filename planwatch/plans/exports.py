"""Exports and notices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import latin1_safe
from ..operators.filters import present


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The columns that there are as one CSV part with a byte order mark; an export for people, so of moderate size."""
    out = present(df, columns)
    first = out.columns[0]
    out.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def printable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as text of Latin-1 signs, for reports that can hold no others."""
    return df.select(*[latin1_safe(F.col(c).cast("string")).alias(c) for c in columns if c in df.columns])


def notice(new: DataFrame, columns: Sequence[str], title: str, most: int = 200) -> str | None:
    """Lines on new rows for a mail; none if there are none. Beyond most rows, which is a mail's limit, it says how many more there are."""
    n = new.count()
    if not n:
        return None
    rows = new.select(*columns).orderBy(*columns).limit(most).collect()
    lines = [" | ".join("–" if v is None else str(v) for v in r) for r in rows]
    return "\n".join([f"{title}: {n}", *lines, *([f"and {n - most} more"] if n > most else [])])
