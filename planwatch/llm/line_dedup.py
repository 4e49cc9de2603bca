"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small, stored


#: Standard deviations of a one-sided bound of 95 %.
SURE = 1.645


def least_share(n: Column, pages: Column, sure: float) -> Column:
    """The lower end of Wilson's interval of a share of which n of pages were seen: so much it is at least, as surely as sure standard deviations say."""
    p, z = n / pages, sure * sure
    return (p + z / (2 * pages) - sure * F.sqrt(p * (1 - p) / pages + z / (4 * pages * pages))) / (1 + z / pages)


def boilerplate(docs: DataFrame, text_col: str, host_col: str, ratio: float, sure: float = SURE) -> DataFrame:
    """host, line (its MD5): lines that stand on more than one of their host's pages, and surely on more than ratio of them.

    A share of few pages says little, so what is held against ratio is its lower confidence bound (sure=0: the share itself): of six pages two make a
    line boilerplate at a ratio of 0.1, of a hundred 15, of very many just more than a tenth. A host has fewer such lines than its mean
    number of lines a page divided by ratio, so the result holds a bounded number of rows for each host. Lines are compared
    whole, without outer spaces; blank ones never count.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.md5(F.trim(x).cast("binary"))))
    on = (
        pages.select("host", F.explode(lines).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )
    return (
        on.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
        .where(least_share(F.col("n"), F.col("pages"), sure) > ratio)
        .select("host", "line")
    )


def without_boilerplate(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1, sure: float = SURE, new_col: str = "kept_text", count_col: str = "n_dropped"
) -> DataFrame:
    """docs with new_col (the text without its host's boilerplate lines) and count_col long (lines dropped).

    Other lines stay as they are, in order. A null text has new_col null and count_col 0, an empty one stays
    empty; a null host is a host of its own; repeated rows count as pages each. Columns of other names are passed on,
    those named new_col and count_col are replaced.
    """
    found = stored(boilerplate(docs, text_col, host_col, ratio, sure).groupBy("host").agg(F.collect_set("line").alias("lines")))
    host, lines, rest = (free_name(docs, x) for x in ("host_of_lines", "lines_of_host", "lines_kept"))
    rows = docs.join(
        small(found.select(F.col("host").alias(host), F.col("lines").alias(lines)), 10_000),
        docs[host_col].eqNullSafe(F.col(host)),
        "left",
    )
    split = F.split(F.col(text_col), "\n")
    drop = lambda x: F.coalesce(F.array_contains(lines, F.md5(F.trim(x).cast("binary"))), F.lit(False))
    kept = F.filter(split, lambda x: ~drop(x))
    return rows.withColumn(rest, F.when(F.col(lines).isNull(), split).otherwise(kept)).select(
        *[docs[c] for c in docs.columns if c not in (new_col, count_col)],
        F.array_join(rest, "\n").alias(new_col),
        F.coalesce(F.size(split) - F.size(rest), F.lit(0)).cast("long").alias(count_col),
    )
