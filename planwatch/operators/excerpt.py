"""Excerpts of page lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import text as T


def hit_pages(pages: Column, keywords: Sequence[str], context: int = D.CONTEXT_PAGES) -> Column:
    """Numbers, from 0, of the pages with a keyword and of those at most context pages from one."""

    def near(held: Column) -> Column:
        marked = F.transform(held, lambda p, i: F.when(T.contains_any(F.coalesce(p, F.lit("")), keywords), i))
        hits = F.filter(marked, lambda i: i.isNotNull())
        spans = F.transform(hits, lambda i: F.sequence(F.greatest(i - context, F.lit(0)), F.least(i + context, F.size(held) - 1)))
        return F.array_distinct(F.flatten(spans))  # in order, as the hits are

    return T.bound(pages, near)


def budgeted(pages: Column, most: int = D.EXCERPT_CHARS) -> Column:
    """The leading pages whose lengths add up to at most most; the first is kept whatever its length."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, page: Column) -> Column:
        total = acc["total"] + F.length(page)
        stop = acc["stop"] | ((total > most) & (F.size(acc["out"]) > 0))
        return F.struct(
            F.when(stop, acc["total"]).otherwise(total).cast("long").alias("total"),
            stop.alias("stop"),
            F.when(stop, acc["out"]).otherwise(F.concat(acc["out"], F.array(page))).alias("out"),
        )

    return F.aggregate(pages, start, step, lambda acc: acc["out"])


def excerpt(pages: Column, keywords: Sequence[str], context: int = D.CONTEXT_PAGES, most: int = D.EXCERPT_CHARS) -> Column:
    """The hit pages in order, as many whole ones as the budget takes, in one text."""
    chosen = T.bound(pages, lambda held: F.transform(hit_pages(held, keywords, context), lambda i: F.get(held, i)))
    return F.array_join(budgeted(chosen, most), "\n\n")
