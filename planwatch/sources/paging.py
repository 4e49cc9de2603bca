"""Stored pages in the order in which they point at each other, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..state.lineage import checkpointed
from .records import checked

#: What may be wrong with a page: its chain never ends, ends at a page that isn't stored, joins another chain, or is too long.
LOOP, MISSING, FORK, LONG = "loop", "missing", "fork", "long"


def page_order(pages: DataFrame, url: str = "url", next_url: str = "next", most_pages: int | None = 500) -> DataFrame:
    """url, chain (its last page), position long (from 0), missing (the page that the last one asks for and that isn't stored), problem.

    Pointer doubling: in each round every page learns where its pointer's pointer leads, so n pages need log n joins on the address,
    whatever the length of a chain. A page met after so many rounds on its way has no end: it is in a loop, or leads into one, and has no position.
    problem is null where a chain has one first page, an end, no page missing and at most most_pages pages. Of equal rows one counts;
    an address stored with different pointers is a fork. Rows without an address are left out.
    """
    stored = pages.select(F.col(url).alias("url"), F.nullif(F.col(next_url), F.lit("")).alias("next")).where("url is not null")
    given = stored.groupBy("url").agg(F.max("next").alias("next"), (F.count_distinct(F.coalesce("next", F.lit(""))) > 1).alias("split"))
    known = given.select(F.col("url").alias("to"))
    pointed = given.where("next is not null").groupBy(F.col("next").alias("to")).agg(F.count("*").alias("pointers"))
    nodes = checkpointed(
        given.join(known.withColumn("there", F.lit(True)), F.col("next") == F.col("to"), "left")
        .drop("to")
        .join(pointed, F.col("url") == F.col("to"), "left")
        .select("url", "next", F.coalesce("there", F.lit(False)).alias("goes_on"), F.coalesce("pointers", F.lit(0)).alias("pointers"), "split")
    )
    state = nodes.select("url", F.when(F.col("goes_on"), F.col("next")).otherwise(F.col("url")).alias("far"), F.col("goes_on").cast("long").alias("hops"), (~F.col("goes_on")).alias("ended"))
    n = nodes.count()
    for _ in range(max(n, 1).bit_length()):
        ahead = state.select(F.col("url").alias("at"), F.col("far").alias("further"), F.col("hops").alias("more"), F.col("ended").alias("end"))
        state = checkpointed(
            state.join(ahead, F.col("far") == F.col("at")).select("url", F.col("further").alias("far"), (F.col("hops") + F.col("more")).alias("hops"), F.col("end").alias("ended"))
        )
        if not state.where("not ended").limit(1).count():
            break
    rows = nodes.join(state, "url")
    per = rows.where("ended").groupBy(F.col("far").alias("chain")).agg(
        F.max("hops").alias("length"), F.count_if(F.col("pointers") == 0).alias("heads"), F.max("pointers").alias("most_pointers"), F.max("split").alias("split"), F.max(F.when(~F.col("goes_on"), F.col("next"))).alias("missing")
    )
    fork = (F.col("heads") != 1) | (F.col("most_pointers") > 1) | F.col("c.split")
    long = F.lit(False) if most_pages is None else F.col("length") >= most_pages
    return (
        rows.alias("r")
        .join(per.alias("c"), F.col("ended") & (F.col("far") == F.col("chain")), "left")
        .select(
            "url",
            "chain",
            F.when(F.col("ended"), F.col("length") - F.col("hops")).alias("position"),
            "missing",
            F.when(~F.col("ended"), LOOP).when(F.col("missing").isNotNull(), MISSING).when(fork, FORK).when(long, LONG).alias("problem"),
        )
    )


def in_order(pages: DataFrame, url: str = "url", next_url: str = "next", most_pages: int | None = 500) -> DataFrame:
    """pages with chain and position. Reading fails loudly at a loop, a missing page, a fork or a chain of more than most_pages."""
    found = page_order(pages, url, next_url, most_pages)
    sound = checked(found, F.col("problem").isNull(), "pages that don't follow each other: a loop, a fork, a page missing or too many of them")
    return pages.dropDuplicates([url]).join(sound.select(F.col("url").alias("__url"), "chain", "position"), F.col(url) == F.col("__url")).drop("__url")


def offset_gaps(pages: DataFrame, source: str, offset: str, total: str, size: int = 100, most: int = 5000) -> DataFrame:
    """source, offset, problem: what searches read by offsets lack. A page of size rows is due at each multiple of size below the total that the
    source states; one that isn't stored is missing. A total that pages state differently, or above most, is a problem of the source (offset null)."""
    per = pages.groupBy(F.col(source).alias("source")).agg(F.max(total).cast("long").alias("total"), F.min(total).cast("long").alias("least"))
    due = per.where(F.col("total") > 0).select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(size).cast("long"))).alias("offset"))
    have = pages.select(F.col(source).alias("s"), F.col(offset).cast("long").alias("o")).distinct()
    gone = due.join(have, F.col("source").eqNullSafe(F.col("s")) & (F.col("offset") == F.col("o")), "left_anti").withColumn("problem", F.lit(MISSING))
    kind = F.when(F.col("total") > most, LONG).when(F.col("least") < F.col("total"), "changed")
    return gone.unionByName(per.select("source", F.lit(None).cast("long").alias("offset"), kind.alias("problem")).where("problem is not null"))


def newest_until(rows: DataFrame, chain: Column, start: Column, date: str = "date") -> DataFrame:
    """Rows of lists that stand newest first, up to the first one older than start: those after it are left out even if they are newer."""
    from pyspark.sql import Window

    older = F.coalesce(F.max((F.col(date) < start).cast("int")).over(Window.partitionBy(chain).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn("__older", older).where("__older = 0").drop("__older")
