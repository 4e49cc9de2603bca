"""Texts of files and results by content, kept between runs: what is known isn't read or worked out again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.datasource import opened
from ..state.snapshot import SnapshotStore

FILE = "path string, length long, modified timestamp"
TEXT_RULES = {"length": "overwrite", "modified": "overwrite", "pages": "overwrite", "error": "overwrite"}


def file_list(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """FILE of the files below folder: names, sizes and times alone, as the column of contents isn't asked for."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def texts_of(spark: SparkSession, files: DataFrame, store: SnapshotStore, read: Callable[[bytes], list[str]]) -> DataFrame:
    """files with pages array<string> and error: from the store where a file's size and time are as they were, else read now, and stored.

    read turns a file's bytes into its pages, in tasks. What it can't read has error and no pages, is stored as well, and is read again each run, as is
    an entry without both. Only paths of changed files reach the readers; the store's new piece is as large as what was read.
    """
    known = store.read()
    found = files.select("path", "length", "modified")
    if known is not None:
        sound = known.where("pages is not null and error is null").select(*[F.col(c).alias(f"__{c}") for c in ("path", "length", "modified")])
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("path", "length", "modified")]
        found = found.join(sound, same[0] & same[1] & same[2], "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pages, errors = [], []
            for path in pdf["path"]:
                try:
                    fs, at = opened(path)
                    with fs.open_input_stream(at) as stream:
                        pages.append(read(stream.read()))
                    errors.append(None)
                except Exception as e:  # a file that can't be read costs one row
                    pages.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(pages=pages, error=errors)

    new = found.repartition("path").mapInPandas(run, f"{FILE}, pages array<string>, error string").withColumn("seq", F.lit(0))
    now = store.merge(new, ["path"], TEXT_RULES).drop("is_new")
    return files.select("path").join(now, "path", "left")


def results_of(
    rows: DataFrame, store: SnapshotStore, key: str, result: str, work: Callable[[DataFrame], DataFrame], valid: Column | None = None
) -> DataFrame:
    """rows with their result by key (a hash of the content): stored ones where they are valid, else worked out, and stored if valid.

    work gets rows of the keys that lack a valid result, one each, and adds the column result. valid is a test of that column; an entry that fails it is as
    good as none, and isn't written. Rows with a null key share nothing: they are worked out each time, and not stored.
    """
    fine = F.col(result).isNotNull() & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    known = store.read()
    missing = rows
    if known is not None:
        missing = rows.join(known.where(fine).select(key), key, "left_anti")
    done = work(missing.where(F.col(key).isNotNull()).dropDuplicates([key]))
    kept = store.merge(done.where(fine).select(key, result).withColumn("seq", F.lit(0)), [key], {result: "overwrite"}).where(fine).select(key, result)
    named = rows.where(F.col(key).isNotNull()).join(kept, key, "left").select(*rows.columns, result)
    return named.unionByName(work(rows.where(F.col(key).isNull())).select(*rows.columns, result))


