"""Stored payloads as a data source: ``spark.read.format("stored_payloads")``, with months and sources pushed down to the folders."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "system string, source_id string, month date, page string, body string, error string"
#: What a filter may compare, and columns that folders are named by.
COMPARED = {EqualTo: lambda x, y: x == y, EqualNullSafe: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, In: lambda x, y: x in y}
FOLDERS = ("system", "source_id", "month")


def opened(path: str) -> tuple[Any, str]:
    """The file system of an address and the path there; an address without a scheme is a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Pages(InputPartition):
    """Some pages of one month of a source."""

    system: str
    source_id: str
    month: dt.date
    files: tuple[str, ...]

    def __init__(self, system: str, source_id: str, month: dt.date, files: Sequence[str]):
        self.system, self.source_id, self.month, self.files = system, source_id, month, tuple(files)


class PayloadReader(DataSourceReader):
    """Pages below path/system/source_id/yyyy-mm, at most pages_per_task of one month in a partition.

    Comparisons of system, source_id and month with values are answered by the folders' names: what they exclude is neither listed nor
    opened. A page that isn't UTF-8 gives a row with error and no body, or stops the read if strict.
    """

    def __init__(self, path: str, per_task: int, strict: bool):
        self.path, self.per_task, self.strict = path, per_task, strict
        self.wanted: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in FOLDERS and (type(f) in COMPARED or isinstance(f, IsNotNull)):
                if type(f) in COMPARED:
                    self.wanted.append((column, type(f), f.value))
            else:
                yield f

    def passes(self, column: str, value: Any) -> bool:
        return all(y is not None and COMPARED[kind](value, y) for c, kind, y in self.wanted if c == column)

    def folders(self, fs: Any, at: str) -> list[str]:
        from pyarrow.fs import FileSelector, FileType

        return sorted(x.base_name for x in fs.get_file_info(FileSelector(at, allow_not_found=True)) if x.type == FileType.Directory)

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = opened(self.path)
        out: list[InputPartition] = []
        for system in (x for x in self.folders(fs, root) if self.passes("system", x)):
            for source in (x for x in self.folders(fs, f"{root}/{system}") if self.passes("source_id", x)):
                for name in self.folders(fs, f"{root}/{system}/{source}"):
                    try:
                        month = dt.date.fromisoformat(f"{name}-01")
                    except ValueError as error:
                        raise ValueError(f"{root}/{system}/{source}/{name} is no month") from error
                    if self.passes("month", month):
                        found = fs.get_file_info(FileSelector(f"{root}/{system}/{source}/{name}"))
                        files = sorted(x.path for x in found if x.type == FileType.File and x.base_name[0] not in "._")
                        out += [Pages(system, source, month, files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Pages):  # nothing passed
            return
        fs, _ = opened(self.path)
        for file in partition.files:
            with fs.open_input_stream(file) as stream:
                raw = stream.read()
            body, error = None, None
            try:
                body = raw.decode()
            except UnicodeDecodeError as e:
                if self.strict:
                    raise
                error = f"{type(e).__name__}: {e}"
            yield partition.system, partition.source_id, partition.month, file.rpartition("/")[2], body, error


class StoredPayloads(DataSource):
    """Options: path (any address that pyarrow opens), pages_per_task (64), strict (false)."""

    @classmethod
    def name(cls) -> str:
        return "stored_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("stored_payloads needs a path")
        return PayloadReader(self.options["path"].rstrip("/"), int(self.options.get("pages_per_task", 64)), self.options.get("strict", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredPayloads)


def payloads(spark: SparkSession, path: str, system: str, source_id: str, start: dt.date | None = None, end: dt.date | None = None, **options: str) -> DataFrame:
    """A source's stored pages of the months from start to end."""
    register(spark)
    rows = spark.read.format(StoredPayloads.name()).options(**options).load(path).where((F.col("system") == system) & (F.col("source_id") == source_id))
    if start:
        rows = rows.where(F.col("month") >= F.lit(start.replace(day=1)))
    return rows.where(F.col("month") <= F.lit(end)) if end else rows


def body_as(rows: DataFrame, schema: str) -> DataFrame:
    """Pages of JSON as columns of schema, with page and error: a page that can't be read is a row with an error, not a failed job."""
    parsed = F.from_json("body", f"struct<{schema}, _broken string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    found = rows.withColumn("__x", parsed)
    broken = F.coalesce("error", F.when(F.col("__x._broken").isNotNull() | F.col("__x").isNull(), F.lit("no JSON of the expected kind")))
    return found.select("page", broken.alias("error"), "__x.*").drop("_broken")


def split_errors(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Sound rows without the column of errors, and the failed ones."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def in_months(start: Column, end: Column) -> Column:
    """Whether a page's month can hold days from start to end."""
    return F.col("month").between(F.trunc(start, "month"), end)
