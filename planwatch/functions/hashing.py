"""Content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(hashes: Column) -> Column:
    """One SHA-256 of a list of hashes, whatever their order; repeats count."""
    return F.sha2(F.array_join(F.array_sort(hashes), "|"), 256)
