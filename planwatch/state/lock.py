"""One run at a time, by a file that the next run may take over when it is old."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .files import Files

#: Fixed value: a lock that is older is left over from a run that broke off.
STALE_SECONDS = 12 * 3600


class AlreadyRunning(RuntimeError):
    """Another run holds the lock."""


def active(spark: SparkSession, folder: str, name: str = "run.lock", stale: float = STALE_SECONDS) -> bool:
    age = Files(spark, folder).age(name)
    return age is not None and age < stale


@contextmanager
def lock(spark: SparkSession, folder: str, name: str = "run.lock", stale: float = STALE_SECONDS) -> Iterator[str]:
    """Holds the lock below folder, which is shared by all drivers, until the block ends; gives the holder's mark.

    A stale lock is moved aside, which only one of several runs can do, and then put anew, which again only one can. Who has lost it meanwhile doesn't
    take away the next holder's.
    """
    files, own = Files(spark, folder), uuid.uuid4().hex
    age = files.age(name)
    if age is not None and age >= stale:
        files.move(name, f".stale-{own}")
    if not files.put(name, own):
        raise AlreadyRunning(f"another run holds {folder}/{name}")
    try:
        yield own
    finally:
        if files.age(name) is not None and files.text(name) == own:
            files.drop(name)
