"""Counters that a pass over the data fills itself, and gates that stop a run by them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class GateClosed(RuntimeError):
    """What was counted isn't what may be."""


class Counters:
    """Counts of stages by name. They are filled when an action first runs over the stage's rows, so nothing is read twice for them."""

    def __init__(self) -> None:
        self.stages: dict[str, Observation] = {}

    def on(self, df: DataFrame, stage: str, **what: Column) -> DataFrame:
        """df, counted on the way: rows, and aggregates by name. Counting is no stage of its own, and shuffles nothing."""
        if stage in self.stages:
            raise ValueError(f"{stage} is counted already")
        self.stages[stage] = Observation(stage)
        return df.observe(self.stages[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in what.items()])

    def of(self, stage: str) -> dict[str, Any]:
        """What was counted; waits until an action has run."""
        return dict(self.stages[stage].get)

    def all(self) -> dict[str, dict[str, Any]]:
        return {stage: self.of(stage) for stage in self.stages}

    def gate(self, stage: str, **least: float) -> dict[str, Any]:
        """The stage's counts; an error if one is below its least value, or if its name begins with no_ and it isn't 0."""
        got = self.of(stage)
        low = [f"{n} {got[n]} < {v}" for n, v in least.items() if got[n] is None or got[n] < v]
        bad = [f"{n} {v}" for n, v in got.items() if n.startswith("no_") and v]
        if low or bad:
            raise GateClosed(f"{stage}: {', '.join(low + bad)}")
        return got


def observed(df: DataFrame, stage: str, **what: Column) -> DataFrame:
    """The same for streams, whose batches report their counts with their progress."""
    return df.observe(stage, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in what.items()])


def progress(query: StreamingQuery, stage: str) -> list[Mapping[str, Any]]:
    """What each batch of a stream counted at a stage."""
    rows = (p.observedMetrics.get(stage) for p in query.recentProgress)
    return [r.asDict() for r in rows if r is not None]
