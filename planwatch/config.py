"""Configuration from YAML: unknown keys and values out of range are errors."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = (1, 2, 3)


@dataclass(frozen=True)
class Source:
    """A source: its system, what it is called, and what it sets otherwise than its region or the whole."""

    id: str
    name: str
    system: str
    tier: int = 1
    enabled: bool = True
    region: str | None = None
    committee_patterns: tuple[str, ...] | None = None
    backfill_from: str | None = None
    options: Mapping[str, Any] = field(default_factory=dict)


def strict(kind: type, values: Mapping[str, Any]) -> Any:
    """An instance of a dataclass from a mapping that holds no other keys."""
    known = {f.name for f in fields(kind)}
    if extra := sorted(set(values) - known):
        raise ValueError(f"{kind.__name__}: unknown keys {', '.join(extra)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def sources(text: str) -> list[Source]:
    """The enabled sources of a YAML list, by tier and name; ids must differ."""
    rows = [strict(Source, x) for x in yaml.safe_load(text) or []]
    if len({s.id for s in rows}) < len(rows):
        raise ValueError("source ids repeat")
    if bad := [s.id for s in rows if s.tier not in TIERS]:
        raise ValueError(f"no such tier: {', '.join(bad)}")
    return sorted((s for s in rows if s.enabled), key=lambda s: (s.tier, s.name))


def table(spark: SparkSession, rows: list[Mapping[str, Any]], schema: str) -> DataFrame:
    """A configured list (places, known projects) as a frame."""
    names = [x.split()[0] for x in schema.split(", ")]
    if extra := sorted({k for r in rows for k in r} - set(names)):
        raise ValueError(f"unknown keys {', '.join(extra)}")
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def effective(name: str, default: Any) -> Column:
    """A setting of a source, else of its region, else of the whole (columns source_x, region_x)."""
    return F.coalesce(F.col(f"source_{name}"), F.col(f"region_{name}"), F.lit(default))
