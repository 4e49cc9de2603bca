"""Rule-driven merges of a batch into a snapshot, and snapshots on disk that batches are added to in transactions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import Files

#: overwrite: the last value, null included. keep: the first. fill: the last that isn't null. rank:<map>: the highest ranked. least: the
#: smallest. sum: added up. with:<column>: the value that stands beside the last one of that column that isn't null, else the first.
#: unless:<value>: the last that is neither null nor that value, else the first.
RULES = ("overwrite", "keep", "fill", "rank", "least", "sum", "with", "unless")


def folded(column: str, rule: str, ranks: Mapping[str, int] | None = None) -> Column:
    """The aggregate of a column over rows of one key, of which __seq gives the order (the snapshot's is -1)."""
    c, seq = F.col(column), F.col("__seq")
    name, _, arg = rule.partition(":")
    first = F.min_by(F.struct(c), seq)[column]
    if name == "overwrite":
        return F.max_by(F.struct(c), seq)[column]
    if name == "keep":
        return first
    if name == "fill":
        return F.max_by(c, F.when(c.isNotNull(), seq))
    if name == "least":
        return F.min(c)
    if name == "sum":
        return F.sum(c)
    if name == "with":
        beside = F.max_by(F.struct(c), F.when(F.col(arg).isNotNull(), seq))
        return F.when(F.count(arg) > 0, beside[column]).otherwise(first)
    if name == "unless":
        return F.coalesce(F.max_by(c, F.when(c.isNotNull() & (c != arg), seq)), first)
    if name == "rank" and ranks:
        rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c), F.lit(0))
        # Of equal ranks the first stays.
        return F.max_by(F.struct(c), F.struct(rank.alias("r"), (-seq).alias("s")))[column]
    raise ValueError(f"no rule {rule!r}")


def merged(snapshot: DataFrame | None, batch: DataFrame, keys: Sequence[str], rules: Mapping[str, str], seq: str = "seq", ranks: Mapping[str, int] | None = None) -> DataFrame:
    """keys, the columns of rules and is_new: batch rows folded by key, in the order of seq (0 or more), onto the snapshot's row.

    One shuffle on the keys: a union, then partial aggregates. Merging the same batch again changes nothing, but for sums.
    """
    columns = [*keys, *rules]
    rows = batch.select(*columns, F.col(seq).cast("long").alias("__seq"))
    if snapshot is not None:
        rows = snapshot.select(*columns).withColumn("__seq", F.lit(-1).cast("long")).unionByName(rows)
    return rows.groupBy(*keys).agg(*[folded(c, r, ranks).alias(c) for c, r in rules.items()], (F.min("__seq") >= 0).alias("is_new"))


#: Places of rows within a version. A bucket is due to be folded with more than MOST_PIECES pieces, or with LATER_ROWS that are more than a share of its whole ones.
ROWS_A_VERSION = 1 << 40
MOST_PIECES, MOST_SHARE, LATER_ROWS = 8, 0.5, 10_000


class SnapshotStore:
    """A table below a folder, to which batches are added by rules. A batch costs what it holds, not what the table holds.

    log/<version>.json is put where none is yet, and says which pieces make up each bucket of keys; data/<piece> are rows. A merge writes
    its batch as a piece and then its version, so what broke off before isn't part of the table. A writer that finds its version taken
    reads the new one and adds its piece to that: pieces don't depend on what is there. Reading folds a bucket's pieces in the order of
    versions; a bucket with many pieces, or with later rows beyond half of its whole ones, is folded into one piece. Older
    versions can be read until vacuum().

    Folding is associative for all RULES, so a fold of folds is the fold of all rows.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.files = Files(spark, self.path)

    def versions(self) -> list[int]:
        return [int(n.partition(".")[0]) for n in self.files.names("log") if n.endswith(".json") and n[0] != "."]

    def manifest(self, version: int | None = None) -> dict[str, Any] | None:
        """What a version (else the last one) says: version, keys, rules, ranks, schema, writers' last batches, buckets' pieces as [piece, version, rows]."""
        if version is None:
            version = max(self.versions(), default=None)
        return None if version is None else json.loads(self.files.text(f"log/{version:020}.json"))

    def put(self, manifest: dict[str, Any]) -> bool:
        return self.files.put(f"log/{manifest['version']:020}.json", json.dumps(manifest))

    def rows(self, manifest: dict[str, Any], buckets: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version's pieces, with __seq and __since (the version in which they came)."""
        of_piece: dict[tuple[str, int], list[str]] = {}
        for b in buckets or manifest["buckets"]:
            for piece, version, _ in manifest["buckets"][b]:
                of_piece.setdefault((piece, version), []).append(b)
        schema = StructType.fromJson(manifest["schema"])
        parts = [
            self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{piece}/__bucket={b}" for b in found]).withColumns({"__seq": F.col("__seq") + F.lit(version * ROWS_A_VERSION), "__since": F.coalesce("__since", F.lit(version))})
            for (piece, version), found in of_piece.items()
        ]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def fold(self, manifest: dict[str, Any], buckets: Sequence[str] | None = None) -> DataFrame:
        kinds = {f.name: f.dataType for f in StructType.fromJson(manifest["schema"])}
        each = [folded(c, r, manifest["ranks"]).cast(kinds[c]).alias(c) for c, r in manifest["rules"].items()]
        return self.rows(manifest, buckets).groupBy(*manifest["keys"]).agg(*each, F.min("__since").alias("__since"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, else of the last one; None before the first."""
        found = self.manifest(version)
        return found and self.fold(found).drop("__since")

    def write(self, rows: DataFrame, keys: Sequence[str]) -> tuple[str, dict[str, int]]:
        """A new piece of rows, in folders by bucket, and how many each holds."""
        piece = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("__bucket", bucket).write.partitionBy("__bucket").parquet(f"{self.path}/data/{piece}")
        if not any(n.startswith("__bucket=") for n in self.files.names(f"data/{piece}")):
            return piece, {}
        counts = self.spark.read.parquet(f"{self.path}/data/{piece}").groupBy("__bucket").count().collect()
        return piece, {str(r["__bucket"]): r["count"] for r in counts}

    def merge(
        self, batch: DataFrame, keys: Sequence[str], rules: Mapping[str, str], seq: str = "seq", ranks: Mapping[str, int] | None = None, batch_id: int | None = None, writer: str = ""
    ) -> DataFrame:
        """Adds the batch, and gives the table with is_new (whether the key came with this batch).

        A writer's batches are numbered upwards: one whose number isn't above the writer's last one has been added before, and changes nothing.
        """
        columns = [*keys, *rules]
        rows = batch.select(*columns, F.col(seq).cast("long").alias("__seq"))
        written: tuple[str, dict[str, int]] | None = None
        while True:
            base = self.manifest() or {"version": 0, "keys": list(keys), "rules": dict(rules), "ranks": ranks, "writers": {}, "buckets": {}, "count": self.buckets}
            if (base["keys"], base["rules"], base["count"]) != (list(keys), dict(rules), self.buckets):
                raise ValueError("the table has other keys, rules or buckets")
            if batch_id is not None and batch_id <= base["writers"].get(writer, -1):
                return self.fold(base).withColumn("is_new", F.lit(False)).drop("__since")
            version = base["version"] + 1
            if written is None:
                # in which version it comes is known only when that is put: null stands for the piece's own
                kinds = {f.name: f.dataType for f in StructType.fromJson(base["schema"])} if "schema" in base else dict(rows.groupBy(*keys).agg(*[folded(c, r, ranks).alias(c) for c, r in rules.items()]).dtypes)
                rows = rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns], "__seq", F.lit(None).cast("long").alias("__since"))  # sums are wider than what they add up
                written = self.write(rows, keys)
            buckets = {b: list(x) for b, x in base["buckets"].items()}
            for b, n in written[1].items():
                buckets.setdefault(b, []).append([written[0], version, n])
            manifest = base | {"version": version, "schema": json.loads(rows.schema.json()), "buckets": buckets, "writers": base["writers"] | ({writer: batch_id} if batch_id is not None else {})}
            if self.put(manifest):
                break
        out = self.fold(manifest).withColumn("is_new", F.col("__since") == version).drop("__since")
        self.compact()
        return out

    def compact(self) -> int | None:
        """Folds the buckets that are due into one piece each, in a version of its own; that version, or None if none was due.

        What others add meanwhile stays behind the folded piece; what others fold meanwhile wins.
        """
        base = self.manifest()
        if not base:
            return None

        def due(pieces: list) -> bool:
            later = sum(n for _, _, n in pieces[1:])
            return len(pieces) > MOST_PIECES or later > max(MOST_SHARE * pieces[0][2], LATER_ROWS)

        wanted = sorted(b for b, pieces in base["buckets"].items() if due(pieces))
        if not wanted:
            return None
        # Folded rows stand at the last of their pieces' versions: all that comes later stands after them.
        rows = self.fold(base, wanted).withColumn("__seq", F.lit(0).cast("long"))
        piece, counts = self.write(rows, base["keys"])
        while True:
            now = self.manifest()
            buckets = dict(now["buckets"])
            for b in wanted:
                if buckets[b][: len(base["buckets"][b])] != base["buckets"][b]:
                    return None
                buckets[b] = [[piece, base["buckets"][b][-1][1], counts.get(b, 0)], *buckets[b][len(base["buckets"][b]) :]]
            manifest = now | {"version": now["version"] + 1, "buckets": buckets}
            if self.put(manifest):
                return manifest["version"]

    def vacuum(self, keep: int = 1, older_than: float = 86_400) -> list[str]:
        """Deletes pieces that none of the last keep versions names and that are older than older_than seconds, so that merges under way keep theirs;
        their names. Versions before those can't be read any more, and go."""
        versions = self.versions()
        used = {piece for v in versions[-keep:] for pieces in self.manifest(v)["buckets"].values() for piece, _, _ in pieces}
        gone = [p for p in self.files.names("data") if p not in used and (self.files.age(f"data/{p}") or 0) >= older_than]
        for p in gone:
            self.files.drop(f"data/{p}")
        for v in versions[:-keep]:
            self.files.drop(f"log/{v:020}.json")
        return gone
