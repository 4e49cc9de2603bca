"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints. Where none is set, a local session gets a temporary one; a cluster is an error,
    as its machines don't share temporary folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if not found and not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="planwatch-"))
        held = spark.sparkContext.getCheckpointDir()
    elif found and not held:
        spark.sparkContext.setCheckpointDir(found)
    return found or held


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes that Spark hands to Python at a time: texts can be long, and 64 MB, its default, take several times that in a worker.
ARROW_BYTES = 8 << 20


def modest(df: DataFrame) -> DataFrame:
    """df, with Spark's setting of bytes an Arrow batch lowered for the session where it is higher: memory then follows the bytes, not the rows."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name).rstrip("b")) <= ARROW_BYTES:
        conf.set(name, f"{ARROW_BYTES}b")
    return df


def free_name(df: DataFrame, name: str) -> str:
    """name, with lines put under it until no column of df is called so."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows; else unchanged (a shuffle join).

    df should be stored, as it is counted here. Rows must be of bounded width.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def unpartitioned(df: DataFrame) -> DataFrame:
    """Deals df round robin, so that a join on its former key shuffles both sides and can split skewed keys."""
    return df.repartition(partitions(df.sparkSession))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of equal key together in one partition and next to each other."""
    return df.repartition(partitions(df.sparkSession), key).sortWithinPartitions(key)


def meetings(rows: DataFrame, keys: list[str], id_col: str, block: int, sizes: DataFrame | None = None) -> DataFrame:
    """rows with bucket long and side int instead of keys, dealt so that rows of a bucket stand together.

    Rows of equal keys share a bucket. More than block of them are cut into pieces by id, and each pair of pieces gets a bucket of
    its own: side is the row's piece there, or -1 in the bucket of one piece alone (and of uncut rows). So each two rows of equal
    keys meet once with sides that differ or are -1, and no bucket has more than about twice block rows.
    sizes: rows of keys, if that is cheaper than rows to count.
    """
    hot = small(
        stored(
            (sizes or rows)
            .groupBy(*keys)
            .agg(F.count("*").alias("n"))
            .where(F.col("n") > block)
            .select(*keys, F.ceil(F.col("n") / block).cast("int").alias("cuts"))
        ),
        100_000,
    )
    cut = (
        rows.join(hot, keys, "left")
        .withColumn("own", F.coalesce(F.pmod(F.xxhash64(id_col), F.col("cuts")).cast("int"), F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("cuts"), F.lit(1)) - 1)))
        .withColumn("side", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")))
        .withColumn("bucket", F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other")))
    )
    return dealt(cut.drop("own", "other", "cuts"), "bucket")


def runs(frames: Iterator[pd.DataFrame], key: str, at_least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Regroups frames sorted by key so that no run of equal keys is cut; few runs to a frame at a time."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in frames:
        if not len(pdf):
            continue
        held.append(pdf)
        n += len(pdf)
        if n < at_least:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf.reset_index(drop=True)
        k = whole[key].to_numpy()
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if cut:
            yield whole.iloc[:cut].reset_index(drop=True)
        held, n = [whole.iloc[cut:]], len(whole) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


def by_size(frames: Iterator[pd.DataFrame], text: str, most_chars: int) -> Iterator[pd.DataFrame]:
    """Cuts frames so that each holds about most_chars characters, or one row."""
    for pdf in frames:
        size = pdf[text].map(len).cumsum().to_numpy() // most_chars if len(pdf) else np.empty(0)
        for _, part in pdf.groupby(size, sort=False):
            yield part


#: Stands for a null id where ids are packed as numbers.
NO_ID = -(1 << 63)
BLOBS = "batch int, ids binary, flags binary, times binary, sizes binary, texts binary"


def in_batches(rows: DataFrame, most_chars: int = 8_000_000) -> DataFrame:
    """rows (batch int, doc_id long, text string, flag boolean, no nulls) as BLOBS: what one task has of a batch in one compressed row.

    Nothing is shuffled yet; a shuffle by batch then moves a third of the texts' bytes. Rows that are equal in all are packed
    once with how often they stand, so a row repeated without end doesn't fill its batch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for pdf in by_size(frames, "text", most_chars):
            times: dict[tuple, int] = {}
            for row in zip(pdf["batch"].tolist(), pdf["doc_id"].tolist(), pdf["text"], pdf["flag"].tolist(), strict=True):
                times[row] = times.get(row, 0) + 1
            by_batch: dict[int, list[tuple]] = {}
            for (batch, *row), n in times.items():
                by_batch.setdefault(batch, []).append((*row, n))
            out = []
            for batch, held in by_batch.items():
                raw = [t.encode() for _, t, _, _ in held]
                numbers = [np.array([r[k] for r in held], kind).tobytes() for k, kind in ((0, np.int64), (2, np.uint8), (3, np.int64))]
                out.append((batch, *numbers, np.array([len(r) for r in raw], np.int64).tobytes(), pack.compress(b"".join(raw))))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in BLOBS.split(", ")])

    return modest(rows).select("batch", "doc_id", "text", "flag").mapInPandas(run, BLOBS)


def from_batch(pdf: pd.DataFrame) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
    """Of a batch's blobs the different (id, text) in order: ids, texts, flags, and how often each stands."""
    unpack = zstandard.ZstdDecompressor()
    found: dict[tuple[int, bytes], list[int]] = {}
    for ids, flags, times, sizes, texts in zip(*(pdf[c] for c in ("ids", "flags", "times", "sizes", "texts")), strict=True):
        raw, at = unpack.decompress(texts), 0
        numbers = (np.frombuffer(x, kind).tolist() for x, kind in ((ids, np.int64), (flags, np.uint8), (times, np.int64), (sizes, np.int64)))
        for i, flag, n, size in zip(*numbers, strict=True):
            row = found.setdefault((i, raw[at : at + size]), [flag, 0])
            row[1] += n
            at += size
    order = sorted(found)
    return [i for i, _ in order], [t for _, t in order], np.array([found[k][0] for k in order], bool), np.array([found[k][1] for k in order], np.int64)


def squeezed(x: np.ndarray) -> bytes:
    """An array of numbers as compressed bytes, those of one rank together."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(data: bytes, kind: type) -> np.ndarray:
    """What squeezed() was given."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def local_components(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the sets of lab (each element's smallest member so far) along the pairs i, j."""
    while len(i):
        a, b = lab[i], lab[j]
        if (a == b).all():
            break
        m = np.minimum(a, b)
        np.minimum.at(lab, a, m)
        np.minimum.at(lab, b, m)
        while (lab != lab[lab]).any():
            lab = lab[lab]
    return lab


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u long, v long, u above v) that join the same nodes as edges (a long, b long), each partition's set reduced to stars."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in frames:
            ids, at = np.unique(np.concatenate([a, pdf["a"].to_numpy(), b, pdf["b"].to_numpy()]), return_inverse=True)
            lab = local_components(np.arange(len(ids)), *np.split(at, 2))
            on = lab != np.arange(len(ids))
            a, b = ids[on], ids[lab[on]]
        if len(a):
            yield pd.DataFrame({"u": a, "v": b})

    return edges.where("a <> b").select("a", "b").mapInPandas(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): node long, component long (its smallest node).

    Large-star and small-star steps in turn until each node hangs on a smallest one. Each step is joins and partial
    aggregates over edges; nothing but three numbers a round reaches the driver. Nodes without edges
    to other nodes don't appear. Repeated edges and loops count once or not at all.
    """
    e = checkpointed(contracted(edges).distinct())
    while True:
        tops = unpartitioned(e.select(F.col("v").alias("k")).distinct())
        n, nodes, inner = e.join(tops, F.col("u") == F.col("k"), "left").agg(F.count("*"), F.count_distinct("u"), F.count("k")).first()
        if n == nodes and not inner:  # one edge each, to a node that has none
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        down = unpartitioned(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"))
        # Large star: a neighbour above v now hangs on v's smallest neighbour.
        large = (
            e.join(down, e.v == down.k, "left")
            .select("u", F.coalesce("m", "v").alias("v"))
            .where("u <> v")
            .union(e)
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # Small star: u and its other lower neighbours hang on its smallest one.
        pairs = large.join(unpartitioned(least.select(F.col("u").alias("k"), "m")), F.col("u") == F.col("k"))
        e = checkpointed(
            pairs.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
