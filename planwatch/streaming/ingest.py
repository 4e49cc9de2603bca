"""Incremental ingest: new files become batches that are merged into a snapshot, once each in effect."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..state.snapshot import SnapshotStore


def merge_stream(
    spark: SparkSession, folder: str, schema: StructType, store: SnapshotStore, checkpoint: str, keys: Sequence[str], rules: Mapping[str, str], order: Sequence[str], ranks: Mapping[str, int] | None = None, file_format: str = "parquet"
) -> StreamingQuery:
    """Reads what is new in the folder and merges it, then ends. A batch that is replayed after a failure changes nothing, sums included: the
    store knows the last batch of each checkpoint."""

    def put(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        seq = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        store.merge(batch.withColumn("seq", seq), keys, rules, ranks=ranks, batch_id=number, writer=checkpoint)

    rows = spark.readStream.schema(schema).format(file_format).load(folder)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extra: counts of each kind in tumbling windows, of a stream (with a watermark) or of a table."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
