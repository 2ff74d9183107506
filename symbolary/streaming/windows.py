"""Streams: windowed counts with late data, and re-extraction of changed files. Beyond what a batch engine needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total by hour; on a stream, events later than `late` behind the newest are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def keep_extracted(changes: DataFrame, out: str, checkpoint: str):
    """Start a query that extracts each batch of changed files (path, source) into out/batch=N; the latest batch of a path counts."""
    from symbolary.extract.engine import extract

    def put(batch: DataFrame, number: int) -> None:
        extract(batch.dropDuplicates(["path"])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    """The rows of each path's latest batch."""
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["path", "batch"], "left_semi")
