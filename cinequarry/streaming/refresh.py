"""Streams: derived tables that follow new rows, and sessions of late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinequarry.functions.text import ascii_tokens
from cinequarry.operators.lexical import postings


def follow_postings(rows: DataFrame, key: str, text: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a postings table in step with a stream of rows: each batch writes a folder of its own.

    A batch that is repeated after a failure overwrites its own folder, so no
    posting is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        postings(batch, key, {"body": ascii_tokens(text)}).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sessions(events: DataFrame, key: str, ts: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n: sessions with gaps of up to ``gap``, final once ``late`` has passed; for batch frames too."""
    windowed = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return windowed.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_rollup(events: DataFrame, key: str, ts: str, *, width: str = "1 hour", late: str = "1 hour", measure: Callable[[], object] | None = None) -> DataFrame:
    """key, start, n (or the given aggregate) in tumbling windows."""
    total = measure() if measure else F.count("*").alias("n")
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(total).withColumn("start", F.col("w.start")).drop("w")
