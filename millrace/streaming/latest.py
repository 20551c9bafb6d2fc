"""Incremental forms of the batch rules: duplicates dropped within a watermark, and an upsert per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators.resolve import keep_last


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Rows of a stream without repeats of keys within the delay; later rows than the watermark go."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that keeps, under path/version=<batch>, the latest row per key; a repeated batch writes the same version again."""
    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = keep_last(df, key, order)
        if number > 0:
            rows = keep_last(rows.unionByName(spark.read.parquet(f"{path}/version={number - 1}")), key, order)
        rows.write.mode("overwrite").parquet(f"{path}/version={number}")
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
