"""A dictionary of templates that grows with a stream of pages, and windows over event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dictionary_stream(glyphs: DataFrame, folder: str, checkpoint: str):
    """Count templates of a stream of (vec_id, hi, lo): each micro-batch adds its partial counts to a table, so no batch rewrites what is there.

    ``read_dictionary`` sums the partial counts. A batch's folder is named by its number, so a repeated batch overwrites itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("hi", "lo").agg(F.min("vec_id").alias("template_id"), F.count("*").alias("usage"))
        part.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return glyphs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).queryName(f"templates-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()


def read_dictionary(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy("hi", "lo").agg(F.min("template_id").alias("template_id"), F.sum("usage").alias("usage"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and values by window and type; with ``late`` (for streams) state is dropped behind the watermark."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    s = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("w.start").alias("start"), "events")
