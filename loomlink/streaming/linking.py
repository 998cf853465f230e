"""Linking of records as they arrive, against the keys of the listed entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_stream(arrivals: DataFrame, listed: DataFrame, target: str, checkpoint: str, once: bool = True):
    """Writes ``batch, s1, rid`` of the arriving ``(gid, country, name_key)`` whose key one listed entity has; returns the running query.

    A batch that is repeated after a failure replaces its own folder, so no link is written twice.
    """
    keys = listed.where("name_key <> ''").groupBy("country", "name_key").agg(F.count(F.lit(1)).alias("n"), F.min("gid").alias("s1")).where("n = 1").drop("n")

    def write(batch: DataFrame, number: int) -> None:
        links = batch.where("name_key <> ''").join(keys, ["country", "name_key"]).select("s1", F.col("gid").alias("rid"))
        links.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``window_start, event_type, n, total`` of a stream of events, late ones within the watermark."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
