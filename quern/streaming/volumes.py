"""Streaming forms of the volume report and of the click join. An extension: the batch forms define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def volume_stream(events: DataFrame, ts: str, bucket_seconds: int = 300, lateness: str = "10 minutes", **sums: str) -> DataFrame:
    """(bucket, n, sums...) per time bucket of a stream; what comes later than ``lateness`` is left out."""
    per = events.withWatermark(ts, lateness).groupBy(F.window(ts, f"{bucket_seconds} seconds").alias("w"))
    return per.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items())).select(F.col("w.start").alias("bucket"), "n", *sums)


def click_stream(impressions: DataFrame, clicks: DataFrame, click_minutes: int = 80, lateness: str = "30 minutes") -> DataFrame:
    """Stream-stream left join: (id, seen_at, clicked) once the time for a click has passed.

    ``impressions``: id, seen_at; ``clicks``: id, clicked_at - timestamps. State is kept for the click time
    and the lateness only.
    """
    a = impressions.select("id", "seen_at").withWatermark("seen_at", lateness)
    b = clicks.select(F.col("id").alias("hit"), "clicked_at").withWatermark("clicked_at", lateness)
    near = (F.col("id") == F.col("hit")) & (F.col("clicked_at") >= F.col("seen_at")) & (F.col("clicked_at") <= F.col("seen_at") + F.expr(f"interval {click_minutes} minutes"))
    return a.join(b, near, "left").select("id", "seen_at", F.col("hit").isNotNull().alias("clicked"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Run a stream over all that is there now and leave its result as Parquet under ``path``."""

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
