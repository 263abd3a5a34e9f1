"""Event windows with late data, and commands with their completions, as streams; logs with state are in ``state``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of ``events(ts, event_type, value)`` per window; later than the watermark is left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,4)")).alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def completed_pairs(pending: DataFrame, completed: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream-stream join of ``(command_id, ts)``: each pending command with its completion within the watermark, or null."""
    p = pending.select("command_id", F.col("ts").alias("asked")).withWatermark("asked", late)
    c = completed.select(F.col("command_id").alias("done_id"), F.col("ts").alias("done")).withWatermark("done", late)
    within = (F.col("command_id") == F.col("done_id")) & (F.col("done") >= F.col("asked")) & (F.col("done") <= F.col("asked") + F.expr(f"interval {late}"))
    return p.join(c, within, "left_outer").select("command_id", "asked", "done")
