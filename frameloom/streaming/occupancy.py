"""Streaming form of the exploration log: a micro-batch is a set of frames, cells are counted as they are first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(frames: DataFrame, cell: str = "cell") -> DataFrame:
    """(cell, first iteration, frames) as a running aggregate; write it in update or complete mode."""
    return frames.groupBy(cell).agg(F.min("iteration").alias("iteration"), F.count("*").alias("frames"))


def flux(frames: DataFrame, in_target, every: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Windowed share of frames inside the target; rows later than the watermark are dropped, as in any event-time window."""
    return frames.withWatermark(time, late).groupBy(F.window(time, every)).agg(F.avg(F.when(in_target, 1.0).otherwise(0.0)).alias("flux"), F.count("*").alias("frames"))
