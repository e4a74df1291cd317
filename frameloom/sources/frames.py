"""Frame tables: one row for each saved frame of a walker, from an event table or a run's partitioned history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import frame_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: a user is a walker, a day an iteration, the coordinates are value and the property k."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("double")
    out = e.select(
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("iteration"),
        F.col("user_id").alias("walker"), (F.row_number().over(w) - 1).alias("frame"), F.col("value").alias("x"), k.alias("y"), F.col("event_type").alias("state"), "event_id",
    )
    return out


def walker_births(frames: DataFrame) -> DataFrame:
    """(walker, parent_walker, parent_frame): walker w starts at the middle frame of walker w // 2, walker 0 at nothing. Only
    walkers are counted and joined, a row each."""
    sizes = frames.groupBy("walker").agg(F.count("*").alias("n"))
    up = sizes.select(F.col("walker").alias("parent_walker"), F.floor(F.col("n") / 2).alias("parent_frame"))
    own = sizes.select("walker", F.when(F.col("walker") > 0, F.floor(F.col("walker") / 2)).alias("_up"))
    return own.join(up, own["_up"] == up["parent_walker"], "left").select("walker", "parent_walker", "parent_frame")


def with_lineage(frames: DataFrame) -> DataFrame:
    """Add frame_key and parent: the walker's previous frame; a walker's first frame comes from the middle frame of
    walker // 2, walker 0's first frame from nothing."""
    key = frame_key("iteration", "walker", "frame")
    w = W.partitionBy("walker").orderBy("frame")
    out = frames.withColumn("frame_key", key).withColumn("before", F.lag("frame_key").over(w))
    born = walker_births(frames)
    spawned = frames.select("iteration", "walker", "frame").join(born.select(F.col("walker").alias("child"), F.col("parent_walker").alias("walker"), F.col("parent_frame").alias("frame")), ["walker", "frame"])
    spawned = spawned.select(F.col("child"), key.alias("spawn"), F.lit(0).cast("long").alias("first"))
    joined = out.join(spawned, (out.frame == spawned["first"]) & (out.walker == spawned["child"]), "left")
    return joined.select(*frames.columns, "frame_key", F.coalesce("before", "spawn").alias("parent"))


def read_history(spark: SparkSession, path: str, dimension: int | None = None, window: int | None = None) -> DataFrame:
    """A run's frames, partitioned by iteration; only iterations of the wanted dimension, and of those the last `window`."""
    df = spark.read.parquet(path)
    if dimension is not None:
        df = df.where(F.col("cv_dim") == dimension)
    return last_iterations(df, window)


def last_iterations(df: DataFrame, window: int | None) -> DataFrame:
    """Rows of the last `window` distinct iterations (null: all, 0: none)."""
    if window is None:
        return df
    if window < 0:
        raise ValueError("the window can't be negative")
    keep = df.select("iteration").distinct().orderBy(F.desc("iteration")).limit(window)
    return df.join(F.broadcast(keep), "iteration", "left_semi")  # at most `window` rows


def merge_deltas(deltas: DataFrame, upto: int | None = None) -> DataFrame:
    """Newest entry of each iteration among checkpoint deltas (ckpt, iteration, entry)."""
    d = deltas if upto is None else deltas.where(F.col("ckpt") <= upto)
    return d.groupBy("iteration").agg(F.max_by("entry", "ckpt").alias("entry"), F.max("ckpt").alias("ckpt"))


def missing_checkpoints(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.select("ckpt").join(present.select("ckpt").distinct(), "ckpt", "left_anti")


def run_meta(lines: DataFrame, column: str = "value") -> DataFrame:
    """Numeric `# key=value` lines of a run log."""
    pair = lambda k: F.regexp_extract(column, r"^#\s*([^=\s]+)\s*=\s*(.*?)\s*$", k)
    return lines.where(F.col(column).startswith("#")).select(pair(1).alias("key"), pair(2).try_cast("double").alias("number")).where("key <> '' AND number IS NOT NULL")
