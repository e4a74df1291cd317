"""Small inputs of a run: path requests, configuration, labels in file names, positions by index."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_point(text) -> "F.Column":
    """`a,b` as an array of doubles; an error where a part isn't a number."""
    parts = F.split(F.trim(text if not isinstance(text, str) else F.col(text)), r"\s*,\s*")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when(F.exists(numbers, lambda x: x.isNull()), F.raise_error(F.lit("not a point of numbers")).cast("array<double>")).otherwise(numbers)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair, start, end) of a JSON list of {start, end}, or a CSV file with those columns as `a,b` or as start_0, start_1,
    ...; no pairs, and points of unequal dimensions, are errors."""
    if path.lower().endswith(".json"):
        rows = spark.read.option("multiLine", "true").schema("start array<double>, end array<double>").json(path)
    else:
        raw = spark.read.option("header", "true").csv(path)
        if {"start", "end"} <= set(raw.columns):
            rows = raw.select(parse_point("start").alias("start"), parse_point("end").alias("end"))
        else:
            side = lambda n: sorted((c for c in raw.columns if c.startswith(n + "_")), key=lambda c: int(c.rsplit("_", 1)[1]))
            if not side("start") or not side("end"):
                raise ValueError("a file of pairs has start and end, or start_0 and end_0 and so on")
            rows = raw.select(*(F.array(*[F.col(c).cast("double") for c in side(n)]).alias(n) for n in ("start", "end")))
    seen = rows.agg(F.count("*").alias("n"), F.min(F.least(F.size("start"), F.size("end"))).alias("lo"), F.max(F.greatest(F.size("start"), F.size("end"))).alias("hi")).first()
    if not seen["n"]:
        raise ValueError("a file of pairs holds one at least")
    if seen["lo"] != seen["hi"] or seen["lo"] < 1:
        raise ValueError("the points of a file of pairs have one dimension")
    return rows.select(F.monotonically_increasing_id().alias("pair"), "start", "end")


@dataclass(frozen=True)
class Campaign:
    """A campaign's settings; paths are relative to the file they stand in."""

    name: str = "campaign"
    walkers: int = 10
    iterations: int = 100
    n_bins: tuple[int, ...] = (30, 30)
    bounds: tuple[tuple[float, float], ...] | None = None
    selection: str = "density"
    spawn_type: str = "probabilistic"
    history_window: int | None = None
    checkpoint_every: int = 1
    patience: int = 0
    max_bins: int = 150
    min_survivors: float = 0.5
    seed: int = 42
    topology: str | None = None
    output: str = "run"


def load_campaign(path: str) -> Campaign:
    """A JSON settings file; what isn't known, and what can't be, is an error."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    known = {x.name for x in fields(Campaign)}
    if unknown := sorted(set(raw) - known):
        raise ValueError(f"settings that don't exist: {', '.join(unknown)}")
    base = os.path.dirname(os.path.abspath(path))
    for key in ("topology", "output"):
        if raw.get(key):
            raw[key] = os.path.normpath(os.path.join(base, raw[key]))
    if "n_bins" in raw:
        raw["n_bins"] = tuple(raw["n_bins"])
    if raw.get("bounds"):
        raw["bounds"] = tuple(map(tuple, raw["bounds"]))
    c = Campaign(**raw)
    if c.walkers < 1 or c.iterations < 1 or any(n < 1 for n in c.n_bins) or not 0 <= c.min_survivors <= 1 or c.history_window is not None and c.history_window < 0:
        raise ValueError("walkers, iterations and bins are positive, min_survivors a share, the window not negative")
    if c.bounds and (len(c.bounds) != len(c.n_bins) or any(hi <= lo for lo, hi in c.bounds)):
        raise ValueError("bounds are a rising pair for each axis")
    return c


def labels_of_files(files: DataFrame, column: str = "path", pattern: str = r"iter_(\d+).*?walker_(\d+)") -> DataFrame:
    """files with iteration and walker read from the names; none that matches is an error."""
    out = files.select("*", *(F.regexp_extract(column, pattern, k).try_cast("int").alias(n) for k, n in ((1, "iteration"), (2, "walker")))).where("iteration IS NOT NULL")
    if out.isEmpty():
        raise ValueError("no file name says its iteration and walker")
    return out


def by_index(frames: DataFrame, requests: DataFrame, walker: str = "walker", frame: str = "frame") -> DataFrame:
    """frames at the requested positions (request, idx), counted by walker and frame; repeats stay, an index outside is an
    error. Positions come from the walkers' sizes: only a row for each walker is ordered in one task."""
    sizes = frames.groupBy(walker).agg(F.count("*").alias("n"))
    base = sizes.select(walker, F.coalesce(F.sum("n").over(W.orderBy(walker).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    inside = F.col("idx").between(F.lit(0), F.col("total") - 1)
    text = F.concat(F.lit("index "), F.col("idx").cast("string"), F.lit(" is outside the frames"))
    wanted = requests.crossJoin(F.broadcast(total)).select("request", F.when(inside, F.col("idx")).otherwise(F.raise_error(text).cast("long")).alias("idx"))
    return frames.join(base, walker).withColumn("idx", F.col("base") + F.col(frame)).drop("base").join(wanted, "idx")


def connected_frames(path: DataFrame, frames: DataFrame, out: str | None = None) -> DataFrame:
    """The rows of frames along a path (step, frame_key), in order, and written as Parquet where a folder is given."""
    rows = path.join(frames, "frame_key").orderBy("step")
    if out:
        rows.write.mode("overwrite").parquet(out)
    return rows
