"""Lineage of frames: parents up to the root, and the path between two frames through their last common ancestor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import squared_distance
from ..scratch import discard, materialize


def to_root(records: DataFrame, start: str, key: str = "frame_key", parent: str = "parent") -> DataFrame:
    """(frame_key, depth) from a frame to its root; a missing parent ends the walk, an unknown start has none, a cycle is
    an error."""
    return chains(records, [start], key, parent).select("frame_key", "depth")


def chains(records: DataFrame, starts: list[str], key: str = "frame_key", parent: str = "parent") -> DataFrame:
    """(start, frame_key, depth) from each start to its root, by doubling: what is known of a chain is carried as far up
    again by a table of jumps that are twice as long each round. log2(depth) rounds over two written columns, so neither
    the records' own plan nor a chain's single steps are repeated."""
    spark = records.sparkSession
    keys = materialize(records.select(F.col(key).alias("k"), F.col(parent).alias("p")), "lineage")
    n, step = keys.count(), 1
    jumps = keys.join(keys.select(F.col("k").alias("p")), "p").select("k", "p")
    wanted = spark.createDataFrame([(x,) for x in dict.fromkeys(starts)], "k string")
    known = materialize(keys.join(F.broadcast(wanted), "k", "left_semi").select(F.col("k").alias("start"), F.col("k").alias("frame_key"), F.lit(0).cast("long").alias("depth")), "chains")
    while True:
        up = materialize(known.join(jumps, known.frame_key == jumps.k).select("start", F.col("p").alias("frame_key"), (F.col("depth") + step).alias("depth")), "chains")
        if up.isEmpty():
            return known
        if step > n:
            raise ValueError("the lineage has a cycle")
        known, step = known.union(up), 2 * step
        far = jumps.select(F.col("k").alias("p"), F.col("p").alias("far"))
        before, jumps = jumps, materialize(jumps.join(far, "p").select("k", F.col("far").alias("p")), "jumps")
        discard(before)


def ancestors_by_doubling(records: DataFrame, key: str = "frame_key", parent: str = "parent", max_rounds: int = 40) -> DataFrame:
    """(frame_key, root, depth) of every record, by pointer doubling: log2(depth) self-joins. A cycle is an error.

    Each round is written as a table, so that plans don't grow and no round is done again.
    """
    rec = records.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    known = rec.select(F.col("k").alias("p"), F.lit(True).alias("known"))
    inner = F.coalesce("known", F.lit(False))
    at = materialize(rec.join(known, "p", "left").select("k", F.when(inner, F.col("p")).otherwise(F.col("k")).alias("root"), inner.cast("long").alias("depth"), inner.alias("open")), "roots")
    for _ in range(max_rounds):
        left = at.where("open")
        if left.isEmpty():
            return at.select(F.col("k").alias(key), "root", "depth")
        up = at.select(F.col("k").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"), F.col("open").alias("still"))
        moved = left.join(up, "root").select("k", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("still").alias("open"))
        before, at = at, materialize(at.where("NOT open").union(moved), "roots")
        discard(before)
    raise ValueError("the lineage has a cycle")


def walker_roots(frames: DataFrame, births: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(frame_key, root, depth) of every frame, as ancestors_by_doubling's, of walkers whose frames are numbered from 0.

    frames: (walker, frame, frame_key); births: (walker, parent_walker, parent_frame), a row for each walker, with a null
    parent at a root. Only walkers are doubled, a row each; frames meet their walker's root and base once, in the shuffle that
    numbers them. A cycle is an error.
    """
    b = births.select(F.col("walker").alias("k"), F.col("parent_walker").alias("p"), F.col("parent_frame").alias("f"))
    there = F.col("p").isNotNull()
    at = materialize(b.select("k", F.coalesce("p", "k").alias("top"), F.when(there, F.col("f") + 1).otherwise(F.lit(0)).cast("long").alias("base"), there.alias("open")), "walkers")
    for _ in range(max_rounds):
        left = at.where("open")
        if left.isEmpty():
            break
        up = at.select(F.col("k").alias("top"), F.col("top").alias("up"), F.col("base").alias("more"), F.col("open").alias("still"))
        moved = left.join(up, "top").select("k", F.col("up").alias("top"), (F.col("base") + F.col("more")).alias("base"), F.col("still").alias("open"))
        before, at = at, materialize(at.where("NOT open").union(moved), "walkers")
        discard(before)
    else:
        raise ValueError("the lineage has a cycle")
    tops = at.select(F.col("top").alias("walker")).distinct()
    firsts = frames.where(F.col("frame") == 0).join(tops, "walker").select(F.col("walker").alias("top"), F.col("frame_key").alias("root"))
    found = at.join(firsts, "top").select(F.col("k").alias("walker"), "root", "base")
    return frames.join(found, "walker").select("frame_key", "root", (F.col("base") + F.col("frame")).alias("depth"))


Segment = tuple[int, int, int]  # walker, the frame it is left at, and that frame's depth


def walker_paths(births: DataFrame, starts: list[tuple[int, int]]) -> list[list[Segment]]:
    """For each start (walker, frame), the segments of its path to the root, the start's first.

    births: (walker, parent_walker, parent_frame), a row for each walker; a null parent, or one that isn't there, ends the
    path. A level of the walkers' tree is one look at births, which is written once in order of walker, for all starts
    together; a few rows a level come back. A walker that comes twice is a cycle, an error.
    """
    rows = materialize(births.select("walker", "parent_walker", "parent_frame").repartitionByRange("walker").sortWithinPartitions("walker"), "births")
    paths: list[list[Segment]] = [[] for _ in starts]
    at = {k: (w, f, 0) for k, (w, f) in enumerate(starts)}
    while at:
        found = {r["walker"]: r for r in rows.where(F.col("walker").isin(sorted({w for w, _, _ in at.values()}))).collect()}
        after = {}
        for k, (walker, frame, depth) in at.items():
            if walker not in found:
                continue
            if any(walker == w for w, _, _ in paths[k]):
                raise ValueError("the lineage has a cycle")
            paths[k].append((walker, frame, depth))
            up = found[walker]
            if up["parent_walker"] is not None:
                after[k] = up["parent_walker"], up["parent_frame"], depth + frame + 1
        at = after
    discard(rows)
    return paths


def path_frames(frames: DataFrame, path: list[Segment]) -> DataFrame:
    """(depth, and frames' columns) of a path's frames: one pass over the walkers' frames, which are numbered from 0."""
    segments = frames.sparkSession.createDataFrame(path, "walker long, top long, base long")  # a row a level of the tree
    own = frames.where(F.col("walker").isin([w for w, _, _ in path])) if len(path) <= 1000 else frames
    inside = own.join(F.broadcast(segments), "walker").where("frame <= top")
    return inside.select((F.col("base") + F.col("top") - F.col("frame")).alias("depth"), *(F.col(c) for c in frames.columns))


def last_common(up: list[Segment], down: list[Segment]) -> tuple[int, int]:
    """Depths of two paths' last common ancestor, below each path's start. None in common is an error."""
    of = {w: (frame, depth) for w, frame, depth in down}
    for walker, frame, depth in up:
        if walker in of:
            last = min(frame, of[walker][0])
            return depth + frame - last, of[walker][1] + of[walker][0] - last
    raise ValueError("no shared ancestor")


def walker_path(frames: DataFrame, births: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """(step, and frames' columns) from start up to the last common ancestor and down to end."""
    a, b = walker_paths(births, [start, end])
    up, down = last_common(a, b)
    first = path_frames(frames, a).where(F.col("depth") <= up).withColumnRenamed("depth", "step")
    rest = path_frames(frames, b).where(F.col("depth") < down).withColumn("depth", F.lit(up + down) - F.col("depth")).withColumnRenamed("depth", "step")
    return first.union(rest)


def nearest_record(records: DataFrame, columns: list[str], point: list[float], order: list[str]) -> DataFrame:
    """The record nearest to a point, ties by order."""
    if len(columns) != len(point):
        raise ValueError(f"{len(point)} coordinates for {len(columns)} columns")
    if records.isEmpty():
        raise ValueError("no records")
    return records.withColumn("d2", squared_distance(columns, point)).orderBy("d2", *order).limit(1)


def connected_path(records: DataFrame, start: str, end: str) -> DataFrame:
    """(step, frame_key) from start up to the last common ancestor and down to end; no common ancestor is an error."""
    both = chains(records, [start, end])
    a = both.where(F.col("start") == start).select("frame_key", F.col("depth").alias("da"))
    b = both.where(F.col("start") == end).select("frame_key", F.col("depth").alias("db"))
    common = a.join(b, "frame_key").orderBy("db").limit(1).select(F.col("da").alias("ca"), F.col("db").alias("cb"))
    checked = common.agg(F.first("ca").alias("ca"), F.first("cb").alias("cb")).select(F.when(F.col("ca").isNotNull(), F.col("ca")).otherwise(F.raise_error(F.lit("no shared ancestor")).cast("int")).alias("ca"), "cb")
    up = a.crossJoin(F.broadcast(checked)).where("da <= ca").select(F.col("da").alias("step"), "frame_key")
    down = b.crossJoin(F.broadcast(checked)).where("db < cb").select((F.col("ca") + F.col("cb") - F.col("db")).alias("step"), "frame_key")
    return up.union(down)
