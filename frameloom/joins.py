"""Joins and tables that hold whatever the keys' shares: hot keys stay where they are, equal buckets meet unmoved."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, scratch_path


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Write df as a table in the shared folder, dealt over buckets by a hash of keys and sorted by them in each, and read it.

    Tables of equal buckets meet in merge joins without a shuffle of their rows.
    """
    spark = df.sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}", scratch_path(spark, name)
    dealt = df.repartition(buckets, *keys).write.bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:])
    dealt.format("parquet").option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def join_by_share(left: DataFrame, right: DataFrame, on: list[str], weight: str, share: int = 1000) -> DataFrame:
    """left inner join right on the columns `on`; right has one row for each key.

    weight: a column of right with at least the number of left's rows that have the key. Keys with more than 1 / share of
    all weights are fewer than share, whatever the tables' sizes; those rows of right are broadcast, so left's rows of a
    hot key stay where they are. All others meet by a shuffle.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * share > total
    hot = right.where(heavy)
    near = left.join(F.broadcast(hot), on)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(~heavy).hint("merge"), on)
    return near.unionByName(rest)


def join_states(frames: DataFrame, states: DataFrame, on: str, weight: str, most: int = 1 << 17) -> DataFrame:
    """frames inner join states on a column of few values; states has one row for each and `weight`, how many frames have it.

    states is written and counted first. Up to `most` rows of it are broadcast, so that frames stay where they are and a
    state of any share is no task of its own; more of them meet by join_by_share.
    """
    states = materialize(states, "states")
    joined = frames.join(F.broadcast(states), on) if states.count() <= most else join_by_share(frames, states, [on], weight)
    return joined.drop(weight)
