"""Restart-frame selection: density, recency, least counts, outliers, farthest points; scores apart from draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import stable_key
from ..joins import join_states
from ..scratch import materialize, ship


def density_weights(binned: DataFrame, cell: str = "cell", closeness: DataFrame | None = None) -> DataFrame:
    """(cell, population, weight): 1 / population, times the cells' closeness where given (cell, closeness), normalised;
    uniform where nothing is left of it."""
    pop = binned.groupBy(cell).agg(F.count("*").alias("population")).withColumn("_w", 1 / F.col("population"))
    if closeness is not None:
        pop = pop.join(closeness.select(cell, "closeness"), cell, "left").withColumn("_w", F.col("_w") * F.coalesce("closeness", F.lit(0.0)))
    total = pop.agg(F.sum("_w").alias("total"), F.count("*").alias("cells"))
    weight = F.when(F.col("total") > 0, F.col("_w") / F.nullif("total", F.lit(0.0))).otherwise(1 / F.col("cells"))
    return pop.crossJoin(F.broadcast(total)).select(cell, "population", weight.alias("weight"))


def tiled(picked: DataFrame, n: int, order: list[str]) -> DataFrame:
    """n rows of a selection that has fewer: its rows in order, again and again; `pick` numbers them. picked has n rows at
    most, so its ranking is one small window."""
    ranked = picked.withColumn("_k", F.row_number().over(W.orderBy(*order)) - 1).withColumn("_m", F.count("*").over(W.partitionBy()))
    times = F.sequence(F.col("_k"), F.lit(n - 1), F.col("_m"))
    return ranked.where(F.col("_k") < n).withColumn("pick", F.explode(times)).drop("_k", "_m")


def voronoi_weights(populations: DataFrame, areas: list[float], centre: str = "centre", closeness: DataFrame | None = None) -> DataFrame:
    """(centre, population, weight): area over population, times closeness where given, normalised. Empty cells have none."""
    area = F.element_at(F.lit([float(a) for a in areas]), F.col(centre) + 1)
    w = populations.where("population > 0").withColumn("_w", area / F.col("population"))
    if closeness is not None:
        w = w.join(closeness.select(centre, "closeness"), centre, "left").withColumn("_w", F.col("_w") * F.coalesce("closeness", F.lit(0.0)))
    return w.crossJoin(F.broadcast(w.agg(F.sum("_w").alias("_t")))).select(centre, "population", F.when(F.col("_t") > 0, F.col("_w") / F.nullif("_t", F.lit(0.0))).otherwise(F.lit(0.0)).alias("weight"))


def outlier_weights(scores: DataFrame, row_id: str, lof: str = "lof", distance: str | None = None) -> DataFrame:
    """(row_id, weight): the score above the smallest, over the largest of that, 1 where all are equal; with a column of
    distances to a target, times 1 / (distance + 1e-10) over the largest of that. One row has weight 1."""
    columns = [F.min(lof).alias("_lo"), F.max(lof).alias("_hi")] + ([F.min(distance).alias("_d")] if distance else [])
    df = scores.crossJoin(F.broadcast(scores.agg(*columns)))
    w = F.when(F.col("_hi") > F.col("_lo"), (F.col(lof) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).otherwise(F.lit(1.0))
    if distance:
        w = w * (F.col("_d") + 1e-10) / (F.col(distance) + 1e-10)
    return df.select(row_id, w.alias("weight"))


def density_hard(binned: DataFrame, n: int, seed: int, row_id: str, cell: str = "cell", stale: DataFrame | None = None) -> DataFrame:
    """One frame of each of the n least populated cells: by population, cells picked lately last, then a stable key; the
    member is the one with the smallest key. Members are reduced before the shuffle; only n rows are kept by any task."""
    key = F.struct(stable_key(seed, row_id).alias("k"), F.col(row_id).alias("id"))
    bins = binned.groupBy(cell).agg(F.count("*").alias("population"), F.min(key)["id"].alias(row_id))
    if stale is not None:
        bins = bins.join(stale.select(cell).distinct().withColumn("stale", F.lit(1)), cell, "left").fillna(0, ["stale"])
    else:
        bins = bins.withColumn("stale", F.lit(0))
    return bins.withColumn("rank_key", stable_key(seed + 1, cell)).orderBy("population", "stale", "rank_key", cell).limit(n).select(cell, "population", "stale", row_id)


def uniform_of(seed: int, *columns) -> F.Column:
    """A number in (0, 1) from a seed and columns: 52 bits of an MD5, the same in any engine and partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def weighted_draw(scored: DataFrame, weight: str, n: int, seed: int, row_id: str) -> DataFrame:
    """n rows with probability in proportion to weight. Without replacement, as the n largest ln(u) / w (Efraimidis and
    Spirakis, 2006), while n rows have a weight; else with replacement, so that it's n rows all the same. Non-finite and
    non-positive weights count as nothing; if all do, the draw is uniform. No rows, no draw."""
    spark = scored.sparkSession
    w = F.when(F.isnan(weight) | F.col(weight).isNull() | (F.col(weight) <= 0) | (F.col(weight) == float("inf")), F.lit(0.0)).otherwise(F.col(weight))
    some = scored.agg(F.max(w).alias("_most"), F.count(F.when(w > 0, True)).alias("_some"), F.count("*").alias("_all")).first()
    even = not some["_most"]
    df = scored.withColumn("_w", F.lit(1.0) if even else w).where("_w > 0")
    if (some["_all"] if even else some["_some"]) >= n:
        return df.withColumn("_key", F.ln(uniform_of(seed, row_id)) / F.col("_w")).orderBy(F.desc("_key"), row_id).limit(n).drop("_w", "_key")
    # under n rows: running sums in one small window, and n numbers looked up in them
    run = df.withColumn("_to", F.sum("_w").over(W.orderBy(row_id))).withColumn("_t", F.sum("_w").over(W.partitionBy()))
    run = run.withColumn("_from", F.col("_to") - F.col("_w"))
    draws = spark.range(n).select((uniform_of(seed, "id")).alias("_u"))
    inside = (F.col("_u") * F.col("_t") >= F.col("_from")) & (F.col("_u") * F.col("_t") < F.col("_to"))
    return draws.join(F.broadcast(run), inside).drop("_u", "_w", "_to", "_from", "_t")


def least_counts(frames: DataFrame, state: str, power: float = 1.0) -> DataFrame:
    """Add weight (1 / c^power) / c with c the state's count: summed first, joined back small."""
    c = frames.groupBy(state).agg(F.count("*").alias("_n"))
    return join_states(frames, c.withColumn("weight", 1 / F.pow(F.col("_n").cast("double"), F.lit(float(power))) / F.col("_n")), state, "_n")


def least_counts_of(frames: DataFrame, row_id: str, vector: str, k: int, power: float = 1.0, seed: int = 0) -> DataFrame:
    """least_counts over k centres that are fitted to these very frames; the centre's number is in `state`."""
    from . import clustering

    centres, _, _ = clustering.kmeans(frames, row_id, vector, k, seed=seed)
    return least_counts(clustering.with_nearest(frames, vector, centres, "state"), "state", power)


def knn(points: DataFrame, row_id: str, vector: str, k: int, block: int = 256, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """(id, neighbour, d2, rank) of the k nearest others, ties by id. Exact.

    While all vectors come to at most broadcast_bytes (counted first), every task gets them, in blocks, and its own points
    stay where they are: no shuffle. Beyond that, points meet by cells or by blocks (neighbours).
    """
    sizes = points.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if sizes["n"] * (8 * (sizes["d"] or 0) + 8) <= broadcast_bytes:
        return _knn_broadcast(points.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")), k, block)
    from .neighbours import nearest_neighbours

    return nearest_neighbours(points, row_id, vector, k)[0]


def _knn_broadcast(p: DataFrame, k: int, block: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    from .neighbours import nearest_rows

    ship(p.sparkSession)
    rows = p.orderBy("id").toArrow()
    ids = rows.column("id").to_numpy()
    if not len(ids):
        return p.selectExpr("id", "id AS neighbour", "0D AS d2", "1 AS rank")
    vectors = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    same = int(np.unique(ids, return_counts=True)[1].max())
    sent = p.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches):
        ids, v = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, block):
                own = b.slice(lo, block)
                x, me = own.column("v").flatten().to_numpy().reshape(own.num_rows, -1), own.column("id").to_numpy()
                at, to, d = nearest_rows(x, v, k + same)  # the vectors stand in order of id, a point's own among them
                other = ids[to] != me[at]
                at, to, d = at[other], to[other], d[other]
                rank = np.arange(len(at)) - np.searchsorted(at, np.arange(len(me)))[at] + 1
                ok = np.flatnonzero(rank <= k)
                ok = ok[np.lexsort((rank[ok], at[ok]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (me[at[ok]], ids[to[ok]], d[ok], rank[ok].astype(np.int32))], names=["id", "neighbour", "d2", "rank"])

    return p.mapInArrow(run, "id long, neighbour long, d2 double, rank int")


def local_outlier_factor(points: DataFrame, row_id: str, vector: str, k: int = 20) -> DataFrame:
    """(id, lof): mean local reachability density of the k neighbours over the point's own; a point isn't its own
    neighbour."""
    g = materialize(knn(points, row_id, vector, k).select("id", "neighbour", F.sqrt("d2").alias("d")), "graph")
    kdist = g.groupBy("id").agg(F.max("d").alias("kdist"))
    reach = g.join(kdist.withColumnsRenamed({"id": "neighbour"}), "neighbour").select("id", "neighbour", F.greatest("kdist", "d").alias("reach"))
    lrd = materialize(reach.groupBy("id").agg((1 / F.greatest(F.avg("reach"), F.lit(1e-12))).alias("lrd")), "density")
    near = g.join(lrd.withColumnsRenamed({"id": "neighbour", "lrd": "nlrd"}), "neighbour").groupBy("id").agg(F.avg("nlrd").alias("nlrd"))
    return near.join(lrd, "id").select(F.col("id").alias(row_id), (F.col("nlrd") / F.greatest("lrd", F.lit(1e-12))).alias("lof"))


def farthest_points(points: DataFrame, row_id: str, columns: list[str], n: int, seed: int = 0, target: list[float] | None = None) -> list[int]:
    """ids of n frames, each the farthest from those chosen, ties to the smallest id. Each round is one narrow pass and one
    row; the distance to the nearest chosen point is an expression over the (at most n) chosen points, nothing is kept."""
    from ..functions.expressions import squared_distance

    first = points.orderBy(squared_distance(columns, target) if target else stable_key(seed, row_id), row_id).select(row_id, *columns).first()
    chosen = [first] if first else []
    while chosen and len(chosen) < n:
        d = [squared_distance(columns, [c[x] for x in columns]) for c in chosen]
        near = F.least(*d) if len(d) > 1 else d[0]
        top = points.select(F.struct(near.alias("d"), (-F.col(row_id)).alias("i"), *columns).alias("s")).agg(F.max("s").alias("s")).first()["s"]
        if top["d"] <= 0:
            break
        chosen.append({row_id: -top["i"], **{c: top[c] for c in columns}})
    return [int(c[row_id]) for c in chosen]
