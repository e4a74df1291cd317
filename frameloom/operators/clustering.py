"""Centres of point clouds at scale: an index that is asked in batches, seeding by a table of cells or by oversampled
rounds, settled k-means.

Points are rows with an id and a vector (array<double>). Every round is one pass that sends the centres out and brings
back one row of sums for each task and centre.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize, ship
from .spawning import uniform_of

LEAF = 16


class CentreIndex:
    """A k-d tree over centres: nearest(x) gives, for each row of x, the nearest centre's number and squared distance,
    ties to the smallest number. A batch goes down the tree together; only rows whose best distance reaches over a
    splitting plane visit the other side."""

    def __init__(self, centres: np.ndarray):
        self.centres = np.ascontiguousarray(centres, float)
        if self.centres.ndim != 2 or not len(self.centres):
            raise ValueError("an index needs at least one centre")
        self.tree = self._split(np.arange(len(self.centres)))

    def _split(self, own: np.ndarray):
        c = self.centres[own]
        span = c.max(axis=0) - c.min(axis=0)
        if len(own) <= LEAF or not span.any():
            return np.sort(own)
        axis = int(span.argmax())
        order = own[np.argsort(c[:, axis], kind="stable")]
        cut = self.centres[order[len(order) // 2], axis]
        low = self.centres[own, axis] < cut
        if not low.any():  # half of them or more are the smallest
            low = self.centres[own, axis] <= cut
        return axis, self.centres[own[low], axis].max(), self.centres[own[~low], axis].min(), self._split(own[low]), self._split(own[~low])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.ascontiguousarray(x, float)
        best, at = np.full(len(x), np.inf), np.full(len(x), len(self.centres))
        self._visit(self.tree, x, np.arange(len(x)), best, at)
        return at, best

    def _visit(self, node, x, rows, best, at):
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            own, near, who = np.ascontiguousarray(x[rows].T) if x.shape[1] < 8 else x[rows], best[rows], at[rows]
            for k in node:  # ascending numbers: a later centre has to be strictly nearer
                if x.shape[1] < 8:  # axis by axis, which adds up as a sum over few values does
                    far = own[0] - self.centres[k, 0]
                    d = far * far
                    for j in range(1, x.shape[1]):
                        far = own[j] - self.centres[k, j]
                        d += far * far
                else:
                    far = own - self.centres[k]
                    d = (far * far).sum(axis=1)
                nearer = (d < near) | (d == near) & (k < who)
                np.copyto(near, d, where=nearer)
                who[nearer] = k
            best[rows], at[rows] = near, who
            return
        axis, low_end, high_start, low, high = node
        side = x[rows, axis] * 2 < low_end + high_start
        self._visit(low, x, rows[side], best, at)
        self._visit(high, x, rows[~side], best, at)
        # how far each row is from the other side's centres along the axis, at least
        gap = np.maximum(np.where(side, high_start - x[rows, axis], x[rows, axis] - low_end), 0)
        over = gap * gap <= best[rows] * (1 + 1e-12)
        self._visit(high, x, rows[side & over], best, at)
        self._visit(low, x, rows[~side & over], best, at)


def _vectors(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def with_nearest(points: DataFrame, vector: str, centres: np.ndarray, label: str = "centre", distance: str | None = None) -> DataFrame:
    """points with the number of the nearest centre, ties to the smallest, and its squared distance if a name is given.

    The centres are sent once and asked in Arrow batches. Narrow. Vectors have no nulls and the centres' length; columns
    called like the new ones are replaced.
    """
    ship(points.sparkSession)
    sent = points.sparkSession.sparkContext.broadcast(CentreIndex(centres))
    own = [f for f in points.schema.fields if f.name not in (label, distance)]
    names = [f.name for f in own]

    def run(batches):
        index = sent.value
        for b in batches:
            if b.num_rows:
                at, d = index.nearest(_vectors(b, "_v"))
                more = [pa.array(at, pa.int32())] + ([pa.array(d, pa.float64())] if distance else [])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *more], names=[*names, label, *([distance] if distance else [])])

    from pyspark.sql.types import StructType

    schema = StructType(own + StructType.fromDDL(f"`{label}` int" + (f", `{distance}` double" if distance else "")).fields)
    return points.select(*(F.col(f"`{n}`") for n in names), F.col(vector).cast("array<double>").alias("_v")).mapInArrow(run, schema)


def sums_by_centre(points: DataFrame, vector: str, centres: np.ndarray) -> list:
    """(centre, n, cost, sums) of each centre that is nearest to some point: tasks reduce their points to a row a centre."""
    ship(points.sparkSession)
    sent = points.sparkSession.sparkContext.broadcast(CentreIndex(centres))
    k, d = centres.shape

    def run(batches):
        index, n, cost, sums = sent.value, np.zeros(k, np.int64), np.zeros(k), np.zeros((k, d))
        for b in batches:
            if b.num_rows:
                x = _vectors(b, "v")
                at, far = index.nearest(x)
                n += np.bincount(at, minlength=k)
                cost += np.bincount(at, weights=far, minlength=k)
                for j in range(d):
                    sums[:, j] += np.bincount(at, weights=x[:, j], minlength=k)
        hit = np.flatnonzero(n)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(n[hit]), pa.array(cost[hit]), pa.array(sums[hit].tolist(), pa.list_(pa.float64()))], names=["centre", "n", "cost", "sums"])

    parts = points.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "centre int, n long, cost double, sums array<double>")
    whole = parts.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(d)]).alias("sums"))
    return whole.collect()  # a row a centre


def seed_centres(points: DataFrame, row_id: str, vector: str, k: int, rounds: int = 5, factor: float = 2.0, seed: int = 0) -> np.ndarray:
    """k starting centres by oversampled rounds (k-means||; Bahmani et al., 2012).

    A round takes every point with probability factor * k * its share of the cost, decided by a hash of seed, round and
    id, so that the pick is the same in any partitioning; about factor * k points a round reach the driver,
    and there are more rounds while fewer than k points are found. The candidates,
    each weighted by the points nearest to it, are then thinned to k one after another by weighted cost. Fewer distinct
    points than k give that many centres; no points, none.
    """
    rows = points.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    first = rows.orderBy(uniform_of(seed, "id"), "id").first()
    if first is None:
        return np.zeros((0, 0))
    found = {tuple(first["v"])}
    r = 0
    while r < rounds or len(found) < k:
        near = with_nearest(rows, "v", np.array(sorted(found)), "_k", "_d")
        total = near.agg(F.sum("_d").alias("t")).first()["t"]
        if not total:
            break
        took = near.where(uniform_of(seed + 7919 * (r + 1), "id") < F.col("_d") * F.lit(factor * k / total))
        found |= {tuple(x["v"]) for x in took.select("v").collect()}
        r += 1
    candidates = np.array(sorted(found))
    weight = np.zeros(len(candidates))
    for r in sums_by_centre(rows, "v", candidates):
        weight[r["centre"]] = r["n"]
    return candidates[_thinned(candidates, weight, k, seed)]


def _thinned(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> list[int]:
    """The numbers of k weighted candidates, taken one after another by weighted cost."""
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    d = ((candidates - candidates[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(candidates)):
        share = weight * d
        if not share.sum():
            break
        tries = rng.choice(len(candidates), size=4, p=share / share.sum())  # the best of a few draws
        after = [np.minimum(d, ((candidates - candidates[t]) ** 2).sum(axis=1)) for t in tries]
        best = int(np.argmin([(weight * a).sum() for a in after]))
        chosen.append(int(tries[best]))
        d = after[best]
    return sorted(chosen)


def cell_means(points: DataFrame, vector: str, bits: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(means, counts) of the occupied cells of a grid, 2^bits at most in any number of dimensions: every point is in one.

    Each bit halves the cells along the axis where they are widest, within four deviations of the mean; what lies beyond
    belongs to the outermost cells. Where that leaves out more than half of an axis, mean and deviation are taken again of
    what is within, 15 in 16 values at least. Otherwise two passes; the cells reach the driver, fewer where vectors are long.
    """
    first = points.select(vector).first()
    if first is None:
        return np.zeros((0, 0)), np.zeros(0)
    d = len(first[0])
    at = [F.get(vector, F.lit(j)) for j in range(d)]
    low, high = np.full(d, -np.inf), np.full(d, np.inf)
    while True:
        within = [F.when(a.between(F.lit(float(lo)), F.lit(float(hi))), a) for a, lo, hi in zip(at, low, high, strict=True)]
        row = points.agg(*(f(a) for a in within for f in (F.min, F.max, F.avg, F.stddev_pop))).first()
        least, most, mean, sd = np.array(row, float).reshape(d, 4).T
        low, high = np.maximum(least, mean - 4 * sd), np.minimum(most, mean + 4 * sd)
        if not (most - least > 2 * (high - low)).any():
            break
    span = high - low
    split = np.zeros(d, int)
    for _ in range(min(bits, max(10, 18 - int(np.log2(d + 1))))):
        split[(span / 2.0**split).argmax()] += 1
    cell = F.lit(0).cast("long")
    for j in np.flatnonzero(split * (span > 0)):
        n = 1 << int(split[j])
        cell = cell * n + F.least(F.greatest(F.floor((at[j] - float(low[j])) / float(span[j] / n)), F.lit(0)), F.lit(n - 1))
    table = points.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), *(F.sum(a).alias(f"s{j}") for j, a in enumerate(at)))
    found = table.orderBy("cell").toArrow()
    n = found.column("n").to_numpy().astype(float)
    return np.stack([found.column(f"s{j}").to_numpy() / n for j in range(d)], axis=1), n


def settled_means(x: np.ndarray, weight: np.ndarray, centres: np.ndarray, part: float = 1e-9) -> np.ndarray:
    """Rounds of weighted k-means over a table of cells until the cost falls by less than its part: a start for rounds over
    the points, found without reading them. Centres without points stay."""
    middle = np.average(x, axis=0, weights=weight)
    x, centres, before = x - middle, centres - middle, np.inf
    k, step, own = len(centres), max(1, (1 << 20) // len(centres)), (x * x).sum(axis=1)
    while True:
        at, cost, half = np.empty(len(x), int), 0.0, (centres * centres).sum(axis=1)
        for i in range(0, len(x), step):
            far = half - 2 * (x[i : i + step] @ centres.T)
            at[i : i + step] = far.argmin(axis=1)
            cost += float(weight[i : i + step] @ (far.min(axis=1) + own[i : i + step]))
        if not before - cost > part * cost:
            return centres + middle
        n, before = np.bincount(at, weights=weight, minlength=k), cost
        for j in range(x.shape[1]):
            centres[:, j] = np.where(n > 0, np.bincount(at, weights=weight * x[:, j], minlength=k) / np.maximum(n, 1), centres[:, j])


def seeded(points: DataFrame, vector: str, k: int, seed: int = 0) -> np.ndarray | None:
    """k starting centres that are settled on the points' cells; none where the cells are under eight a centre."""
    means, n = cell_means(points, vector)
    return settled_means(means, n, means[_thinned(means, n, k, seed)]) if len(means) >= 8 * k else None


def kmeans(points: DataFrame, row_id: str, vector: str, k: int, start: np.ndarray | None = None, rounds: int = 200, tolerance: float = 1e-9, settle: float = 1e-5, seed: int = 0, exactly: int | None = None) -> tuple[np.ndarray, float, int]:
    """(centres, cost, rounds) of settled k-means: no centre moves by more than tolerance, or the cost falls by less than its
    part `settle`. start: centres to go on from; a centre keeps its number, and one that loses all its points stays where
    it is, so labels can be compared from fit to fit. Without a start, the centres settle on a table of cells first
    (`seeded`; seed_centres where the cells are few), so that few rounds over the points are left. Not settled after `rounds`
    is an error. exactly: the centres after that many rounds, settled or not, for results that are defined by it (a round
    that moves nothing ends it, since all later ones are alike). The vectors are written once and read by every round."""
    rows = materialize(points.select(F.col(vector).cast("array<double>").alias("v")), "points")
    try:
        centres = seeded(rows, "v", k, seed) if start is None else np.array(start, float)
        if centres is None:
            named = materialize(points.select(F.col(row_id).alias("id"), F.col(vector).alias("v")), "points")
            centres = seed_centres(named, "id", "v", k, seed=seed)
            discard(named)
        if not len(centres):
            raise ValueError("no points to cluster")
        before = np.inf
        for done in range(1, (rounds if exactly is None else exactly) + 1):
            found = sums_by_centre(rows, "v", centres)
            cost = float(sum(r["cost"] for r in found))
            new = centres.copy()
            for r in found:
                new[r["centre"]] = np.array(r["sums"]) / r["n"]
            moved = np.abs(new - centres).max()
            if exactly is None and (moved <= tolerance or before - cost < settle * cost) or not moved:
                return centres, cost, done
            centres, before = new, cost
        if exactly is not None:
            return centres, float(sum(r["cost"] for r in sums_by_centre(rows, "v", centres))), exactly
        raise RuntimeError(f"the centres still moved by {moved:g} after {rounds} rounds")
    finally:
        discard(rows)


def regular_centres(points: DataFrame, row_id: str, vector: str, distance: float, most: int = 1000) -> np.ndarray:
    """Regular-space centres: each the point farthest from those before, until all points are nearer than distance. Ties go
    to the smallest id, and the smallest id is the first centre. More than `most` centres are an error: they'd leave points
    that are farther off. The vectors are written once; a round compares with the newest centre alone."""
    own = points.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    first = own.orderBy("id").first()
    if first is None:
        return np.zeros((0, 0))
    centres, index = [first["v"]], materialize(own, "points")
    try:
        while True:
            near = with_nearest(index, "v", np.array(centres), "_k", "_d")
            top = near.agg(F.max(F.struct("_d", (-F.col("id").cast("decimal(38,0)")).alias("i"), "v")).alias("p")).first()["p"]
            if top["_d"] < distance * distance or not top["_d"]:
                return np.array(centres)
            if len(centres) == most:
                raise ValueError(f"{most} centres leave points that are {np.sqrt(top['_d']):g} away")
            centres.append(top["v"])
    finally:
        discard(index)


def cells(points: DataFrame, vector: str, centres: np.ndarray, areas: np.ndarray | None = None) -> DataFrame:
    """(centre, centre's vector, population, area, mean of its points): a row for each centre, those without points too.
    One pass, in which tasks reduce their points to a row a centre."""
    own = {r["centre"]: r for r in sums_by_centre(points, vector, centres)}
    rows = []
    for k, c in enumerate(centres):
        r = own.get(k)
        rows.append((k, [float(x) for x in c], r["n"] if r else 0, float(areas[k]) if areas is not None else None, [s / r["n"] for s in r["sums"]] if r else None))
    return points.sparkSession.createDataFrame(rows, "centre int, vector array<double>, population long, area double, mean array<double>")
