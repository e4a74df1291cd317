"""Exact nearest neighbours: cells around pivots where these part the vectors, all pairs of blocks where they don't.

Each vector belongs to the cell of its nearest pivot. From a cell's radius, the pivots' distances and the k + 1 smallest
radii of every cell follows how far any of its points' neighbours can be; a vector goes only to cells in which it can still
be somebody's neighbour. In many dimensions that would be nearly every cell, so there blocks of bounded bytes meet
pairwise. Equal vectors are one, with their smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..joins import join_by_share
from ..scratch import materialize, ship
from .clustering import with_nearest
from .spawning import uniform_of

SALTS = 64
FLAT = 6  # up to so many dimensions boxes part the vectors of a task; their sums have one order
WIDE = 0.1  # the share of cells that a vector meets from which on blocks are cheaper
ASK_BYTES, MET_BYTES = 16 << 20, 128 << 20  # of a block's vectors


def nearest_rows(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance) of the `most` rows of y nearest to each of x, in that order, ties by y's row.
    Rows of y at no finite distance are left out."""
    if not len(x) or not len(y):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    parts = list(_by_boxes(x, y, most) if x.shape[1] <= FLAT else _by_products(x, y, most))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _first(r: np.ndarray, c: np.ndarray, d: np.ndarray, rows: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((c, d, r))
    r, c, d = r[order], c[order], d[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(rows))[r] < most
    return r[keep], c[keep], d[keep]


def _by_products(x: np.ndarray, y: np.ndarray, most: int, ask: int = 256, met: int = 4096):
    """y^2 - 2xy in single precision picks, by more than its rounding, the rows that can be among the nearest; these few are
    compared as they are."""
    with np.errstate(over="ignore", invalid="ignore"):
        there = np.flatnonzero(np.isfinite((y * y).sum(axis=1)))
        if not len(there):
            return
        z = y if len(there) == len(y) else y[there]
        middle = z.mean(axis=0)
        zz = ((z - middle) ** 2).sum(axis=1)
        unit = np.sqrt(zz.max()) or 1.0  # keeps the products in range
        tables = [np.ascontiguousarray(np.column_stack([(z[j : j + met] - middle) * (-2 / unit), zz[j : j + met] / unit**2]).astype("f4").T) for j in range(0, len(z), met)]
        for lo in range(0, len(x), ask):
            a = x[lo : lo + ask]
            own = (a - middle) / unit
            aa = (own * own).sum(axis=1)
            slack = 4 * (a.shape[1] + 4) * float(np.finfo("f4").eps) * (aa + 1) + 1e-30
            asks = np.column_stack([own, np.ones(len(a))]).astype("f4")
            limit = np.full(len(a), np.inf)
            r, c, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            for j, table in zip(range(0, len(z), met), tables, strict=True):
                near = asks @ table
                if not j and near.shape[1] >= most:
                    limit = np.partition(near, most - 1, axis=1)[:, most - 1] + slack
                at = np.flatnonzero(~(near > limit[:, None].astype("f4")))
                if not len(at):
                    continue
                for i in range(0, len(at), 1 << 16):
                    p, q = np.divmod(at[i : i + (1 << 16)], near.shape[1])
                    far = ((a[p] - z[q + j]) ** 2).sum(axis=1)
                    ok = np.isfinite(far)
                    r, c, d = _first(np.concatenate([r, p[ok]]), np.concatenate([c, q[ok] + j]), np.concatenate([d, far[ok]]), len(a), most)
                full = np.flatnonzero(np.bincount(r, minlength=len(a)) == most)
                limit[full] = d[np.searchsorted(r, full, "right") - 1] / unit**2 - aa[full] + slack[full]
            yield r + lo, there[c], d


def _leaves(v: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of v in halves along their widest axis, again and again, down to `size`."""
    out, open_ = [], [np.arange(len(v))]
    while open_:
        own = open_.pop()
        if len(own) <= size:
            out.append(own)
            continue
        axis = int((v[own].max(axis=0) - v[own].min(axis=0)).argmax())
        order = own[np.argpartition(v[own, axis], len(own) // 2)]
        open_ += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def _by_boxes(x: np.ndarray, y: np.ndarray, most: int, at_once: int = 1 << 15):
    """Rows of x by leaves; each meets the leaves of y whose boxes are no farther than its rows' nearest so far."""
    real = np.flatnonzero(np.isfinite(y).all(axis=1))
    if not len(real):
        return iter([(np.zeros(0, int), np.zeros(0, int), np.zeros(0))])
    held = [real[leaf] for leaf in _leaves(y[real], max(32, 2 * most))]
    lo, hi = np.array([y[h].min(axis=0) for h in held]), np.array([y[h].max(axis=0) for h in held])
    sizes = np.array([len(h) for h in held])

    def far(a, c):
        d = np.zeros((len(a), len(c)))
        for j in range(a.shape[1]):
            d += (a[:, j, None] - y[None, c, j]) ** 2
        return d

    def run():
        ask = np.flatnonzero(np.isfinite(x).all(axis=1))
        for leaf in _leaves(x[ask], 64):
            rows = ask[leaf]
            a = x[rows]
            gap = (np.maximum(np.maximum(lo - a.max(axis=0), a.min(axis=0) - hi), 0) ** 2).sum(axis=1)
            # boxes at the same distance: those whose middles are nearest
            order = np.lexsort(((((lo + hi) / 2 - a.mean(axis=0)) ** 2).sum(axis=1), gap))
            first = order[: np.searchsorted(np.cumsum(sizes[order]), most) + 1]
            d = far(a, np.concatenate([held[h] for h in first]))
            limit = np.partition(d, most - 1, axis=1)[:, most - 1] if d.shape[1] >= most else np.full(len(a), np.inf)
            met = np.concatenate([held[h] for h in np.flatnonzero(gap <= limit.max() * (1 + 1e-9))])
            r, c, s = [], [], []
            for j in range(0, len(met), at_once):
                d = far(a, met[j : j + at_once])
                p, q = np.nonzero(d <= limit[:, None])
                r, c, s = [*r, p], [*c, met[j + q]], [*s, d[p, q]]
            r, c, s = _first(np.concatenate(r), np.concatenate(c), np.concatenate(s), len(a), most)
            yield rows[r], c, s

    return run()


def _smallest(rows: DataFrame, by: str, order: list[str], most: int, salt: str) -> DataFrame:
    """The first `most` rows of each `by`, with their rank: first of every salt of it, so that no large group is sorted whole."""
    w = W.partitionBy(by, F.pmod(F.xxhash64(salt), F.lit(SALTS))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def _groups(points: DataFrame, most: int) -> DataFrame:
    """(gid, v, ids, n): equal vectors, their `most` smallest ids, how many there are; gid is the smallest id."""
    kept = _smallest(points, "v", ["id"], most, "id").groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sizes = points.groupBy("v").agg(F.count("*").alias("n"))
    return kept.join(sizes, "v").select(F.get("ids", F.lit(0)).alias("gid"), "v", "ids", "n")


def nearest_neighbours(points: DataFrame, row_id: str, vector: str, k: int, pivots: int | None = None, block: int = 65536, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(id, neighbour, d2, rank) of the k nearest others, ties by id; and a report (cell, queries, targets, met, pairs):
    met are the cells that had to be looked at, the others were skipped.

    Exact, and equal to comparing all pairs. pivots: the root of the distinct vectors, 2000 at most, picked by hash; the
    driver gets them, and k + 1 radii of each. A cell's queries and targets are cut into blocks of about `block` vectors
    that meet pairwise, so that a task holds two blocks whatever the cell's size. Where the pivots' own distances say that a
    vector would meet many cells, and no number of pivots is given, blocks of all vectors meet pairwise instead; a cell of
    the report is then a block of queries. Ids are long and not repeated.
    """
    own = materialize(points.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), "points")
    groups = materialize(_groups(own, k + 1), "groups")
    n = groups.count()
    report = "cell int, queries long, targets long, met int, pairs long"
    if n < 1:
        return own.selectExpr("id", "id AS neighbour", "0D AS d2", "1 AS rank"), own.sparkSession.createDataFrame([], report)
    ship(own.sparkSession)
    m = pivots or max(1, min(2000, math.isqrt(n)))
    chosen = np.array([r["v"] for r in groups.orderBy(uniform_of(seed, "gid"), "gid").limit(m).collect()])
    if pivots is None and _spread(chosen, n, k) > WIDE:
        found, figures = _by_blocks(groups, n, chosen.shape[1], k)
    else:
        found, figures = _by_cells(groups, chosen, k, block)
    best = found.withColumn("_r", F.row_number().over(W.partitionBy("gid").orderBy("d2", "near"))).where(F.col("_r") <= k + 1)
    # each near vector stands for its ids; k + 1 of them are enough, as one may be the asking point itself
    each = best.join(groups.select(F.col("gid").alias("near"), "ids"), "near").select("gid", "d2", F.explode("ids").alias("neighbour"))
    w = W.partitionBy("gid").orderBy("d2", "neighbour")
    lists = each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("d2", "neighbour"))).alias("near"))
    lists = materialize(lists.join(groups.select("gid", "v", "n"), "gid").select("v", "n", "near"), "near")
    rows = join_by_share(own, lists, ["v"], "n").select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("at", "x"))
    out = rows.select("id", "x.neighbour", "x.d2", (F.col("at") + 1).alias("rank"))
    return out, own.sparkSession.createDataFrame(figures, report)


def _spread(pivots: np.ndarray, n: int, k: int) -> float:
    """About which share of the cells a vector would meet: the pivots stand for the vectors, nearer by n's root to d."""
    m, d = pivots.shape
    if m <= k + 1:
        return 1.0
    far = np.sqrt(np.maximum((pivots**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * (pivots @ pivots.T), 0))
    np.fill_diagonal(far, np.inf)
    near = np.partition(far, k - 1, axis=1)
    reach = near[:, k - 1] * (m / n) ** (1 / d)
    return float((far - near[:, :k].min(axis=1)[None, :] <= reach[:, None]).mean())


def _meet(key, table: pa.Table, most: int) -> pa.Table:
    """(gid, near, d2): the asking vectors' nearest among the others of a pair of blocks."""
    asks = table.column("q").combine_chunks().to_numpy(zero_copy_only=False)
    a, c = table.filter(pa.array(asks)), table.filter(pa.array(~asks)).sort_by("gid")
    x, y = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1)) for t in (a, c))
    r, at, d = nearest_rows(x, y, most)
    return pa.table({"gid": a.column("gid").to_numpy()[r], "near": c.column("gid").to_numpy()[at], "d2": d})


def _pairs(asking: DataFrame, asked: DataFrame, by: list[str], k: int) -> DataFrame:
    def meet(key, table):
        return _meet(key, table, k + 1)

    return asking.unionByName(asked).groupBy(*by).applyInArrow(meet, "gid long, near long, d2 double")


def _by_blocks(groups: DataFrame, n: int, d: int, k: int) -> tuple[DataFrame, list]:
    """Every vector's k + 1 nearest of each block of targets. A task holds one block of each kind; the vectors are sent once
    for each block of queries, and a query has k + 1 rows for each block of targets."""
    size = n * (8 * d + 16)
    n_t = -(-size // MET_BYTES)
    n_q = max(-(-size // ASK_BYTES), min(-(-n // 2048), 2 * groups.sparkSession.sparkContext.defaultParallelism))
    qb, tb = F.pmod(F.xxhash64("gid"), F.lit(n_q)).cast("int"), F.pmod(F.xxhash64("gid", F.lit(1)), F.lit(n_t)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asking = groups.select("gid", "v", qb.alias("qb"), all_of(n_t).alias("tb"), F.lit(True).alias("q"))
    asked = groups.select("gid", "v", all_of(n_q).alias("qb"), tb.alias("tb"), F.lit(False).alias("q"))
    counts = sorted((r["qb"], r["n"]) for r in groups.groupBy(qb.alias("qb")).agg(F.count("*").alias("n")).collect())  # a row a block
    return _pairs(asking, asked, ["qb", "tb"], k), [(c, int(own), n, int(n_t), int(own) * n) for c, own in counts]


def _by_cells(groups: DataFrame, chosen: np.ndarray, k: int, block: int) -> tuple[DataFrame, list]:
    m = len(chosen)
    celled = with_nearest(groups.select("gid", "v", F.size("ids").alias("held")), "v", chosen, "cell", "_d").withColumn("r", F.sqrt("_d"))
    celled = materialize(celled.drop("_d"), "cells")
    lo, hi, queries, radius = _bounds(celled, chosen, k)
    gone = celled.sparkSession.sparkContext.broadcast((lo, hi))

    def reach(batches):
        lo, hi = gone.value
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                own = b.slice(start, 1024)
                r, cell = own.column("r").to_numpy(), own.column("cell").to_numpy()
                at, to = np.nonzero((r[:, None] >= lo[:, cell].T) & (r[:, None] <= hi[:, cell].T))
                for j in range(0, len(at), 1 << 14):  # a batch of vectors may meet every cell
                    p, c = pa.array(at[j : j + (1 << 14)]), to[j : j + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), own.column("gid").take(p), own.column("v").take(p)], names=["cell", "gid", "v"])

    targets = celled.select("gid", "v", "cell", "r").mapInArrow(reach, "cell int, gid long, v array<double>")
    targets = materialize(targets, "targets")
    met = {r["cell"]: r["n"] for r in targets.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    parts = lambda counts: F.array(*[F.lit(max(1, -(-int(counts.get(c, 0)) // block))) for c in range(m)])
    n_q, n_t = parts(queries), parts(met)
    part = lambda count: F.pmod(F.xxhash64("gid"), F.get(count, F.col("cell"))).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.get(count, F.col("cell")) - 1))
    asking = celled.select("cell", "gid", "v", part(n_q).alias("qb"), all_of(n_t).alias("tb"), F.lit(True).alias("q"))
    asked = targets.select("cell", "gid", "v", all_of(n_q).alias("qb"), part(n_t).alias("tb"), F.lit(False).alias("q"))
    found = _pairs(asking, asked, ["cell", "qb", "tb"], k)
    return found, [(c, int(queries.get(c, 0)), int(met.get(c, 0)), int(((radius >= lo[c]) & (hi[c] >= 0)).sum()), int(queries.get(c, 0)) * int(met.get(c, 0))) for c in range(m)]


def _bounds(celled: DataFrame, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, dict, np.ndarray]:
    """lo, hi [asking cell, target's cell]: the radii with which a target can be a neighbour of a point there."""
    m = len(pivots)
    sizes = {r["cell"]: (r["n"], r["u"]) for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("u")).collect()}
    near = _smallest(celled.select("cell", "gid", "r", "held"), "cell", ["r", "gid"], k + 1, "gid").select("cell", "r", "held").collect()  # k + 1 rows a cell
    between = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
    radius = np.array([sizes.get(c, (0, 0.0))[1] for c in range(m)])
    at, r, held = (np.array([x[f] for x in near]) for f in ("cell", "r", "held"))
    lo, hi = np.full((m, m), np.inf), np.full((m, m), -np.inf)
    for i in range(m):
        if i not in sizes:
            continue
        far = radius[i] + between[i][at] + r  # no point of cell i is farther from these
        order = np.argsort(far, kind="stable")
        enough = np.searchsorted(np.cumsum(held[order]), k + 1)
        theta = far[order[min(enough, len(order) - 1)]] if held.sum() > k else np.inf
        theta = theta * (1 + 1e-9) + 1e-12
        lo[i], hi[i] = between[i] - radius[i] - theta, between[i] + radius[i] + theta
    return lo, hi, {c: s[0] for c, s in sizes.items()}, radius
