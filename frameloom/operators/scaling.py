"""Scalers of whole feature vectors: each column by its own figures over all rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize, ship

KINDS = ("minmax", "standard", "robust")
BITS = 11  # of the 64 that a round of quantiles decides
FEW = 64  # entries of a rank that are fetched rather than counted on


def _keys(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; both zeros alike."""
    u = (x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(u & top, ~u, u | top)


def _values(keys: np.ndarray) -> np.ndarray:
    top = np.uint64(1 << 63)
    return np.where(keys & top, keys ^ top, ~keys).view(np.float64)


def exact_quantiles(df: DataFrame, vector: str, shares: list[float]) -> np.ndarray:
    """(column, share): the exact quantiles of each column of an array, between two values by their distance; null and NaN
    entries don't count, a column of nothing has NaN. Arrays may differ in length.

    Selection by rounds of histograms: a value's 64 bits, in an order like the values', are decided 11 at a time, and each
    round counts what follows the bits that are known, until no more than FEW entries share the bits of a rank; those are
    fetched. Tasks and driver hold 2048 counts for each column and rank, whatever the rows; seven passes over a written
    table at most, as few as three over little.
    """
    own = materialize(df.select(F.transform(vector, lambda v: F.nanvl(v.cast("double"), F.lit(None).cast("double"))).alias("v")).where("size(v) > 0"), "columns")
    d = own.agg(F.max(F.size("v"))).first()[0] or 0
    if not d:
        discard(own)
        return np.zeros((0, len(shares)))
    counts = _histograms(own, np.zeros((d, 1), np.uint64), 64, BITS)
    n = counts.sum(axis=(1, 2))
    ranks = np.array([[f(q * max(0, m - 1)) for q in shares for f in (math.floor, math.ceil)] for m in n], np.int64).reshape(d, -1)
    known, left, take = np.zeros(ranks.shape, np.uint64), 64, BITS
    while True:
        below = np.cumsum(counts, axis=2)
        at = (below <= ranks[:, :, None]).sum(axis=2).clip(0, (1 << take) - 1)
        before = np.take_along_axis(np.broadcast_to(below, (*ranks.shape, below.shape[2])), np.maximum(at - 1, 0)[:, :, None], 2)[:, :, 0]
        ranks = ranks - np.where(at > 0, before, 0)
        held = np.take_along_axis(np.broadcast_to(counts, (*ranks.shape, counts.shape[2])), at[:, :, None], 2)[:, :, 0]
        left -= take
        known |= at.astype(np.uint64) << np.uint64(left)
        if not left or held.max() <= FEW:
            break
        take = min(BITS, left)
        counts = _histograms(own, known, left, take)
    if left:
        known = _fetched(own, known, left, ranks)
    discard(own)
    found = np.where(n[:, None] > 0, _values(known), np.nan)
    low, high = found[:, ::2], found[:, 1::2]
    place = np.array([[q * max(0, m - 1) for q in shares] for m in n]).reshape(d, -1)
    return low + (high - low) * (place - np.floor(place))


def _matches(own: DataFrame, known: np.ndarray, left: int, use, schema: str) -> DataFrame:
    """What use(matches of each batch) makes at last: for each column and distinct known value, the keys that begin with it.
    use: a function without arguments that gives (take, done): take(column, group, keys) for every batch, done() at the end."""
    d = len(known)
    groups = [np.unique(known[k]) for k in range(d)]  # ranks mostly share what is known
    ship(own.sparkSession)

    def run(batches):
        take, done = use(groups)
        for b in batches:
            lengths = pc.list_value_length(b.column("v")).to_numpy()
            flat = b.column("v").flatten()
            column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            ok = flat.is_valid().to_numpy(zero_copy_only=False)
            keys, column = _keys(flat.to_numpy(zero_copy_only=False)[ok].astype(np.float64)), column[ok]
            order = np.argsort(column, kind="stable")
            keys, ends = keys[order], np.searchsorted(column[order], np.arange(d + 1))
            for k in range(d):
                mine = keys[ends[k] : ends[k + 1]]
                head = mine >> np.uint64(left) if left < 64 else np.zeros(len(mine), np.uint64)
                for g, value in enumerate(groups[k]):
                    take(k, g, mine[head == (value >> np.uint64(left) if left < 64 else np.uint64(0))])
        yield from done()

    return own.mapInArrow(run, schema)


def _histograms(own: DataFrame, known: np.ndarray, left: int, take: int) -> np.ndarray:
    """counts [column, rank, next bits] of the entries whose bits above `left` are the known ones."""
    d, ranks = known.shape
    size = 1 << take

    def use(groups):
        total = [np.zeros((len(g), size), np.int64) for g in groups]

        def add(k, g, keys):
            total[k][g] += np.bincount(((keys >> np.uint64(left - take)) & np.uint64(size - 1)).astype(np.int64), minlength=size)

        def done():
            for k, t in enumerate(total):
                g, at = np.nonzero(t)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(t[g, at])], names=["k", "g", "at", "n"])

        return add, done

    parts = _matches(own, known, left, use, "k int, g int, at int, n long").groupBy("k", "g", "at").agg(F.sum("n").alias("n")).toArrow()
    k, g, at, n = (parts.column(c).to_numpy() for c in ("k", "g", "at", "n"))
    out = np.zeros((d, ranks, size), np.int64)
    for c in range(d):
        own_groups, back = np.unique(known[c], return_inverse=True)
        per = np.zeros((len(own_groups), size), np.int64)
        mine = k == c
        per[g[mine], at[mine]] = n[mine]
        out[c] = per[back]
    return out


def _fetched(own: DataFrame, known: np.ndarray, left: int, ranks: np.ndarray) -> np.ndarray:
    """The key at each rank among those that begin with what is known: FEW for each at most."""

    def use(groups):
        held: list = []

        def keep(k, g, keys):
            if len(keys):
                held.append((np.full(len(keys), k, np.int32), np.full(len(keys), g, np.int32), keys.view(np.int64)))

        def done():
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["k", "g", "key"])

        return keep, done

    rows = _matches(own, known, left, use, "k int, g int, key long").toArrow()
    k, g, keys = (rows.column(c).to_numpy() for c in ("k", "g", "key"))
    out = known.copy()
    for c in range(len(known)):
        mine = k == c
        _, back = np.unique(known[c], return_inverse=True)
        for r, group in enumerate(back):
            found = np.sort(keys[mine][g[mine] == group].view(np.uint64))
            if len(found):
                out[c, r] = found[ranks[c, r]]
    return out


def scale_vectors(df: DataFrame, vector: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """df with a vector of the same shape for each kind: (v - min) / (max - min), (v - mean) / population deviation,
    (v - median) / (third - first quartile, exact; see exact_quantiles).

    A column without spread is divided by 1. Null vectors and values stay null. The figures, six numbers a column, are
    sums of the tasks' arrays: rows aren't taken apart.
    """
    if not kinds or set(kinds) - set(KINDS):
        raise ValueError(f"kinds are some of {KINDS}")
    figures: dict[str, list[tuple]] = {}
    if {"minmax", "standard"} & set(kinds):
        v = F.col("v")
        each = df.select(F.posexplode(vector).alias("k", "v")).groupBy("k").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
        rows = sorted(each.collect(), key=lambda r: r["k"])  # a row a column
        figures["minmax"] = [(r["lo"], r["hi"] - r["lo"]) if r["lo"] is not None else (None, None) for r in rows]
        figures["standard"] = [(r["mean"], r["sd"] if r["lo"] is not None and r["hi"] > r["lo"] else 0.0) for r in rows]
    if "robust" in kinds:
        q = exact_quantiles(df, vector, [0.25, 0.5, 0.75])
        figures["robust"] = [(float(m), float(c - a)) if m == m else (None, None) for a, m, c in q]
    number = lambda xs: F.array(*[F.lit(None if x is None else float(x)).cast("double") for x in xs]) if xs else F.array().cast("array<double>")

    def scaled(n):
        at, by = number([f[0] for f in figures[n]]), number([f[1] for f in figures[n]])

        def one(x, k):
            spread = F.get(by, k)
            return (x - F.get(at, k)) / F.when(spread > 0, spread).otherwise(F.lit(1.0))

        return F.transform(vector, one)

    return df.select(*df.columns, *(scaled(n).alias(n) for n in kinds))
