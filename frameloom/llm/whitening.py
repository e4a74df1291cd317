"""Whitening of vectors by upper-triangle column aggregates.

One aggregation has a SQL expression for the sum of centred products of each pair of dimensions; its single row is the upper
triangle of the covariance, which LAPACK decomposes. Vectors are integers on a fixed grid, so that sums are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

FIELDS = "id long, n long, deviation long, whitened array<double>"


def grid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(id, x): floor(scale * entry) + shift for vectors without null or non-finite entries; others are left out."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("c"))
    fine = F.forall("c", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN is larger than any number
    return rows.where(F.col("c").isNotNull() & fine).select("id", F.transform("c", lambda v: F.floor(v * scale) + shift).alias("x"))


def triangle(columns: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]


def covariance(rows: DataFrame, columns: dict[str, str], means: list, n: int, most: int = 4096) -> np.ndarray:
    """Covariance, divisor n, of SQL expressions over rows, each centred before it is multiplied.

    All pairs are in one aggregation; beyond `most` pairs (90 columns) in several, each over all rows.
    """
    names = list(columns)
    # values are never null here; saying so makes the sums' code half as long
    centred = rows.select(*[F.coalesce(F.expr(columns[c]).cast("double") - F.lit(float(m)), F.lit(0.0)).alias(c) for c, m in zip(names, means, strict=True)])
    pairs = triangle(names)
    out = np.zeros((len(names), len(names)))
    for at in range(0, len(pairs), most):
        some = pairs[at : at + most]
        sums = centred.selectExpr(*[f"sum({names[i]} * {names[j]}) AS s{i}_{j}" for i, j in some]).first()
        for (i, j), s in zip(some, sums, strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, `most` of them; of each the largest entry is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return e, u * np.where(np.take_along_axis(u, np.abs(u).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) for each vector without null or non-finite entries.

    whitened and explained are arrays over the components, at most `components` or as many as dimensions; identity_error is
    the largest absolute entry of whitened's covariance minus the identity. deviation is exact: sums of squares that
    can pass 2^63 are counted in Python's integers, and one that does is null. Edge cases: all vectors have the length that
    most have (of ties, the longer); those of others are left out as if their entries were null; null and repeated ids are
    rows like others; a component without variance has whitened null, and identity_error is over the others (null when
    there are none); explained is null when nothing varies; other columns are ignored; an empty table, or one of empty
    vectors, gives an empty result. Besides one row of sums, the driver gets dimensions * (dimensions + 1) / 2 numbers.
    """
    spark = df.sparkSession
    rows = grid_vectors(df, id_col, vec_col, scale, shift)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    fields = f"{FIELDS}, explained array<double>, identity_error double"
    if sizes is None or not sizes["d"]:
        return spark.createDataFrame([], fields).withColumnRenamed("id", id_col)
    d, n = sizes["d"], sizes["count"]
    rows = rows.where(F.size("x") == d)
    at = {f"x{i}": f"x[{i}]" for i in range(d)}
    sums = rows.selectExpr(*[f"sum({x}) AS s{i}" for i, x in enumerate(at.values())], *[f"min({x})" for x in at.values()], *[f"max({x})" for x in at.values()]).first()
    s, lo, hi = (sums[k * d : (k + 1) * d] for k in range(3))
    cov = covariance(rows, at, [x / n for x in s], n)
    e, u = principal(cov, min(components, d))
    trace = float(np.trace(cov))
    live = e > trace * d * np.finfo(float).eps
    axes = u / np.sqrt(np.where(live, e, 1.0))
    reach = max(max(abs(n * a - t), abs(n * b - t)) for a, b, t in zip(lo, hi, s, strict=True))
    narrow = d * reach * reach < 1 << 63
    wide = not narrow and reach >= 1 << 63
    total, schema = np.array(s, object if wide else np.int64), pa.schema([("id", pa.int64()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            far = (x.astype(object) if wide else x) * n - total  # n times the distance from the mean, exact
            if narrow:
                deviation = pa.array((far * far).sum(axis=1))
            else:
                exact = (far.astype(object) ** 2).sum(axis=1).tolist()
                deviation = pa.array([q if q < 1 << 63 else None for q in exact], pa.int64())
            w = (far / n).astype(np.float64) @ axes
            mask = np.broadcast_to(~live, w.shape).reshape(-1)
            cells = pa.array(np.ascontiguousarray(w).reshape(-1), mask=mask)
            parts = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), cells)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([n] * len(x), pa.int64()), deviation, parts], schema=schema)

    out = materialize(map_arrow(rows, run, FIELDS), "whitened")
    each = {f"w{k}": f"whitened[{k}]" for k in np.flatnonzero(live).tolist()}
    error = None
    if each:
        means = out.selectExpr(*[f"avg({x})" for x in each.values()]).first()
        error = float(np.abs(covariance(out, each, list(means), n) - np.eye(len(each))).max())
    share = [float(x) / trace if trace > 0 else None for x in e]
    out = out.withColumn("explained", F.array(*[F.lit(x).cast("double") for x in share])).withColumn("identity_error", F.lit(error).cast("double"))
    return out.withColumnRenamed("id", id_col)


def by_component(rows: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row for each vector and component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return rows.select(id_col, "n", "deviation", "identity_error", pairs).selectExpr(id_col, "CAST(at + 1 AS INT) AS component", "n", "deviation", "c.whitened AS whitened", "c.explained AS explained", "identity_error")
