"""Sequence operators: lagged pairs, transition counts, streaks, convergence criteria, kinetics. A lag never crosses the
border of a segment, so the segment's columns are always given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lagged(df: DataFrame, columns: list[str], lag: int, segment: list[str], order: str = "frame") -> DataFrame:
    """Rows with their values lag steps later as `<column>_lag`; rows without are dropped."""
    w = W.partitionBy(*segment).orderBy(order)
    out = df.withColumn("_there", F.lead(order, lag).over(w))
    for c in columns:
        out = out.withColumn(f"{c}_lag", F.lead(c, lag).over(w))
    return out.where("_there IS NOT NULL").drop("_there")


def transition_counts(df: DataFrame, state: str, lags: list[int], segment: list[str], order: str = "frame") -> DataFrame:
    """(lag, i, j, c): sliding-window counts of all lags from one sort of the states."""
    w = W.partitionBy(*segment).orderBy(order)
    later = df.select(F.col(state).alias("i"), *(F.lead(state, lag).over(w).alias(f"_{lag}") for lag in lags))
    pairs = F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"_{lag}").alias("j")) for lag in lags])
    return later.select("i", F.explode(pairs).alias("p")).where("p.j IS NOT NULL").groupBy("p.lag", "i", "p.j").agg(F.count("*").alias("c"))


def segments(frames: DataFrame, segment: list[str], dimension: str | None = None) -> DataFrame:
    """frames of segments of two and more; of a column of dimensions, only those with the latest iteration's."""
    if dimension:
        newest = frames.agg(F.max_by(dimension, "iteration").alias("_dim"))
        frames = frames.crossJoin(F.broadcast(newest)).where(F.col(dimension) == F.col("_dim")).drop("_dim")
    return frames.withColumn("_n", F.count("*").over(W.partitionBy(*segment))).where("_n > 1").drop("_n")


def transition_matrix(counts: DataFrame, by: list[str] | None = None, states: DataFrame | None = None) -> DataFrame:
    """Add row sums `n` and row-normalised probabilities `p`. states (by, i): those that nothing leaves get a loop of
    probability 1, with c and n 0."""
    own = [*(by or []), "i"]
    out = counts.withColumn("n", F.sum("c").over(W.partitionBy(*own))).withColumn("p", F.col("c") / F.col("n"))
    if states is None:
        return out
    lacking = states.select(*own).distinct().join(counts.select(*own).distinct(), own, "left_anti")
    zero = F.lit(0).cast("long")
    return out.unionByName(lacking.withColumns({"j": F.col("i"), "c": zero, "n": zero, "p": F.lit(1.0)}).select(*out.columns))


def matrix_uncertainty(matrix: DataFrame, pi: DataFrame, least_flux: float = 1e-4) -> DataFrame:
    """(i, j, p, sigma, flux, used): Dirichlet deviation sqrt(p (1 - p) / (n + 1)); used marks fluxes above
    least_flux of the largest."""
    j = matrix.join(pi, "i").withColumn("flux", F.col("pi") * F.col("p")).withColumn("sigma", F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("n") + 1)))
    top = j.agg(F.max("flux").alias("top"))
    return j.crossJoin(F.broadcast(top)).select("i", "j", "p", "sigma", "flux", (F.col("flux") > F.col("top") * F.lit(least_flux)).alias("used"))


def stalled(df: DataFrame, value: str, patience: int, order: str = "iteration") -> DataFrame:
    """Add `stalled`: the last `patience` values are all equal."""
    w = W.orderBy(order).rowsBetween(-(patience - 1), 0)
    return df.withColumn("stalled", (F.count(value).over(w) == patience) & (F.min(value).over(w) == F.max(value).over(w)))


def mfpt(flux: DataFrame, tau_ps: float, discard: float = 0.2, order: str = "iteration", value: str = "flux") -> DataFrame:
    """One row of the Hill relation: after the leading int(n * discard) rows, tau / mean flux in ns; the plateau ratio is
    the second half's mean over the first's; events are counted over all rows; converged as 0.8 to 1.25 with 10 events."""
    rows = flux.withColumn("_k", F.row_number().over(W.orderBy(order)) - 1).crossJoin(F.broadcast(flux.agg(F.count("*").alias("_n"))))
    skip = F.floor(F.col("_n") * F.lit(discard))
    half = F.floor((F.col("_n") - skip) / 2)
    v = F.col(value)
    tail = F.col("_k") >= skip
    late = F.col("_k") >= skip + half
    out = rows.agg(F.count("*").alias("n_iterations"), F.sum((v > 0).cast("int")).alias("n_flux_events"), F.avg(F.when(tail, v)).alias("m"), F.avg(F.when(tail & ~late, v)).alias("a"), F.avg(F.when(late, v)).alias("b"), F.sum(tail.cast("int")).alias("t"))
    out = out.select(
        F.when(F.col("m") > 0, F.lit(float(tau_ps)) / F.col("m") / 1000).alias("mfpt_ns"), "n_iterations", F.coalesce("n_flux_events", F.lit(0)).alias("n_flux_events"),
        F.when(F.col("m") > 0, F.col("m")).otherwise(F.lit(0.0)).alias("tail_mean_flux"), F.when((F.col("a") > 0) & (F.col("t") >= 2), F.col("b") / F.col("a")).alias("plateau_ratio"),
    )
    return out.withColumn("converged", F.coalesce(F.col("plateau_ratio").between(0.8, 1.25), F.lit(False)) & (F.col("n_flux_events") >= 10))


def running_mfpt(flux: DataFrame, tau_ps: float, order: str = "iteration", value: str = "flux") -> DataFrame:
    mean = F.avg(value).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return flux.select(order, F.when(mean > 0, F.lit(float(tau_ps)) / mean / 1000).alias("mfpt_ns"))
