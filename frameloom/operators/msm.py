"""Markov models as data flow: counts are sums of frames, a model is a small matrix for each group, its figures are rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import join_states
from ..scratch import ship
from . import spectral
from .posterior import bayesian_errors

SERIES = "timescales array<double>, vamp2 double, populations array<double>, errors array<double>, states array<long>, pi array<double>, counts array<double>, slow array<array<double>>"


def models(counts: DataFrame, by: str, lag: int | str, n_timescales: int = 2, n_metastable: int = 0, bayesian: int = 0, guard: int = 4000) -> DataFrame:
    """One row for each group of counts (by, i, j, c), states being numbers: see SERIES. lag: a number, or the column of it.

    A group is one small matrix (guard states at most), and groups are independent tasks. states are the active ones, in
    order; populations are those of n_metastable sets, or of the states without or if there are no more of them. Groups whose largest connected set has
    under two states have nulls.
    """
    import pandas as pd

    ship(counts.sparkSession)
    kind = counts.schema[by].dataType.simpleString()

    def one(key, pdf):
        names = np.unique(np.concatenate([pdf.i, pdf.j]))
        if len(names) > guard:
            raise ValueError(f"{len(names)} states don't fit a dense matrix here")
        c = np.zeros((len(names), len(names)))
        np.add.at(c, (np.searchsorted(names, pdf.i), np.searchsorted(names, pdf.j)), pdf.c)
        step = int(key[0]) if lag == by else int(lag)
        try:
            m = spectral.markov_model(c, step, n_timescales)
        except RuntimeError:
            return pd.DataFrame([{by: key[0], "timescales": None, "vamp2": None, "populations": None, "errors": None, "states": None, "pi": None, "counts": None, "slow": None}])
        sets = spectral.pcca(m["matrix"], n_metastable) if 1 < n_metastable < len(m["pi"]) else np.arange(len(m["pi"]))
        errors = bayesian_errors(m["counts"], step, bayesian, n_timescales).tolist() if bayesian else None
        return pd.DataFrame([{by: key[0], "timescales": m["timescales"].tolist(), "vamp2": m["vamp2"], "populations": np.bincount(sets, m["pi"]).tolist(), "errors": errors, "states": names[m["states"]].tolist(), "pi": m["pi"].tolist(), "counts": m["counts"].sum(axis=1).tolist(), "slow": m["eigenvectors"].T.tolist()}])

    return counts.select(by, "i", "j", "c").groupBy(by).applyInPandas(one, f"{by} {kind}, {SERIES}")


def padded(series: DataFrame, column: str = "timescales") -> DataFrame:
    """Timescales filled up with nulls to the largest number there is, so that they make a table; no data, as they are."""
    most = series.agg(F.coalesce(F.max(F.size(column)), F.lit(0)).alias("_most"))
    filled = F.transform(F.sequence(F.lit(1), F.greatest("_most", F.lit(1))), lambda k: F.when(~F.isnan(F.get(column, k - 1)), F.get(column, k - 1)))
    return series.crossJoin(F.broadcast(most)).withColumn(column, F.when(F.col("_most") > 0, filled)).drop("_most")


def latest(series: DataFrame, order: str = "iteration") -> DataFrame:
    """The row of the newest iteration that has a model."""
    rows = series.where("timescales IS NOT NULL")
    return rows.agg(F.max_by(F.struct(*rows.columns), order).alias("m")).where("m IS NOT NULL").select("m.*")


def implied_timescales(counts: DataFrame, n_timescales: int = 2) -> DataFrame:
    """(lag, process, timescale) of multi-lag counts (lag, i, j, c): one model a lag; a lag without a model is left out."""
    return models(counts, "lag", "lag", n_timescales).where("timescales IS NOT NULL").select("lag", F.posexplode("timescales").alias("process", "timescale")).withColumn("timescale", F.when(~F.isnan("timescale"), F.col("timescale")))


def state_rows(series: DataFrame) -> DataFrame:
    """(state, pi, count) of one model's active states, with all its other columns."""
    z = F.explode(F.arrays_zip(F.col("states").alias("state"), F.col("pi").alias("p"), F.col("counts").alias("c"))).alias("z")
    return series.select("*", z).select(*[c for c in series.columns if c not in ("pi", "counts")], F.col("z.state").alias("state"), F.col("z.p").alias("pi"), F.col("z.c").alias("count"))


def frame_weights(frames: DataFrame, state: str, model: DataFrame) -> DataFrame:
    """frames with active (the state's number in the model, -1 if it isn't in it) and weight pi / frames of the state, 0
    for states that aren't in it. model: one row of models."""
    active = model.select(F.posexplode(F.arrays_zip(F.col("states").alias("s"), F.col("pi").alias("p"))).alias("active", "z")).select("active", F.col("z.s").alias(state), F.col("z.p").alias("_pi"))
    sizes = frames.groupBy(state).agg(F.count("*").alias("_n"))
    own = sizes.join(active, state, "left").select(state, "_n", F.coalesce("active", F.lit(-1)).alias("active"), F.coalesce(F.col("_pi") / F.col("_n"), F.lit(0.0)).alias("weight"))
    return join_states(frames, own, state, "_n")


def guided_weights(frames: DataFrame, state: str, model: DataFrame, matrix: DataFrame, leverage: int = 1, alpha: float = 1.0) -> DataFrame:
    """frames with a weight: pi * leverage * sigma / mean sigma + alpha / sqrt(count + 1) of its state, over the state's
    frames; states the model doesn't know get alpha. matrix: rows (i, j, p, n) of the active states; model: one row."""
    sums = matrix.groupBy(F.col("i").alias(state)).agg(F.sqrt(F.sum(F.col("p") * (1 - F.col("p"))) / (F.first("n") + 1)).alias("sigma"))
    mean = sums.agg(F.avg(F.when(F.col("sigma") > 0, F.col("sigma"))).alias("mean"))
    sums = sums.crossJoin(F.broadcast(mean)).select(state, (F.col("sigma") / F.coalesce("mean", F.lit(1.0))).alias("sigma"))
    zipped = F.arrays_zip(F.col("states").alias("s"), F.col("pi").alias("p"), F.col("counts").alias("c"))
    rows = model.select("slow", F.posexplode(zipped).alias("k", "z"))
    lever = F.aggregate(F.slice("slow", 1, leverage), F.lit(0.0), lambda s, v: s + F.abs(F.get(v, F.col("k")))) if leverage else F.lit(1.0)
    known = rows.select(F.col("z.s").alias(state), "z.p", "z.c", lever.alias("lever")).join(sums, state)
    known = known.select(state, (F.col("p") * F.col("lever") * F.col("sigma") + alpha / F.sqrt(F.col("c") + 1)).alias("_score"))
    sizes = frames.groupBy(state).agg(F.count("*").alias("_n")).join(known, state, "left")
    return join_states(frames, sizes.select(state, "_n", (F.coalesce("_score", F.lit(float(alpha))) / F.col("_n")).alias("weight")), state, "_n")
