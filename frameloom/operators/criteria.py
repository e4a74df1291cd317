"""Convergence criteria over a table with a row for each iteration, their combination, and when models are retrained.

Each criterion adds value, satisfied and reason. Rows that have nothing to compare with are not satisfied, with a reason:
no data, or the first of its kind, which becomes the baseline. A row without data leaves the baseline as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NO_BASE = "baseline established"


def _before(x: Column, order: str) -> Column:
    """The last value there was before a row; a row for each iteration, so one task's window is small."""
    return F.last(x, ignorenulls=True).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1))


def _change(c: Column, p: Column) -> Column:
    return F.abs(c - p) / F.greatest(F.abs(p), F.abs(c), F.lit(1e-12))


def _judged(df: DataFrame, value: Column, tolerance: float, has: Column, none: str, baseline: Column) -> DataFrame:
    reason = F.when(~has, F.lit(none)).when(baseline, F.lit(NO_BASE))
    df = df.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), value))
    return df.withColumn("satisfied", F.coalesce(F.col("value") < F.lit(float(tolerance)), F.lit(False))).drop("_now", "_was")


def _paired(df: DataFrame, now: Column, order: str, value, tolerance: float, none: str) -> DataFrame:
    """Criterion on arrays: another size than before is a new baseline."""
    df = df.withColumn("_now", F.when(F.size(now) > 0, now)).withColumn("_was", _before(F.col("_now"), order))
    return _judged(df, value, tolerance, F.col("_now").isNotNull(), none, F.col("_was").isNull() | (F.size("_was") != F.size("_now")))


def timescales(series: DataFrame, column: str = "timescales", k: int = 2, tolerance: float = 0.1, order: str = "iteration") -> DataFrame:
    """The largest relative change of the k slowest finite timescales."""
    finite = F.filter(F.coalesce(F.col(column), F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    value = F.array_max(F.zip_with("_now", "_was", _change))
    return _paired(series, F.slice(finite, 1, k), order, value, tolerance, "no finite timescales")


def populations(series: DataFrame, column: str = "populations", tolerance: float = 0.05, order: str = "iteration") -> DataFrame:
    """L1 drift of the descending populations, so that naming the states anew changes nothing."""
    value = F.aggregate(F.zip_with("_now", "_was", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return _paired(series, F.sort_array(F.coalesce(F.col(column), F.array().cast("array<double>")), asc=False), order, value, tolerance, "no metastable populations")


def score(series: DataFrame, column: str = "vamp2", tolerance: float = 0.05, order: str = "iteration") -> DataFrame:
    """Relative change of a score against the last one there was."""
    df = series.withColumn("_now", F.col(column)).withColumn("_was", _before(F.col(column), order))
    return _judged(df, _change(F.col("_now"), F.col("_was")), tolerance, F.col("_now").isNotNull(), "no VAMP-2 score", F.col("_was").isNull())


def statistical_error(series: DataFrame, errors: str = "errors", column: str = "timescales", tolerance: float = 0.1) -> DataFrame:
    """The slowest timescale's error over its size; nothing is compared with other rows."""
    e, t = F.get(errors, F.lit(0)), F.get(column, F.lit(0))
    has = F.coalesce(e.isNotNull() & ~F.isnan(t) & (t != 0), F.lit(False))
    return _judged(series, F.when(has, e / F.abs(t)), tolerance, has, "no Bayesian errors", F.lit(False))


def transition_error(uncertainty: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """One row from sequence.matrix_uncertainty's: the largest sigma / p among the used fluxes, 0 without any."""
    worst = F.coalesce(F.max(F.when(F.col("used"), F.col("sigma") / F.col("p"))), F.lit(0.0))
    return uncertainty.agg(worst.alias("value")).withColumn("satisfied", F.col("value") < F.lit(float(tolerance)))


def monitor(statuses: DataFrame, flags: list[str], mode: str = "all", patience: int = 2, order: str = "iteration") -> DataFrame:
    """Add streak, of rows at which all or any flags hold, and converged, which stays once the streak reaches patience."""
    if not flags or mode not in ("all", "any"):
        raise ValueError("a monitor takes flags, and all or any as its mode")
    both = F.lit(mode == "all")
    for f in flags:
        both = both & F.col(f) if mode == "all" else both | F.col(f)
    return latched(run_length(statuses, both, order), patience, order)


def run_length(df: DataFrame, holds: Column, order: str = "iteration", name: str = "streak") -> DataFrame:
    """How many rows in a row, up to each one, hold."""
    w = W.orderBy(order)
    df = df.withColumn("_holds", F.coalesce(holds, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_holds"), 0).otherwise(1)).over(w))
    inside = W.partitionBy("_run").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.col("_holds").cast("long")).over(inside)).drop("_holds", "_run")


def latched(df: DataFrame, patience: int, order: str = "iteration", name: str = "streak") -> DataFrame:
    top = F.max(name).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("converged", F.lit(patience > 0) & (top >= patience))


def no_growth(occupancy: DataFrame, patience: int, occupied: str = "occupied", at_top: str = "at_top", order: str = "iteration") -> DataFrame:
    """Add streak and converged: rows in a row without growth, counted only while the resolution is at its largest."""
    grown = F.col(occupied) > F.lag(occupied).over(W.orderBy(order))
    return latched(run_length(occupancy, F.col(at_top) & ~F.coalesce(grown, F.lit(True)), order), patience, order)


def retrained_every(iterations: DataFrame, freq: int, has_model: str | None = None, order: str = "iteration") -> DataFrame:
    """Add trained: at every freq-th iteration (0: never), and wherever there is no model."""
    on = F.col(order) % freq == 0 if freq > 0 else F.lit(False)
    return iterations.withColumn("trained", on | ~F.col(has_model) if has_model else on)


def retrained_on_decline(series: DataFrame, tolerance: float = 0.1, least: int = 1, most: int | None = None, score: str = "score", trained_score: str = "trained_score", order: str = "iteration") -> DataFrame:
    """Add trained, waited and best: a model is trained where its score has fallen by more than tolerance of the best score
    after a training so far, once at least `least` iterations have gone by since the last one, and after `most` anyway.

    series has a row for each iteration: the score of the model in use, and what a model trained there scores. The first
    iteration has no model and trains. One row's decision rests on the one before, so the rows, a few numbers for each
    iteration, are folded as one sorted array.
    """
    one = F.struct(F.col(order).alias("at"), F.col(score).cast("double").alias("s"), F.col(trained_score).cast("double").alias("new"))
    none = F.lit(None).cast("double")
    log = F.array().cast("array<struct<at:bigint,trained:boolean,waited:bigint,best:double>>")
    start = F.struct(F.lit(None).cast("long").alias("waited"), none.alias("best"), log.alias("log"))

    def step(state, row):
        fallen = F.coalesce(state["best"] - row["s"] > F.greatest(F.abs(state["best"]), F.lit(1e-9)) * tolerance, F.lit(False))
        late = F.lit(False) if most is None else state["waited"] >= most
        train = state["waited"].isNull() | (state["waited"] >= least) & (fallen | late)
        waited = F.when(train, F.lit(0).cast("long")).otherwise(state["waited"] + 1)
        best = F.when(train, F.greatest(state["best"], row["new"])).otherwise(state["best"])  # greatest passes nulls over
        entry = F.struct(row["at"].cast("long").alias("at"), train.alias("trained"), waited.alias("waited"), best.alias("best"))
        return F.struct(waited.alias("waited"), best.alias("best"), F.concat(state["log"], F.array(entry)).alias("log"))

    folded = series.agg(F.aggregate(F.array_sort(F.collect_list(one)), start, step, lambda s: s["log"]).alias("log"))
    rows = folded.select(F.explode("log").alias("e")).select(F.col("e.at").alias(order), "e.trained", "e.waited", "e.best")
    return series.join(rows, order)


def keep_features(iterations: list[int], frames_each: int, max_frames: int = 50_000, seed: int = 0) -> list[int]:
    """Iterations whose features stay: the first, the latest quarter, and of the middle as many as fit, picked by a hash
    and in order; at least 5 in all. The list has an entry for each iteration."""
    import hashlib

    n = max(5, max_frames // max(1, frames_each))
    done = sorted(iterations)
    if len(done) <= n:
        return done
    late = max(1, (n - 1) // 4)
    middle = done[1:-late]
    picked = sorted(middle, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).digest())[: n - 1 - late]
    return [done[0], *sorted(picked), *done[-late:]]
