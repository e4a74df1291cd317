"""Weighted ensembles: recycling, slots, and weight-conserving resampling inside bins."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import in_box
from ..scratch import ship


def endpoints(frames: DataFrame, columns: list[str], walker: str = "walker", order: str = "frame", even: bool = False) -> DataFrame:
    """Each walker's last frame. even: walkers of unequal numbers of frames are an error, raised by the plan itself."""
    last = frames.groupBy(walker).agg(F.max_by(F.struct(order, *columns), order).alias("e"), F.count("*").alias("_n"))
    if even:
        text = F.concat(F.lit("walkers have from "), F.min("_n").cast("string"), F.lit(" to "), F.max("_n").cast("string"), F.lit(" frames"))
        check = last.agg(F.when(F.coalesce(F.min("_n") == F.max("_n"), F.lit(True)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")).alias("_ok"))
        last = last.crossJoin(F.broadcast(check)).where("_ok")  # one row
    return last.select(walker, "e.*")


def survivors(weights: DataFrame, alive: DataFrame, walker: str = "walker", least: float = 0.0) -> DataFrame:
    """Weights of the walkers that are left, summing to 1 again, uniform if nothing is left of the weights. None left, or
    under the share `least` of them, is an error: three numbers reach the driver."""
    left = weights.join(alive.select(walker).distinct(), walker, "left_semi")
    n, total = left.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    if not n or n < least * weights.count():
        raise RuntimeError(f"only {n} walkers are left")
    return left.withColumn("weight", F.col("weight") / F.lit(float(total)) if total > 0 else F.lit(1.0 / n))


def conserved(weights: DataFrame, weight: str = "weight", tolerance: float = 1e-9) -> DataFrame:
    """weights unchanged; a sum that isn't 1 is an error, raised by the plan itself."""
    total = weights.agg(F.sum(weight).alias("_t"))
    text = F.concat(F.lit("weights sum to "), F.col("_t").cast("string"))
    ok = total.select(F.when(F.abs(F.col("_t") - 1) <= F.lit(tolerance), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")).alias("_ok"))
    return weights.crossJoin(F.broadcast(ok)).where("_ok").drop("_ok")


def recycle(walkers: DataFrame, columns: list[str], box: list[tuple[float, float]], basis: list[float]) -> DataFrame:
    """Mark walkers inside the box and put them back at the basis point; parents of those become -1."""
    hit = walkers.withColumn("recycled", in_box(columns, box))
    for c, b in zip(columns, basis, strict=True):
        hit = hit.withColumn(c, F.when(F.col("recycled"), F.lit(float(b))).otherwise(F.col(c)))
    return hit


def slots(walkers: DataFrame, cell: str, budget: int) -> DataFrame:
    """(cell, population, slots): the budget dealt round-robin over the bins in ascending population, every bin one at
    least; more bins than budget is an error."""
    pop = walkers.groupBy(cell).agg(F.count("*").alias("population"))
    ranked = pop.withColumn("rank", F.row_number().over(W.orderBy("population", cell))).crossJoin(F.broadcast(pop.agg(F.count("*").alias("bins"))))
    checked = F.when(F.col("bins") <= budget, F.floor(F.lit(budget) / F.col("bins")) + (F.col("rank") <= budget % F.col("bins")).cast("int")).otherwise(F.raise_error(F.lit("more occupied bins than walkers")))
    return ranked.select(cell, "population", checked.cast("long").alias("slots"))


Member = tuple[float, int, int]  # weight, order of birth, walker


def fewer(members: list[Member], target: int, rng: np.random.Generator, born: int) -> list[Member]:
    """Merge the two lightest until target are left; one of the two lives on, in proportion to its weight. Sums of the
    lightest never get lighter, so they queue behind one another and beside the sorted members: linear after the sort."""
    old, new = deque(sorted(members)), deque()
    lightest = lambda: (new if not old or new and new[0] < old[0] else old).popleft()
    while len(old) + len(new) > max(target, 1):
        a, b = lightest(), lightest()
        total = a[0] + b[0]
        kept = a if rng.random() < (a[0] / total if total > 0 else 0.5) else b
        new.append((total, born, kept[2]))
        born += 1
    return [*old, *new]


def more(members: list[Member], target: int, born: int) -> list[Member]:
    """Halve the heaviest, the eldest of equals, until there are target."""
    heap = [(-w, k, i) for w, k, i in members]
    heapq.heapify(heap)
    while heap and len(heap) < target:
        w, _, i = heap[0]
        heapq.heapreplace(heap, (w / 2, born, i))
        heapq.heappush(heap, (w / 2, born + 1, i))
        born += 2
    return [(-w, k, i) for w, k, i in heap]


def resample_bin(ids, weights, target: int, rng: np.random.Generator, equalise: bool = False) -> list[tuple[int, float]]:
    """(parent, weight) of target walkers, see fewer and more. With equalise, a merge and a split go on in turn until the
    heaviest has at most 4 times the lightest's weight."""
    found = [(float(w), k, i) for k, (i, w) in enumerate(zip(ids, weights, strict=True))]
    later = lambda: max((k for _, k, _ in found), default=-1) + 1
    found = fewer(found, target, rng, later())
    found = more(found, target, later())
    for _ in range(200 if equalise and len(found) > 1 else 0):
        if max(found)[0] <= 4 * min(found)[0]:
            break
        found = fewer(found, len(found) - 1, rng, later())
        found = more(found, len(found) + 1, later())
    return [(i, w) for w, _, i in sorted(found, key=lambda m: m[1])]


def resample(walkers: DataFrame, cell: str, target: DataFrame | int, seed: int = 0, walker: str = "walker", equalise: bool = True) -> DataFrame:
    """(cell, parent_walker, weight): each bin resampled to its slots; a bin's weight is conserved."""
    import pandas as pd

    ship(walkers.sparkSession)
    if isinstance(target, int):
        df = walkers.select(cell, walker, "weight").withColumn("slots", F.lit(target).cast("long"))
    else:
        df = walkers.select(cell, walker, "weight").join(target.select(cell, "slots"), cell)

    def one(key, pdf):
        pdf = pdf.sort_values(walker)
        found = resample_bin(pdf[walker].tolist(), pdf.weight.tolist(), int(pdf.slots.iloc[0]), np.random.default_rng([seed, int(key[0])]), equalise)
        return pd.DataFrame({cell: [key[0]] * len(found), "parent_walker": [f[0] for f in found], "weight": [f[1] for f in found]})

    return df.groupBy(cell).applyInPandas(one, f"{cell} long, parent_walker long, weight double")


def effective_size(weights: DataFrame, weight: str = "weight") -> DataFrame:
    return weights.agg((F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))).alias("ess"))
