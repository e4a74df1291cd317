"""A weighted ensemble as a table that batches of endpoints move on: weights, basis, seeds and flux are stored state.

Layout below a root that all executors share: slots/iteration=N the ensemble after batch N, log/iteration=N, written last,
the batch's figures and the frozen basis. A batch without its log row doesn't exist and is done again, with the same
result: draws are seeded by batch and cell. A batch that is given twice gives its stored rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import in_box, walker_seed
from . import ensemble

LOG = "walkers long, recycled long, flux double, bins long, basis array<double>, seed long, iteration long"


class EnsembleTable:
    def __init__(self, spark: SparkSession, root: str, columns: list[str], cells: Callable[[DataFrame], DataFrame], target: list[tuple[float, float]] | None = None, seed: int = 42, equalise: bool = True):
        """columns: the coordinates of endpoints; cells adds their bin as `cell`; target: the box that ends a walk."""
        self.spark, self.root, self.columns, self.cells = spark, root.rstrip("/"), columns, cells
        self.target, self.seed, self.equalise = target, seed, equalise
        self._done: dict[int, list[float]] | None = None

    def log(self) -> DataFrame:
        """(walkers, recycled, flux, bins, basis, seed, iteration): a row for each batch that is complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).option("basePath", f"{self.root}/log").parquet(f"{self.root}/log")

    def slots(self, iteration: int) -> DataFrame:
        """(slot, walker, parent, weight, cell, seed): whose endpoint each slot goes on from; parent is -1 where that walker
        was recycled, so that the slot starts anew at the basis."""
        return self.spark.read.parquet(f"{self.root}/slots/iteration={iteration}")

    def binned(self, iteration: int) -> DataFrame:
        """(walker, weight, recycled, cell): the batch's endpoints as they were resampled."""
        return self.spark.read.parquet(f"{self.root}/binned/iteration={iteration}")

    def step(self, iteration: int, ends: DataFrame, basis: list[float] | None = None, budget: int | None = None) -> DataFrame:
        """Move the ensemble on by a batch of endpoints (walker, columns), one for each live walker; returns slots().

        Walker number k, in order, is slot k of the batch before, which gives its weight; weights of slots without an
        endpoint are dealt to the others in proportion. The first batch starts from equal weights. Endpoints inside the
        target go back to the basis, which the first batch freezes (of later ones another is ignored), and are binned
        there; their weight is the batch's flux. The budget, as many slots as endpoints if none is given, is dealt over
        the occupied bins, the sparsest first, and each bin is resampled to its slots. The sum of weights isn't mended: if
        it isn't 1 afterwards, that is an error.
        """
        if self._done is None:
            self._done = {r["iteration"]: r["basis"] for r in self.log().collect()}  # a row a batch; one driver writes
        done = self._done
        if iteration in done:
            return self.slots(iteration)
        before = max(done, default=None)
        if before is not None and before > iteration:
            raise ValueError(f"batch {iteration} comes after batch {before}")
        basis = list(done[min(done)] or []) if done else list(basis or [])
        if self.target is not None and len(basis) != len(self.columns):
            raise ValueError(f"a basis of {len(basis)} coordinates for {len(self.columns)} columns")
        live = ends.select("walker", *(F.col(c).cast("double").alias(c) for c in self.columns)).withColumn("slot", F.row_number().over(W.orderBy("walker")) - 1)
        if before is None:
            weighed = live.withColumn("weight", 1 / F.count("*").over(W.partitionBy()))
        else:
            old = self.slots(before).select("slot", "weight")
            weighed = live.join(ensemble.survivors(old, live.select("slot"), "slot"), "slot")
        hit = in_box(self.columns, self.target) if self.target is not None else F.lit(False)
        back = weighed.withColumn("recycled", hit)
        for c, b in zip(self.columns, basis, strict=bool(basis)) if basis else ():
            back = back.withColumn(c, F.when(F.col("recycled"), F.lit(float(b))).otherwise(F.col(c)))
        binned = self.cells(back).select("walker", "weight", "recycled", F.col("cell").cast("long").alias("cell"))
        binned = self._kept(binned, iteration)
        f = binned.agg(F.count("*").alias("w"), F.sum(F.col("recycled").cast("long")).alias("r"), F.coalesce(F.sum(F.when(F.col("recycled"), F.col("weight"))), F.lit(0.0)).alias("f"), F.countDistinct("cell").alias("b")).first()
        n = budget or f["w"]
        drawn = ensemble.resample(binned, "cell", ensemble.slots(binned, "cell", n), self.seed + iteration, equalise=self.equalise)
        order = W.orderBy("cell", "parent_walker", "weight")
        rows = drawn.withColumn("slot", F.row_number().over(order) - 1).join(binned.select(F.col("walker").alias("parent_walker"), "recycled"), "parent_walker")
        parent = F.when(F.col("recycled"), F.lit(-1)).otherwise(F.col("parent_walker"))
        out = rows.select("slot", F.col("parent_walker").alias("walker"), parent.cast("long").alias("parent"), "weight", "cell", walker_seed(F.lit(self.seed), F.lit(iteration), "slot").alias("seed"))
        ensemble.conserved(out).write.mode("overwrite").parquet(f"{self.root}/slots/iteration={iteration}")
        row = [(f["w"], f["r"], f["f"], f["b"], [float(b) for b in basis], self.seed)]
        self.spark.createDataFrame(row, LOG.rpartition(",")[0]).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/iteration={iteration}")
        done[iteration] = [float(b) for b in basis]
        return self.slots(iteration)

    def _kept(self, df: DataFrame, iteration: int) -> DataFrame:
        path = f"{self.root}/binned/iteration={iteration}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
