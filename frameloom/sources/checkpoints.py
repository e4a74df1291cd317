"""A run's stored state as Parquet: history in deltas, the manifest that completes a checkpoint, log, models and outcome.

Layout below a root folder that all executors share: history/ckpt=N/try=T holds the entries of the iterations after the
last complete checkpoint up to N; state/ckpt=N/try=T one row of the sampler's state; manifest/ckpt=N/try=T, one file that is
written last, the deltas that N rests on with the rows and the checksum of each. A checkpoint without its manifest doesn't
exist. A save never writes over anything: it has a try of its own, the newest manifest of a checkpoint holds, and what no
manifest names any more is removed once the new one stands. So whatever step a crash comes between, what was there before
can be read. One driver writes.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import remove

VERSION = 2
DELTAS = "array<struct<ckpt:bigint,try:bigint,rows:bigint,checksum:string>>"
LOG = ("iteration", "runner_s", "analysis_s", "total_s", "successful_walkers", "failed_walkers", "frames_this_iteration", "cumulative_frames", "occupied_bins", "total_bins", "exploration_fraction", "spawn_indices", "cvs_file", "trajectory_dir", "checkpoint_dir")


class BrokenChain(RuntimeError):
    """A checkpoint rests on deltas that are gone or can't be read."""


class Checkpoints:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, part: str) -> bool:
        return self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}"))

    def manifest(self) -> DataFrame:
        """(ckpt, try, version, chain) of the complete checkpoints, the newest try of each; chain has the deltas."""
        schema = f"version int, chain {DELTAS}, ckpt long, try long"
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/manifest").parquet(f"{self.root}/manifest")
        newest = rows.groupBy("ckpt").agg(F.max_by(F.struct("version", "chain", "try"), "try").alias("m"))
        return newest.select("ckpt", "m.try", "m.version", "m.chain")

    def complete(self) -> list[int]:
        return sorted(r["ckpt"] for r in self.manifest().select("ckpt").distinct().collect())  # a number a checkpoint

    def latest(self) -> int:
        done = self.complete()
        if not done:
            raise FileNotFoundError(f"no complete checkpoint in {self.root}")
        return done[-1]

    def save(self, iteration: int, history: DataFrame, state: dict | None = None) -> None:
        """Store the rows of history (a column iteration, others as they are) since the last checkpoint, then state, then
        the manifest; a repeated save replaces the checkpoint, and later checkpoints go on resting on what it replaces."""
        known = {r["ckpt"]: r for r in self.manifest().collect()}  # a row a checkpoint
        before = max((c for c in known if c < iteration), default=None)
        attempt = max((r["try"] for r in known.values()), default=-1) + 1
        delta = history.where((F.col("iteration") <= iteration) & (F.col("iteration") > (before if before is not None else -(1 << 40))))
        where = f"ckpt={iteration}/try={attempt}"
        delta.write.mode("overwrite").parquet(f"{self.root}/history/{where}")  # of a try that no manifest names, at most
        self.spark.createDataFrame([(json.dumps(state or {}),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/state/{where}")
        rows, checksum = self._figures([(iteration, attempt)])[iteration]
        chain = [tuple(x) for x in known[before]["chain"]] if before is not None else []
        row = self.spark.createDataFrame([(VERSION, [*chain, (iteration, attempt, rows, checksum)])], f"version int, chain {DELTAS}")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{where}")
        if iteration in known:
            self._clean(iteration, known[iteration]["try"])

    def _figures(self, deltas: list[tuple[int, int]]) -> dict[int, tuple[int, str]]:
        """Rows and checksum of deltas as they stand in the files; those that can't be read are left out."""
        found = {}
        for c, attempt in deltas:
            try:
                part = self.spark.read.parquet(f"{self.root}/history/ckpt={c}/try={attempt}")
                plain = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in sorted(part.schema.fields, key=lambda f: f.name)]
                r = part.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*plain).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
                found[c] = r["n"], r["s"]
            except Exception:  # whatever the reader says of a missing or cut file
                continue
        return found

    def _clean(self, iteration: int, old: int) -> None:
        """Remove a replaced try's manifest and state, and its delta unless another checkpoint rests on it."""
        remove(self.spark, f"{self.root}/manifest/ckpt={iteration}/try={old}")
        remove(self.spark, f"{self.root}/state/ckpt={iteration}/try={old}")
        if not any((d["ckpt"], d["try"]) == (iteration, old) for r in self.manifest().collect() for d in r["chain"]):
            remove(self.spark, f"{self.root}/history/ckpt={iteration}/try={old}")

    def load(self, iteration: int | None = None, ignore_missing: bool = False) -> DataFrame:
        """The history up to a checkpoint (the latest), an iteration's rows from its newest delta. Deltas that are missing,
        unreadable, or not what was written, by rows and checksum, are an error, unless ignored, with a warning; a newer
        version only warns."""
        at = self.latest() if iteration is None else iteration
        row = self.manifest().where(F.col("ckpt") == at).first()
        if row is None:
            raise FileNotFoundError(f"no complete checkpoint {at} in {self.root}")
        if row["version"] > VERSION:
            warnings.warn(f"checkpoint {at} is of version {row['version']}, newer than {VERSION}", stacklevel=2)
        found = self._figures([(d["ckpt"], d["try"]) for d in row["chain"]])
        parts = []
        for d in row["chain"]:
            c = d["ckpt"]
            if found.get(c) == (d["rows"], d["checksum"]):
                part = self.spark.read.parquet(f"{self.root}/history/ckpt={c}/try={d['try']}")
                parts.append(part.withColumn("ckpt", F.lit(c).cast("long")))
                continue
            wrong = "can't be read" if c not in found else f"has {found[c][0]} rows of {d['rows']}" if found[c][0] != d["rows"] else "has other rows than were written"
            if not ignore_missing:
                raise BrokenChain(f"checkpoint {at} rests on delta {c}, which {wrong}")
            warnings.warn(f"delta {c} {wrong}; the history of checkpoint {at} is incomplete", stacklevel=2)
        if not parts:
            raise BrokenChain(f"none of the deltas of checkpoint {at} can be read")
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p, allowMissingColumns=True)
        newest = whole.groupBy("iteration").agg(F.max("ckpt").alias("ckpt"))
        return whole.join(newest, ["iteration", "ckpt"], "left_semi").drop("ckpt")

    def state(self, iteration: int | None = None) -> dict:
        at = self.latest() if iteration is None else iteration
        row = self.manifest().where(F.col("ckpt") == at).first()
        if row is None:
            raise FileNotFoundError(f"no complete checkpoint {at} in {self.root}")
        return json.loads(self.spark.read.parquet(f"{self.root}/state/ckpt={at}/try={row['try']}").first()["state"])

    def flux_history(self) -> list[float]:
        """The newest readable checkpoint's fluxes that aren't empty, else none."""
        for c in reversed(self.complete()):
            try:
                if found := self.state(c).get("flux_history"):
                    return found
            except Exception:  # an unreadable state is passed over
                continue
        return []


def frozen_basis(state: dict, first: list[float]) -> list[float]:
    """The basis of the first call, whatever later calls bring; another number of dimensions is an error."""
    basis = state.setdefault("basis", None) or list(first)
    if len(basis) != len(first):
        raise ValueError(f"a basis of {len(basis)} coordinates, a point of {len(first)}")
    state["basis"] = basis
    return basis


def merged(deltas: DataFrame, chain: DataFrame, upto: int, ignore_missing: bool = False) -> DataFrame:
    """Newest entry of each iteration among delta rows (ckpt, iteration, entry). chain (ckpt, required) says what each
    checkpoint rests on: a required delta without rows is an error, raised by the plan itself."""
    d = deltas.where(F.col("ckpt") <= upto)
    out = d.groupBy("iteration").agg(F.max_by("entry", "ckpt").alias("entry"), F.max("ckpt").alias("ckpt"))
    if ignore_missing:
        return out
    gone = chain.where(F.col("ckpt") == upto).select("required").distinct().join(d.select(F.col("ckpt").alias("required")).distinct(), "required", "left_anti")
    text = F.concat(F.lit("the chain is broken: deltas "), F.array_join(F.array_sort(F.collect_list("required")), ", "), F.lit(" are missing"))
    check = gone.agg(F.when(F.count("*") > 0, F.raise_error(text)).otherwise(F.lit(True)).cast("boolean").alias("whole"))
    return out.crossJoin(F.broadcast(check)).where("whole").drop("whole")  # one row


def history_records(history: DataFrame, frames: str = "frames") -> DataFrame:
    """(iteration, position, and the fields of each frame) of entries that hold arrays of frames; without any, an error."""
    rows = history.select("iteration", F.posexplode(frames).alias("position", "frame")).select("iteration", "position", "frame.*")
    if rows.isEmpty():
        raise ValueError("the history holds no frame records")
    return rows


def usable_iterations(history: DataFrame, trajectories: DataFrame) -> DataFrame:
    """history without the iterations that have a missing or empty trajectory: (iteration, n_frames) rows of 0 or null."""
    bad = trajectories.where(F.coalesce("n_frames", F.lit(0)) <= 0).select("iteration").distinct()
    return history.join(bad, "iteration", "left_anti")


def reproject(history: DataFrame, project, version: int, features: str = "features") -> DataFrame:
    """history projected anew after training: project adds cv from the features; rows of iterations that lack features
    somewhere are dropped, and all get the new space_version."""
    lacking = history.where(F.col(features).isNull()).select("iteration").distinct()
    out = project(history.join(lacking, "iteration", "left_anti").drop("cv", "cv_dim"))
    return out.withColumn("cv_dim", F.size("cv")).withColumn("space_version", F.lit(version))


def append_log(rows: DataFrame, path: str, meta: dict | None = None) -> None:
    """Append rows of the run log as tab-separated lines, `NA` for null, in the order of LOG; meta's lines first, if given."""
    missing = [c for c in LOG if c not in rows.columns]
    if missing:
        raise ValueError(f"the log lacks {', '.join(missing)}")
    cells = [F.coalesce(F.col(c).cast("string") if rows.schema[c].dataType.typeName() != "array" else F.array_join(c, ","), F.lit("NA")) for c in LOG]
    lines = rows.orderBy("iteration").select(F.concat_ws("\t", *cells).alias("value"))
    if meta:
        head = rows.sparkSession.createDataFrame([(f"# {k}={v}",) for k, v in meta.items()], "value string")
        head.coalesce(1).write.mode("append").text(path)
    lines.coalesce(1).write.mode("append").text(path)  # an iteration's row at a time


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows, typed; `NA` is null."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("NOT startswith(value, '#') AND value <> ''")
    text = {"spawn_indices", "cvs_file", "trajectory_dir", "checkpoint_dir"}
    real = {"runner_s", "analysis_s", "total_s", "exploration_fraction"}
    cell = lambda k: F.nullif(F.get(parts, F.lit(k)), F.lit("NA"))
    return rows.select(*((cell(k) if c in text else cell(k).try_cast("double" if c in real else "long")).alias(c) for k, c in enumerate(LOG)))


def check_log(log: DataFrame) -> DataFrame:
    """One row: iterations, failed walkers in all, whether iterations are gapless, whether each row's cumulative frames are the
    sum of the frames up to it, and the first iteration where they aren't (null: none). A row an iteration: a small window."""
    own = log.withColumn("_sum", F.sum("frames_this_iteration").over(W.orderBy("iteration")))
    off = F.min(F.when(~F.col("cumulative_frames").eqNullSafe(F.col("_sum")), F.col("iteration")))
    return own.agg(F.count("*").alias("iterations"), F.coalesce(F.sum("failed_walkers"), F.lit(0)).alias("failed"), (F.max("iteration") - F.min("iteration") + 1 == F.countDistinct("iteration")).alias("gapless"), off.isNull().alias("adds_up"), off.alias("first_off"))


def write_outcome(spark: SparkSession, path: str, converged: bool, iterations: int, reason: str | None) -> None:
    spark.createDataFrame([(converged, iterations, reason)], "converged boolean, iterations long, reason string").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_models(series: DataFrame, root: str, order: str = "iteration") -> None:
    """Model rows (operators.msm.models), a partition for each iteration; an iteration's old rows are replaced."""
    series.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(order).parquet(f"{root.rstrip('/')}/msm")


def read_models(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/msm")
