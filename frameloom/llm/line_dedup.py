"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches, the largest ids first. The index is a few sorted runs that no two share a key between: each
batch merge-anti-joins the runs, and the keys that none of them holds become the batch's own run, with the document that
has the line to keep. When a level has as many runs as may stand on it, they are compacted into one run of the next level.
All lines but the kept ones are candidates; those whose key enough documents share are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, bucketed, bucketed_by_id, discard, join_by_share, map_arrow, materialize, slices

BLANK = b" \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
DOC = ["real", "doc"]


def line_keys(text: str, least: int) -> list[bytes | None]:
    """For each line of text the 16-byte hash of its key; None for keys of fewer than least code points.

    A key is the line without ASCII white space at its ends, A-Z lower-cased.
    """
    out: list[bytes | None] = []
    for line in text.encode().lower().split(b"\n"):
        key = line.strip(BLANK)
        long = len(key) >= least and (key.isascii() or len(key.decode()) >= least)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return out


class LineRuns:
    """An index of line hashes: levels of disjoint runs (h1, h2, real, doc), each sorted by the hashes and dealt over buckets by
    them, so that a batch is merged with a run without moving the run."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (h1, h2, real, doc); its own run, the keys that are new with their largest document, is returned."""
        fresh = lines.groupBy(*KEY).agg(F.max(F.struct(*DOC)).alias("d")).select(*KEY, "d.*")
        for run in self.runs():
            fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        own = bucketed(fresh, "line_run", KEY, self.buckets)
        self._put(own, 0)
        return own

    def _put(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = bucketed(self._union(self.levels[level]), "line_run", KEY, self.buckets)
            self.levels[level] = []
            self._put(merged, level + 1)

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def all(self) -> DataFrame:
        return self._union(self.runs())


def read_lines(docs: DataFrame, id_col: str, text_col: str, least: int, batches: int) -> DataFrame:
    """(batch, h1, h2, real, doc): the distinct keys of each row. Batch 0 has the largest ids.

    A document is the rows of one id; rows without id are documents by their text, smaller than all others (real false).
    """
    schema = pa.schema([("batch", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("real", pa.bool_()), ("doc", pa.int64())])

    def run(found):
        for b in slices(found, "text"):
            keys = [dict.fromkeys(k for k in line_keys(t or "", least) if k) for t in b.column("text").to_pylist()]
            counts = np.array([len(k) for k in keys])
            h = np.frombuffer(b"".join([x for k in keys for x in k]), "<i8").reshape(-1, 2)
            each = [np.repeat(b.column(c).to_numpy(zero_copy_only=False), counts) for c in ("batch", "real", "doc")]
            yield batch_of(schema, each[0].astype(np.int32), h[:, 0], h[:, 1], each[1].astype(bool), each[2].astype(np.int64))

    rows = bucketed_by_id(_documents(docs, id_col, text_col), "id", batches, "bucket")
    rows = rows.select((F.lit(batches - 1) - F.col("bucket")).alias("batch"), *DOC, "text")
    return map_arrow(rows, run, "batch int, h1 long, h2 long, real boolean, doc long")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.select("id", F.col("id").isNotNull().alias("real"), F.coalesce("id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("doc"), "text")


def dropped_keys(lines: DataFrame, kept: DataFrame, documents: int) -> DataFrame:
    """(real, doc, h1) of the lines to drop. lines: (h1, h2, real, doc); kept: one of them for each key.

    A key's documents are the kept one and those of its other lines; all but the kept lines are compared with the keys that
    at least `documents` have. The anti-join is by key and document, so that no common line meets in one task.
    """
    others = lines.join(kept.hint("merge"), [*KEY, *DOC], "left_anti").select(*KEY, *DOC).distinct()
    others = materialize(others, "line_candidates")
    common = others.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= documents - 1)
    return join_by_share(others, materialize(common, "line_common"), KEY, "n").select(*DOC, "h1")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, documents: int = 5, batches: int = 6, fanout: int = 3) -> DataFrame:
    """(id_col, text_col, n_lines, n_dropped) for each row: texts without the lines that at least `documents` documents have.

    Keys of at least `least` code points count; the document with the largest id keeps its lines of a key, all of them.
    Edge cases: null and empty texts are one empty line; the rows of one id are one document, and each loses the lines that
    the document loses; rows without id are documents by their text, which come after all others in keeping a line; other
    columns are ignored; an empty table gives an empty result. Texts move once, to meet the lines that their document loses;
    a document's list of those is as long as its own lines.
    """
    spark = docs.sparkSession
    lines = materialize(read_lines(docs, id_col, text_col, least, batches), "lines")
    index = LineRuns(spark, fanout=fanout)
    for k in range(batches):
        index.add(lines.where(F.col("batch") == k))
    drops = dropped_keys(lines, index.all(), documents)
    discard(lines)
    drops = drops.groupBy(*DOC).agg(F.collect_list("h1").alias("drops"))
    rows = _documents(docs, id_col, text_col).join(drops.hint("shuffle_hash"), DOC, "left").select("id", "text", "drops")
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def run(found):
        for b in slices(found, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [t.count("\n") + 1 for t in texts]
            lost = [0] * len(texts)
            for k, gone in enumerate(b.column("drops").to_pylist()):
                if gone:
                    gone, keys = set(gone), line_keys(texts[k], least)
                    stay = [key is None or int.from_bytes(key[:8], "little", signed=True) not in gone for key in keys]
                    texts[k] = "\n".join([line for line, s in zip(texts[k].split("\n"), stay, strict=True) if s])
                    lost[k] = stay.count(False)
            yield batch_of(schema, b.column("id"), texts, n, lost)

    return map_arrow(rows, run, "id long, text string, n_lines long, n_dropped long").withColumnsRenamed({"id": id_col, "text": text_col})
