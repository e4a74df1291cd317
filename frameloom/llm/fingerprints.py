"""Document fingerprints from prefix polynomial hashes.

A prefix array G[i] = sum of c_j * B^j (j < i) modulo the prime 2^31 - 1, for two bases, answers the equality of any two
spans in constant time and finds longest common extensions by binary search. The fingerprint of a text samples it: the
whole text's hash, hashes of prefixes and suffixes at multiples of a power of two, and the smallest hashes of all its
windows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bucketed_by_id, map_arrow, mix64, slices

PRIME = (1 << 31) - 1
BASES = (1_237_940_039, 1_880_018_401)
BLOCK, MARKS, SKETCH, WINDOW = 1 << 18, 16, 32, 24
_P, _S = np.uint64(PRIME), np.uint64(31)


def _fold(x: np.ndarray) -> np.ndarray:
    """Reduce below 2^63 to at most a little over the prime."""
    return (x & _P) + (x >> _S)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= _P, x - _P, x)


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), PRIME))
        out = np.concatenate([out, _reduce(out * step)])
    return out[:n]


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(14, (n - 1).bit_length())
    return _powers(base, size), _powers(pow(base, -1, PRIME), size)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class PrefixHash:
    """Prefix arrays of one text; spans are given as start and length in code points."""

    def __init__(self, text: str):
        self.codes = codes(text)
        self.n = len(self.codes)
        self.g, self.inverse = [], []
        for base in BASES:
            power, inverse = _tables(base, self.n + 1)
            self.g.append(_reduce(np.concatenate([np.zeros(1, np.uint64), np.cumsum(_fold((self.codes.astype(np.uint64) + np.uint64(1)) * power[: self.n]))])))
            self.inverse.append(inverse)

    def span(self, start: int, length: int) -> tuple[int, int]:
        """A span's hash, the same wherever the span stands."""
        return tuple((int(g[start + length]) - int(g[start])) * int(v[start]) % PRIME for g, v in zip(self.g, self.inverse, strict=True))

    def equal(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        return self.span(start, length) == other.span(at, length)

    def common_extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common prefix of the suffixes from start and at, by binary search."""
        lo, hi = 0, min(self.n - start, other.n - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(start, other, at, mid) else (lo, mid - 1)
        return lo


def fingerprint(text: str | None) -> str:
    """Hex fields n:stride:whole:prefixes:suffixes:sketch. Null counts as the empty text. Reads blocks of bounded size."""
    c = codes(text or "")
    n = len(c)
    stride = 1
    while n > MARKS * stride:
        stride *= 2
    marks = np.arange(1, n // stride + 1) * stride
    want = np.concatenate([marks, n - marks])  # ends of prefixes, starts of suffixes
    total, at_marks = [0, 0], [np.zeros(len(want), np.uint64), np.zeros(len(want), np.uint64)]
    least = np.empty(0, np.uint64)
    for start in range(0, n, BLOCK):
        block = c[start : start + BLOCK + WINDOW - 1].astype(np.uint64) + np.uint64(1)
        own = min(BLOCK, n - start)
        inside = np.flatnonzero((want > start) & (want <= start + own))
        for k, base in enumerate(BASES):
            power, inverse = _tables(base, len(block) + 1)
            g = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_fold(block * power[: len(block)]))])
            shift = pow(base, start, PRIME)
            at_marks[k][inside] = [(total[k] + int(g[w - start]) * shift) % PRIME for w in want[inside].tolist()]
            total[k] = (total[k] + int(g[own]) % PRIME * shift) % PRIME
            if not k:
                w = min(WINDOW, n)
                m = min(own, len(block) - w + 1)
                if m > 0:
                    span = _reduce(_reduce(g[w : w + m] - g[:m]) * inverse[:m])
                    found = np.unique((mix64(span) >> np.uint64(32)).astype(np.uint32))[:SKETCH]
                    least = np.unique(np.concatenate([least, found.astype(np.uint64)]))[:SKETCH]
    half = len(marks)
    prefixes, suffixes = [], []
    inverses = [pow(b, -1, PRIME) for b in BASES]
    for i in range(half):
        prefixes.append((int(at_marks[0][i]) << 31 | int(at_marks[1][i])) * 0x9E3779B97F4A7C15 >> 20 & 0xFFFFFFFF)
        s = n - int(marks[i])
        a, b = ((total[k] - int(at_marks[k][half + i])) * pow(inverses[k], s, PRIME) % PRIME for k in (0, 1))
        suffixes.append((a << 31 | b) * 0x9E3779B97F4A7C15 >> 20 & 0xFFFFFFFF)
    mark = lambda xs: "".join(f"{x:08x}" for x in xs)
    return f"{n:x}:{stride:x}:{total[0] << 31 | total[1]:016x}:{mark(prefixes)}:{mark(suffixes)}:{mark(least.tolist())}"


def _common(a: str, b: str, sa: int, sb: int) -> int:
    """The longest stretch whose hashes both sides sampled and share, by binary search over the common marks."""
    s = max(sa, sb)
    at = lambda x, step, k: x[8 * (k * s // step - 1) : 8 * (k * s // step)]
    lo, hi = 0, min(len(a) // 8 * sa, len(b) // 8 * sb) // s
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if at(a, sa, mid) == at(b, sb, mid) else (lo, mid - 1)
    return lo * s


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints alone: 1 for equal ones; else the larger of the share that common prefix and suffix
    cover and the windows' estimated Jaccard similarity, always under 1."""
    if a == b:
        return 1.0
    na, sa, wa, pa_, xa, ka = a.split(":")
    nb, sb, wb, pb, xb, kb = b.split(":")
    n = max(int(na, 16), int(nb, 16))
    if not min(int(na, 16), int(nb, 16)):
        return 0.0
    sa, sb = int(sa, 16), int(sb, 16)
    cover = (_common(pa_, pb, sa, sb) + _common(xa, xb, sa, sb)) / n
    u = {ka[i : i + 8] for i in range(0, len(ka), 8)}
    v = {kb[i : i + 8] for i in range(0, len(kb), 8)}
    both = set(sorted(u | v)[:SKETCH])
    return min(max(cover, len(u & v & both) / max(1, len(both))), 1 - 1 / (2 * n))


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as many (or all) code points from the start of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprint each text, its edited text, and compare with the next document's, in descending order of id.

    Texts move once, to buckets of consecutive ids that are read as a stream; the first row of each bucket also goes to
    the bucket before it, and the largest id's to the last. Edge cases: a null text is empty; null ids stand after all
    others, tied ids are ordered by text; a single row is its own next; an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed_by_id(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", n, "bucket")
    top = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("id").alias("top")).collect()}  # one row a bucket
    order = sorted(top)
    goes = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}
    size = max(order, default=0) + 1
    tops = F.array(*[F.lit(top.get(b)).cast("long") for b in range(size)])
    to = F.array(*[F.lit(goes.get(b, 0)) for b in range(size)])
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("copy"))
    also = F.struct(F.get(to, F.col("bucket")).alias("b"), F.lit(True).alias("copy"))
    dealt = rows.withColumn("to", F.explode(F.when(F.get(tops, F.col("bucket")).eqNullSafe(F.col("id")), F.array(own, also)).otherwise(F.array(own))))
    dealt = dealt.select(F.col("to.b").alias("bucket"), F.col("to.copy").alias("copy"), "id", "text").repartition("bucket")
    dealt = dealt.sortWithinPartitions("bucket", "copy", F.col("id").desc_nulls_last(), "text")
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        last = None  # bucket, id, text, fingerprint of a row that waits for the next one
        for batch in slices(batches, "text"):
            out: list = []
            for bucket, copy, i, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "id", "text")), strict=True):
                if copy and (last is None or last[0] != bucket):
                    continue  # a second copy with the same id
                print_ = fingerprint(text)
                if last is not None:
                    new = edited(last[2], text)
                    e = last[3] if new == last[2] else fingerprint(new)
                    out.append((last[1], len(last[2]), hashlib.sha256(new.encode()).hexdigest(), last[3], e, likeness(last[3], e), likeness(last[3], print_)))
                last = None if copy else (bucket, i, text, print_)
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return map_arrow(dealt, run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
