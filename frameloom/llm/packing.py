"""Bounded-space online packing of tokenised documents into windows of fixed capacity.

Each task keeps a fixed number of open windows, places a document's pieces best-fit, emits the fullest window when none
fits, and leaves its open windows at the end; their pieces are merged afterwards in groups of bounded size.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, slices, token_cache

FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
WINDOW = f"sequence_id long, used long, open boolean, pieces array<struct<{','.join(f + ':bigint' for f in FIELDS)}>>, ids binary"
_PIECE = pa.struct([(f, pa.int64()) for f in FIELDS])
_WINDOW = pa.schema([("sequence_id", pa.int64()), ("used", pa.int64()), ("open", pa.bool_()), ("pieces", pa.list_(_PIECE)), ("ids", pa.binary())])


class OnlinePacker:
    """Windows as (free, number, pieces), ordered by free space; at most n_open at a time."""

    def __init__(self, capacity: int = 2048, n_open: int = 64, least_cut: int = 64):
        self.capacity, self.n_open, self.least_cut = capacity, n_open, least_cut
        self.windows: list[tuple[int, int, list]] = []
        self.made = 0

    def _put(self, free: int, number: int, pieces: list) -> Iterator[tuple[int, list]]:
        if free:
            bisect.insort(self.windows, (free, number, pieces), key=lambda w: w[:2])
        else:
            yield 0, pieces

    def add(self, item, length: int, cut) -> Iterator[tuple[int, list]]:
        """Place an item; cut(item, start, length) makes a piece. Yields (free, pieces) of windows that close.

        When no window fits and all are open, the fullest closes: filled with the item's head if its gap is worth a
        cut (least_cut), as it is otherwise.
        """
        start = 0
        while start < length:
            rest = length - start
            if rest >= self.capacity:
                yield 0, [cut(item, start, self.capacity)]
                start += self.capacity
                continue
            at = bisect.bisect_left(self.windows, rest, key=lambda w: w[0])
            if at < len(self.windows):
                free, number, pieces = self.windows.pop(at)
                pieces.append(cut(item, start, rest))
                yield from self._put(free - rest, number, pieces)
                return
            if len(self.windows) >= self.n_open:
                free, _, pieces = self.windows.pop(0)
                if free >= self.least_cut:
                    pieces.append(cut(item, start, free))
                    start, free = start + free, 0
                yield free, pieces
                continue
            self.made += 1
            yield from self._put(self.capacity - rest, self.made, [cut(item, start, rest)])
            return

    def leftovers(self) -> list[tuple[int, list]]:
        return [(free, pieces) for free, _, pieces in self.windows]


def _rows(found: list[tuple[int, int, bool, list[tuple]]]) -> pa.RecordBatch:
    """Windows as (sequence_id, used, open, pieces), a piece as its FIELDS and its ids."""
    own = [f[3] for f in found]
    flat = [p for pieces in own for p in pieces]
    structs = pa.StructArray.from_arrays([pa.array([p[k] for p in flat], pa.int64()) for k in range(len(FIELDS))], fields=list(_PIECE))
    ends = pa.array([0, *itertools.accumulate(map(len, own))], pa.int32())
    columns = [pa.array([f[k] for f in found], _WINDOW.field(k).type) for k in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, structs), pa.array([b"".join([p[5] for p in pieces]) for pieces in own], pa.binary())], schema=_WINDOW)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, n_open: int = 64, slice_bytes: int = 8 << 20, max_runs: int = 1_000_000) -> DataFrame:
    """(sequence_id, used, pieces, ids): one row for each sequence, its pieces in order and all its ids (uint32).

    A document is its ids and end_id. Sequence ids are unique, not dense. No text or token is shuffled but those of each
    task's open windows, n_open at most, for the merge. slice_bytes of text are encoded at a time, and max_runs runs stay
    known to a worker: both trade memory for time, neither changes a result. Edge cases: a null text is empty, so it is
    the end id alone; null and repeated ids are packed row by row; texts of any length are cut at the capacity; an empty
    table gives no rows; other columns are ignored.
    """

    def cut(doc, start, length):
        i, ids, n = doc
        own = ids[4 * start : 4 * (start + length)]
        return i, start, length, zlib.crc32(own), n, own

    def run(batches):
        packer, cache, end = OnlinePacker(capacity, n_open), token_cache(vocabulary, max_runs), end_id.to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 33
        for b in slices(batches, "text", slice_bytes):
            out = []
            for i, ids in zip(b.column("id").to_pylist(), cache.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids += end
                for free, pieces in packer.add((i, ids, len(ids) // 4), len(ids) // 4, cut):
                    out.append((number, capacity - free, False, pieces))
                    number += 1
            for k in range(0, len(out), 1000):
                yield _rows(out[k : k + 1000])
        if packer.windows:
            yield _rows([(number + k, capacity - free, True, pieces) for k, (free, pieces) in enumerate(packer.leftovers())])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    windows = materialize(map_arrow(rows, run, WINDOW, keep=vocabulary), "windows")
    return windows.where("NOT open").drop("open").unionByName(merge_leftovers(windows.where("open"), capacity).drop("open"))


def merge_leftovers(windows: DataFrame, capacity: int, group: int = 2048) -> DataFrame:
    """Pack the pieces of open windows anew, best-fit by descending length, in groups of about `group` windows."""
    n = windows.count()
    parts = max(1, -(-n // group))

    def run(batches):
        pieces = []  # of about `group` windows
        for b in batches:
            for own, ids in zip(b.column("pieces").to_pylist(), b.column("ids").to_pylist(), strict=True):
                at = 0
                for p in own:
                    pieces.append((*p.values(), ids[at : at + 4 * p["length"]]))
                    at += 4 * p["length"]
        pieces.sort(key=lambda p: (-p[2], p[0] or 0, p[1]))
        packer = OnlinePacker(capacity, max(1, len(pieces)))
        out = [(0, x) for p in pieces for _, x in packer.add(p, p[2], lambda p, *_: p)] + packer.leftovers()
        first = 1 << 62 | TaskContext.get().partitionId() << 33
        for k in range(0, len(out), 500):
            yield _rows([(first + k + j, capacity - free, False, own) for j, (free, own) in enumerate(out[k : k + 500])])

    return map_arrow(windows.repartition(parts, F.pmod(F.xxhash64("sequence_id"), F.lit(parts))), run, WINDOW)


def padded(windows: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, used, ids): ids filled up to the capacity with pad_id, unless their number is a power of two."""
    fill = F.expr(f"unhex(repeat('{pad_id.to_bytes(4, 'little').hex()}', CAST({capacity} - used AS INT)))")
    whole = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return windows.select("sequence_id", "used", F.when(whole, F.col("ids")).otherwise(F.concat("ids", fill)).alias("ids"))


def placements(windows: DataFrame) -> DataFrame:
    """One row for each piece: where it stands in its document and in its sequence; the ids aren't read. No windows, no
    rows; the pieces of repeated or null ids are told apart by their sequences alone."""
    p = windows.select("sequence_id", F.posexplode("pieces").alias("k", "p"), "pieces")
    offset = F.expr("aggregate(slice(pieces, 1, k), CAST(0 AS BIGINT), (s, x) -> s + x.length)")
    return p.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", offset.alias("offset"))
