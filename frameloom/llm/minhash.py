"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on whole shingle sets.

Two small collections of band hashes A_1..A_m and B_1..B_m are computed (2 * m * r minima); the m * m tables are keyed
by all pairs (A_i, B_j), so the minima needed are about the square root of what that many tables of 2r rows would take.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, connected_components, map_arrow, materialize, mix64, slices

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = mix64(np.arange(1, 1 << 12, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _random(n: int) -> np.ndarray:
    global _RANDOM
    if len(_RANDOM) < n:
        _RANDOM = mix64(np.arange(1, 2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _RANDOM


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words (runs without ASCII white space) in a uint8 array."""
    word = ~SPACE[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = ends - starts
    # positions inside each word, without those of white space
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inside = np.arange(total) - np.repeat(first, lengths)
    chars = raw[word].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(chars * _random(int(lengths.max()) + 1)[inside], first)
    return starts, mix64(sums + lengths.astype(np.uint64))


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z lower-cased.

    Texts with fewer words than size have the whole sequence as one shingle; null, empty and blank texts have none.
    """
    coded = [(t or "").encode().lower() for t in texts]
    raw = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    offsets = np.cumsum([0] + [len(c) + 1 for c in coded])
    starts, words = word_hashes(raw)
    bounds = np.searchsorted(starts, offsets)
    n = len(words)
    m = max(0, n - size + 1)
    rolled = np.zeros(m, np.uint64)
    for k in range(size):
        rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : m + k])
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(rolled[lo : hi - size + 1]))
        elif hi > lo:
            acc = np.full(1, hi - lo, np.uint64)
            for k in range(lo, hi):
                acc = mix64(acc * np.uint64(0xD1342543DE82EF95) + words[k : k + 1])
            out.append(acc)
        else:
            out.append(np.empty(0, np.uint64))
    return out


@lru_cache(4)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return x[:n] | np.uint64(1), x[n:]


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The n minima of each non-empty set, as an array of (sets, n) uint64."""
    offsets = np.cumsum([0] + [len(s) for s in sets[:-1]])
    h = np.concatenate(sets)
    out = np.empty((len(sets), n), np.uint64)
    for k, (a, b) in enumerate(zip(*_family(n), strict=True)):
        out[:, k] = np.minimum.reduceat((h ^ b) * a, offsets)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, m: int, r: int) -> DataFrame:
    """One row for each document: id, hash of the text, n_shingles, digest of the set, low 32 bits of the minima (null
    when empty)."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text").to_pylist(), size)
            full = [k for k, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            digest: list = [None] * len(sets)
            if full:
                found = signatures([sets[k] for k in full], 2 * m * r).astype("<u4")
                for k, row in zip(full, found, strict=True):
                    sig[k], digest[k] = row.tobytes(), hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
            yield batch_of(schema, b.column("id"), b.column("th"), [len(s) for s in sets], digest, sig)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    return map_arrow(rows, run, "id long, th long, n_shingles long, digest binary, sig binary")


def _bands(reps: DataFrame, m: int, r: int) -> DataFrame:
    """(id, i, a, b): m rows for each document, a is the hash A_i, b holds B_1..B_m."""
    schema = pa.schema([("id", pa.int64()), ("i", pa.int32()), ("a", pa.int64()), ("b", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(batch.num_rows, 2 * m, r).astype(np.uint64)
            h = np.zeros(sig.shape[:2], np.uint64) + np.arange(2 * m, dtype=np.uint64)
            for k in range(r):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            b = np.repeat((h[:, m:] >> np.uint64(32)).astype(np.uint32).view(np.int32), m, axis=0)
            yield batch_of(schema, np.repeat(ids, m), np.tile(np.arange(m, dtype=np.int32), len(ids)), h[:, :m].reshape(-1).view(np.int64), pa.ListArray.from_arrays(np.arange(0, b.size + 1, m, dtype=np.int32), pa.array(b.reshape(-1))))

    return map_arrow(reps.select("id", "sig"), run, "id long, i int, a long, b array<int>")


def table_rows(reps: DataFrame, m: int, r: int) -> DataFrame:
    """(key, id, i, j, lead, n) for the keys of the m * m tables that at least two documents share.

    A_i that one document alone has can't lead to a shared key, so those are set aside before the pairs are formed.
    """
    rows = materialize(_bands(reps, m, r), "bands")
    common = rows.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    keys = rows.join(common, "a", "left_semi").select("id", "i", "a", F.posexplode("b").alias("j", "b")).select("id", "i", "j", F.xxhash64("a", "j", "b").alias("key"))
    keys = materialize(keys, "keys")
    shared = keys.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    return materialize(keys.join(shared, "key").select("key", "id", "i", "j", "lead", "n"), "tables")


def verify(edges: DataFrame, texts: DataFrame, size: int, percent: int, share: int = 1000) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar; texts has id, text. Where an id has several texts, any will do.

    An a with more than share edges is dealt to several tasks, each with its own copy of a's text.
    """

    def run(batches):
        kept: OrderedDict = OrderedDict()  # sets of the last few texts on side a, which come one after another
        for batch in slices(batches, "tb", 2 << 20):
            a, ta = batch.column("ha").to_pylist(), batch.column("ta")
            new = [k for k in range(len(a)) if a[k] not in kept and (not k or a[k] != a[k - 1])]
            sets = dict(zip([a[k] for k in new], shingle_sets([ta[k].as_py() for k in new], size), strict=True))
            b = shingle_sets(batch.column("tb").to_pylist(), size)
            ok = [similar(sets[x] if x in sets else kept[x], y, percent) for x, y in zip(a, b, strict=True)]
            kept.update(sets)
            while len(kept) > 64:
                kept.popitem(last=False)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # of the leads only those with many edges, 1 / share of all edges at most, come as a table of their own
    many = materialize(edges.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("parts")).where("parts > 1"), "leads")
    parts = F.coalesce("parts", F.lit(1))
    left = edges.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    own = texts.selectExpr("id AS a", "text AS ta").join(edges.select("a").distinct(), "a", "left_semi").join(many, "a", "left")
    own = own.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "ta", F.xxhash64("a", "ta").alias("ha"))
    joined = left.join(texts.selectExpr("id AS b", "text AS tb"), "b").join(own, ["a", "part"]).select("a", "b", "ha", "ta", "tb")
    return map_arrow(joined, run, "a long, b long").distinct()


def wide_sketch(texts: DataFrame, size: int, width: int) -> DataFrame:
    """(id, wide): the low bytes of `width` minima of each text's set."""
    schema = pa.schema([("id", pa.int64()), ("wide", pa.binary())])

    def run(batches):
        for b in slices(batches, "text"):
            found = signatures(shingle_sets(b.column("text").to_pylist(), size), width).astype(np.uint8)
            yield batch_of(schema, b.column("id"), [row.tobytes() for row in found])

    return map_arrow(texts.select("id", "text"), run, "id long, wide binary")


def _finer(wide: DataFrame) -> DataFrame:
    """(key, id) of the width / 8 tables whose keys are 8 minima of the wide sketch: a pair at similarity 0.75 shares none
    of 128 with probability 10^-6, one that merely shares a passage, at 0.3, shares one in 130."""
    schema = pa.schema([("id", pa.int64()), ("j", pa.int32()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column("wide").to_pylist()), "<i8").reshape(batch.num_rows, -1)
                n = keys.shape[1]
                yield batch_of(schema, np.repeat(batch.column("id").to_numpy(), n), np.tile(np.arange(n, dtype=np.int32), len(keys)), keys.reshape(-1))

    return map_arrow(wide, run, "id long, j int, b long").select(F.xxhash64("j", "b").alias("key"), "id")


def cross_pairs(rows: DataFrame, sigs: DataFrame, texts: DataFrame, m: int, r: int, size: int, percent: int, block: int = 512, width: int = 1024, split: int | None = None) -> DataFrame:
    """Pairs with a common key whose documents are still in different components, after the estimates' filters.

    rows: key, id, i, j, lead, comp. Pairs with the lead were verified before. Only keys with several components are
    left here, and only their documents get a wide sketch, which rules out nearly all pairs that merely share a passage.
    A pair comes from the first table that both are in alone. Keys with more than block rows are cut into blocks that
    meet pairwise: a task never holds more than two of them, and no pair is left out. Each row is copied rows / block
    times for that; from where this is more than the width / 8 finer tables of the wide sketches take (split rows), as
    a very common passage has, a key is first split by those, so that the work grows with its rows, not their square.
    """
    need = percent / 100
    least = lambda n: n * need - 4 * (n * need * (1 - need)) ** 0.5
    narrow, broad = least(2 * m * r), least(width)
    counts = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")]
    mixed = rows.groupBy("key").agg(*counts).where("lo <> hi AND rows > 2").select("key", "rows")
    left = materialize(rows.where("id <> lead").join(mixed, "key").drop("lead"), "mixed")
    wide = materialize(wide_sketch(texts.join(left.select("id").distinct(), "id", "left_semi"), size, width), "wide")
    split = split or block * (width // 8)
    common = left.where(F.col("rows") > split)
    fine = left.where("false").drop("rows")
    if not common.isEmpty():
        placed = common.groupBy("id").agg(F.min("comp").alias("comp"))
        finer = materialize(_finer(wide.join(placed.select("id"), "id", "left_semi")).distinct().join(placed, "id"), "finer")
        fine = finer.select("key", "id", F.lit(-1).alias("i"), F.lit(-1).alias("j"), "comp")
        again = fine.groupBy("key").agg(*counts).where("lo <> hi").select("key", "rows")
        fine = fine.join(again, "key")
        left = left.where(F.col("rows") <= split).unionByName(fine)
    left = left.withColumn("nb", F.ceil(F.col("rows") / block).cast("int"))
    left = left.withColumn("bl", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    left = left.join(sigs.select("id", "sig", "n_shingles"), "id").join(wide, "id")
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    left = left.select(F.xxhash64("key", F.least("bl", "other"), F.greatest("bl", "other")).alias("cell"), "i", "j", "id", "comp", "sig", "wide", "n_shingles")
    dealt = left.repartition("cell").sortWithinPartitions("cell", "id")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(i, j, ids, comp, n, sig, wide):
        halves = sig.reshape(len(ids), 2, m, r)
        for k in range(len(ids) - 1):
            hit = np.flatnonzero((comp[k + 1 :] != comp[k]) & (100 * np.minimum(n[k + 1 :], n[k]) >= percent * np.maximum(n[k + 1 :], n[k]))) + k + 1
            hit = hit[(sig[hit] == sig[k]).sum(axis=1) >= narrow]
            hit = hit[(wide[hit] == wide[k]).sum(axis=1) >= broad]
            if len(hit) and i >= 0:
                same = (halves[hit] == halves[k]).all(axis=3)
                hit = hit[(same[:, 0].argmax(axis=1) == i) & (same[:, 1].argmax(axis=1) == j) & same.any(axis=2).all(axis=1)]
            if len(hit):
                yield np.full(len(hit), ids[k]), ids[hit]

    def run(batches):
        held: list = []

        def close():
            arrays = [np.concatenate([h[x] for h in held]) for x in range(3, 8)]
            found = list(pairs(*held[0][1:3], *arrays))
            if found:
                yield batch_of(out, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, i, j, ids, comp, n = (batch.column(c).to_numpy() for c in ("cell", "i", "j", "id", "comp", "n_shingles"))
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            sig, wide = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(len(cell), -1) for c, kind in (("sig", "<u4"), ("wide", "u1")))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0][0] != cell[lo]:
                    yield from close()
                    held = []
                held.append((cell[lo], i[lo], j[lo], *(x[lo:hi] for x in (ids, comp, n, sig, wide))))
        if held:
            yield from close()

    return map_arrow(dealt, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, m: int = 9, r: int = 2) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct shingles of size words. Rows are
    linked when 100 * intersection >= percent * union, confirmed on the whole sets; component_id is the smallest id
    reachable, and kept marks that row. Edge cases: null, empty and blank texts have n_shingles 0 and are linked with
    nothing; a null id is its own, unlinked row with component_id null and kept true; rows that repeat one id are one
    document, which has the links of all its texts, and get its answer (but their own n_shingles); other columns of docs
    are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sk = materialize(sketch(docs, "id", "text", size, m, r), "sketch")
    live = sk.where("n_shingles > 0 AND id IS NOT NULL")
    # equal sets are linked; the smallest id stands for them. salts: which of 64 the rows of a set have, as bits
    salt = F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")
    held = F.bit_or(F.expr("shiftleft(1L, CAST(pmod(xxhash64(id), 64L) AS INT))")).alias("salts")
    reps = live.groupBy("digest").agg(F.min(F.struct("id", "th")).alias("f"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), held)
    reps = materialize(reps.select("digest", "f.id", "f.th", "sig", "n_shingles", "salts"), "reps")
    several = live.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id")
    same = live.join(several, "id", "left_semi").select(F.col("id").alias("b"), "digest").join(reps.selectExpr("digest", "id AS a"), "digest").where("a <> b").select("a", "b").distinct()
    same = materialize(same, "same")
    tables = table_rows(reps, m, r)
    stars = materialize(tables.where("id <> lead").selectExpr("lead AS a", "id AS b").distinct(), "stars")
    wanted = reps.join(tables.select("id").distinct(), "id", "left_semi").select("id", "th").distinct()
    texts = docs.withColumn("th", F.xxhash64("text")).join(wanted, ["id", "th"], "left_semi")
    texts = materialize(texts.groupBy("id", "th").agg(F.first("text").alias("text")).select("id", "text"), "texts")
    links = materialize(verify(stars, texts, size, percent).union(same), "links")
    comps = connected_components(links)
    # documents of one key that are in different components so far
    placed = tables.join(comps, tables.id == comps.node, "left").select("key", "id", "i", "j", "lead", F.coalesce("component", "id").alias("comp"))
    more = materialize(cross_pairs(placed, reps, texts, m, r, size, percent), "cross")
    found = materialize(verify(more, texts, size, percent), "links")
    if not found.isEmpty():
        comps = connected_components(links.union(found))
    named = reps.join(comps, reps.id == comps.node, "left").select("digest", F.coalesce("component", "id").alias("component"), "salts")
    # a set's rows are dealt over their salts: as many copies of its answer as there are such rows, 64 at most
    named = named.select("digest", "component", F.explode(F.expr("filter(sequence(0, 63), k -> (shiftright(salts, k) & 1L) = 1L)")).alias("salt"))
    out = sk.withColumn("salt", salt).join(named, ["digest", "salt"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
