"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Four predictions are mixed for each id. Orders 2 and 1 name the id that last followed the same two ids, or the same one,
in the block. Order 0 gives each id of the block a share by how lately it was seen (interval coding after Elias, 1987).
The rest is spread evenly over the alphabet. The shares adapt: those of orders 1 and 2 to how often in a row the context
guessed right, order 0's to how often it was right in the block. Where orders 2 and 1 name the same id, it has both their
shares. All of it starts anew in every block, so that a block
needs nothing but the alphabet's size. A
range coder with 64-bit state and 32-bit output codes each id in the share of the highest order that predicts it. All
blocks of a file advance one id at a time together, as numpy arrays with a lane for each block, in integer arithmetic.

File: magic, u32 length and crc32 of the header, then the header (zlib): alphabet size, document ids and lengths; then
the blocks, each as u32 ids, u32 words, u32 crc32 of its ids, and its 32-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_of, bucketed_by_id, map_arrow, scratch_path, slices, token_cache

MAGIC = b"FLCM4\n"
BLOCK, SLOTS = 1024, 1 << 10
BITS, TOP = 12, 20  # shares are parts of 2^12, alphabets at most 2^20: together they fit the range, 2^32 at least
#: Order 0's share moves a sixteenth of the way to HIT or MISS; every part of the mixture keeps at least one of 2^12.
RATE, HIT, MISS = 4, 3840, 300
#: What orders 1 and 2 get of what is left, by how often in a row the guess was right at its place.
_SHARES = np.array([[32, 600, 1800, 2500, 2900, 3200, 3400, 3500], [32, 1500, 2700, 3200, 3500, 3650, 3750, 3840]])
#: Where, in 2^12, order 2's share ends and order 1's after it, by 8 times order 2's level and order 1's.
_END2 = np.repeat(_SHARES[1], 8).astype(np.int32)
_END1 = (_END2 + ((1 << BITS) - _END2) * np.tile(_SHARES[0], 8) // (1 << BITS)).astype(np.int32)
_U, _I = np.uint64, np.uint32
_SLOT = _I(33 - SLOTS.bit_length())  # a hash's upper bits name its slot
_LOW, _HALF, _BITS = _U(1 << 32), _U(32), _U(BITS)
#: Order 0: weight of the id seen d steps ago, and sums of the weights up to d.
_SEEN = np.concatenate([[0], (1 << 14) // (np.arange(1, BLOCK + 1) + 4)])
_SUMS = np.cumsum(_SEEN)
_STEPS = np.repeat(np.arange(BLOCK + 1), _SEEN)  # how long ago, by a number below the last of the sums


class _Model:
    """Orders 2 and 1 and the shares of all lanes; both coders drive it in the same way. Ids are counted from 1 here.

    An entry of the tables is an id and a confidence (1 to 7), 0 is none. With wide=1, each entry of order 1 has a
    neighbour for the coder's own use: the place of an id is where the next step looks for what follows it.
    """

    def __init__(self, lanes: int, wide: int = 0):
        self.lane, self.wide = np.arange(lanes), wide
        self.base = self.lane * SLOTS
        self.first, self.second = np.zeros(lanes * SLOTS << wide, np.int32), np.zeros(lanes * SLOTS, np.int32)
        self.seen = np.full(lanes, 1500, np.int32)  # share of order 0 in what orders 2 and 1 leave
        self.one, self.one_hash, self.two_hash = (np.zeros(lanes, _I) for _ in range(3))
        self.at1 = self.base << wide
        self.ends = np.zeros((5, 0), np.int32)  # where the shares of order 2, 1 and 0 and the alphabet start, and the end

    def predict(self, n: int) -> None:
        """Guesses of the first n lanes, and the ends of the shares of order 2, 1 and 0 in 2^12."""
        mixed = self.one_hash[:n] ^ self.two_hash[:n]
        mixed *= _I(2246822519)
        mixed >>= _SLOT
        self.at2 = mixed.astype(np.intp)
        self.at2 += self.base[:n]
        one, two = self.first.take(self.at1[:n]), self.second.take(self.at2)
        self.level1, self.level2 = one & 7, two & 7
        self.guess1, self.guess2 = one >> 3, two >> 3
        if self.ends.shape[1] != n:
            self.ends = np.zeros((5, n), np.int32)
            self.ends[4] = 1 << BITS
        _, self.end2, self.end1, self.end0, whole = self.ends
        levels = (self.level2 * 8 + self.level1).astype(np.intp)
        _END2.take(levels, out=self.end2, mode="clip")
        _END1.take(levels, out=self.end1, mode="clip")
        np.copyto(self.end2, self.end1, where=self.guess1 == self.guess2)  # both shares are the one id's
        np.subtract(whole, self.end1, out=self.end0)
        self.end0 *= self.seen[:n]
        self.end0 >>= BITS
        self.end0 += self.end1

    def place(self, n: int, x: np.ndarray) -> np.ndarray:
        """Places in the table of order 1 of the next step, where x (counted from 1) is the id before."""
        x = x.view(_I)
        self.two_hash[:n] = self.one[:n] * _I(40503)
        self.one_hash[:n] = x * _I(2654435761)
        self.one[:n] = x
        at = (self.one_hash[:n] >> _SLOT).astype(np.intp)
        at += self.base[:n]
        at <<= self.wide
        return at

    def segment(self, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's share: 0 is order 2's, 1 order 1's, 2 order 0's, 3 the alphabet's."""
        at = which * n
        at += self.lane[:n]
        start = self.ends.take(at)
        at += n
        return start.astype(_U), (self.ends.take(at) - start).astype(_U)

    def update(self, n: int, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, late: np.ndarray, lately: np.ndarray, at: np.ndarray) -> None:
        """x counted from 1, where orders 2 and 1 were right, the lanes that neither was, where order 0 was, and x's places."""
        own = self.seen[late]
        self.seen[late] = own + (np.where(lately, np.int32(HIT), np.int32(MISS)) - own >> RATE)
        entry = x * 8
        entry += 1
        self.second[self.at2] = entry + np.minimum(self.level2, 6) * hit2
        self.first[self.at1[:n]] = entry + np.minimum(self.level1, 6) * hit1
        self.at1[:n] = at


def _lengths(n: int) -> np.ndarray:
    out = np.full(-(-n // BLOCK), BLOCK, np.int64)
    if n % BLOCK:
        out[-1] = n % BLOCK
    return out


def _by_time(tokens: np.ndarray, lanes: int) -> np.ndarray:
    """Row t holds the t-th id of every block."""
    padded = np.zeros(lanes * BLOCK, np.int32)
    padded[: len(tokens)] = tokens
    return np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)


def encode_blocks(tokens: np.ndarray, alphabet: int) -> bytes:
    lengths = _lengths(len(tokens))
    lanes, model = len(lengths), _Model(len(lengths), 1)
    lane, x_of = model.lane, _by_time(tokens, lanes)
    last = model.first  # beside an entry: the id that was last there and when, to find distances
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    words, used = np.zeros((lanes, BLOCK + 4), _U), np.zeros(lanes, np.int64)  # a step gives one word at most
    for t in range(int(lengths.max(initial=0))):
        n = lanes if t < lengths[-1] else lanes - 1  # only the last block can be short
        x = x_of[t, :n]
        x1 = x + 1
        model.predict(n)
        hit2, hit1 = model.guess2 == x1, model.guess1 == x1
        k = np.flatnonzero(~(hit2 | hit1))
        at = model.place(n, x1)
        beside = at + 1
        was = last.take(beside[k])
        last[beside] = x1 * BLOCK + t
        k_seen = was // BLOCK == x1[k]
        which = (~hit2).astype(np.intp)
        which[k] = 3 - k_seen
        start, size = model.segment(n, which)
        r = rng[:n] >> _BITS
        add, new = r * start, r * size
        d = k_seen * (t - was % BLOCK)
        r = new[k] // np.where(k_seen, max(1, int(_SUMS[t])), alphabet).astype(_U)
        add[k] += r * np.where(k_seen, _SUMS[np.maximum(d - 1, 0)], x[k]).astype(_U)
        new[k] = r * np.where(k_seen, _SEEN[d], 1).astype(_U)
        add += low[:n]
        over = np.flatnonzero(add < low[:n])
        words[over, used[over] - 1] += _U(1)
        if n == lanes:
            low, rng = add, new
        else:
            low[:n], rng[:n] = add, new
        model.update(n, x1, hit2, hit1, k, k_seen, at)
        k = np.flatnonzero(new < _LOW)
        words[k, used[k]] = low[k] >> _HALF
        used[k] += 1
        low[k] <<= _HALF
        rng[k] <<= _HALF
    for _ in range(2):
        words[lane, used] = low >> _HALF
        low <<= _HALF
        used += 1
    words = words[:, : int(used.max(initial=0)) + 1]
    for j in range(words.shape[1] - 1, 0, -1):  # what ran over goes to the word before
        words[:, j - 1] += words[:, j] >> _HALF
    words = words.astype("<u4")
    out = []
    for k in range(lanes):
        own = tokens[k * BLOCK : k * BLOCK + lengths[k]].astype("<u4").tobytes()
        out.append(struct.pack("<III", lengths[k], used[k], zlib.crc32(own)) + words[k, : used[k]].tobytes())
    return b"".join(out)


def decode_blocks(data: memoryview, alphabet: int) -> np.ndarray:
    heads, at = [], 0
    while at < len(data):
        n, used, crc = struct.unpack_from("<III", data, at)
        heads.append((n, used, crc, at + 12))
        at += 12 + 4 * used
    lanes = len(heads)
    if not lanes:
        return np.empty(0, np.uint32)
    lengths = np.array([h[0] for h in heads])
    if lengths.max() > BLOCK:
        raise ValueError(f"a block of over {BLOCK} ids")
    words = np.zeros((lanes, max(h[1] for h in heads) + 2), np.uint32)
    for k, (_, used, _, start) in enumerate(heads):
        words[k, :used] = np.frombuffer(data, "<u4", used, start)
    model, lane, width = _Model(lanes), np.arange(lanes), words.shape[1]
    words = words.ravel()
    at, used = lane * width, np.full(lanes, 2)
    code, rng = words.take(at).astype(_U) << _HALF | words.take(at + 1).astype(_U), np.full(lanes, (1 << 64) - 1, _U)
    out = np.zeros((BLOCK, lanes), np.int32)
    flat = out.ravel()
    for t, n in enumerate((lanes - np.cumsum(np.bincount(lengths)))[:-1].tolist()):
        model.predict(n)
        r = rng[:n] >> _BITS
        value = np.minimum(code[:n] // r, _U((1 << BITS) - 1)).astype(np.int32)
        which = np.add((value >= model.end2).view(np.int8), (value >= model.end1).view(np.int8))
        which += (value >= model.end0).view(np.int8)
        which = which.astype(np.intp)
        start, size = model.segment(n, which)
        hit2 = which == 0
        x = np.where(hit2, model.guess2, model.guess1) - 1
        rest, new = code[:n] - r * start, r * size
        late = k = np.flatnonzero(which > 1)
        lately, total = which[k] == 2, max(1, int(_SUMS[t]))
        r = np.maximum(new[k] // np.where(lately, total, alphabet).astype(_U), _U(1))  # nought only in a broken file
        value = np.minimum(rest[k] // r, np.where(lately, total, alphabet).astype(_U) - _U(1)).astype(np.int64)
        d = np.minimum(_STEPS.take(value, mode="clip"), max(1, t))
        x[k] = np.where(lately, flat.take(np.maximum(t - d, 0) * lanes + lane[k]), value)
        rest[k] -= r * np.where(lately, _SUMS[d - 1], value).astype(_U)
        new[k] = r * np.where(lately, _SEEN[d], 1).astype(_U)
        out[t, :n] = x
        if n == lanes:
            code, rng = rest, new
        else:
            code[:n], rng[:n] = rest, new
        k = np.flatnonzero(new < _LOW)
        code[k] = code[k] << _HALF | words.take(at[k] + np.minimum(used[k], width - 1)).astype(_U)
        used[k] += 1
        rng[k] = np.maximum(rng[k] << _HALF, _U(1 << BITS))
        x += 1
        model.update(n, x, hit2, model.guess1 == x, late, lately, model.place(n, x))
    out = np.ascontiguousarray(out.T)
    tokens = np.concatenate([out[k, : lengths[k]] for k in range(lanes)]).astype(np.uint32)
    at = 0
    for n, _, crc, _ in heads:
        if zlib.crc32(tokens[at : at + n].astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum doesn't hold")
        at += n
    return tokens


def encode_file(doc_ids: list[int | None], ids_of: list[bytes]) -> bytes:
    """One file of whole documents, each as its id and its tokens (little-endian uint32 bytes, below 2^20)."""
    tokens = np.frombuffer(b"".join(ids_of), "<u4")
    alphabet = int(tokens.max(initial=0)) + 1
    if alphabet > 1 << TOP:
        raise ValueError(f"a token id over {(1 << TOP) - 1}")
    known = np.array([i is not None for i in doc_ids], np.uint8)
    head = struct.pack("<II", alphabet, len(doc_ids)) + known.tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([len(x) // 4 for x in ids_of], "<u8").tobytes()
    head = zlib.compress(head, 6)
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + encode_blocks(tokens, alphabet)


def decode_file(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    size, crc = struct.unpack_from("<II", data, len(MAGIC))
    at = len(MAGIC) + 8
    if zlib.crc32(data[at : at + size]) != crc:
        raise ValueError("the header's checksum doesn't hold")
    head = zlib.decompress(data[at : at + size])
    alphabet, n_docs = struct.unpack_from("<II", head)
    cut = lambda kind, n, o: np.frombuffer(head, kind, n, o)
    known, doc_ids, lengths = cut("u1", n_docs, 8), cut("<i8", n_docs, 8 + n_docs), cut("<u8", n_docs, 8 + 9 * n_docs)
    tokens = decode_blocks(memoryview(data)[at + size :], alphabet)
    return [i if k else None for i, k in zip(doc_ids.tolist(), known.tolist(), strict=True)], np.split(tokens, np.cumsum(lengths.astype(np.int64))[:-1]) if n_docs else []


def write_token_files(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_tokens: int = 3 << 21) -> None:
    """Write (bucket, seq, n_tokens, data) rows to path: files of about file_tokens ids, in ascending order of id.

    Texts are dealt once into buckets of consecutive ids; buckets, and in them files, are in order. A document is never
    cut, so a file of one very long text grows with it: about 40 bytes of tables an id. Edge cases: a null text is
    empty (its end id alone); null ids come first; tied ids are ordered by text; an empty table gives no files.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed_by_id(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", n, "bucket")
    # a bucket a partition: its files are as full as they can be, which the coder's steps over all blocks gain by
    dealt = rows.repartitionById(n, "bucket").sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "text")
    schema = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("data", pa.binary())])

    def run(batches):
        cache, end = token_cache(vocabulary, 1_000_000), end_id.to_bytes(4, "little")
        bucket, seq, ids, found, size = None, 0, [], [], 0
        for b in slices(batches, "text", 8 << 20):
            for bk, i, x in zip(b.column("bucket").to_pylist(), b.column("id").to_pylist(), cache.encode(b.column("text").to_pylist()), strict=True):
                if ids and (bk != bucket or size >= file_tokens):
                    yield batch_of(schema, [bucket], [seq], [size], [encode_file(ids, found)])
                    seq, ids, found, size = seq + 1, [], [], 0
                if bk != bucket:
                    bucket, seq = bk, 0
                ids.append(i)
                found.append(x + end)
                size += len(x) // 4 + 1
        if ids:
            yield batch_of(schema, [bucket], [seq], [size], [encode_file(ids, found)])

    map_arrow(dealt, run, "bucket int, seq int, n_tokens long, data binary", keep=vocabulary).write.option("compression", "none").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, bucket, seq) of each document; blocks are decoded and their checksums verified."""
    files = spark.read.parquet(path)
    sums = {r["bucket"]: r["n"] for r in files.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()}  # a row a bucket
    first, total = [], 0
    for b in range(max(sums, default=-1) + 1):
        first.append(total)
        total += sums.get(b, 0)
    before = F.coalesce(F.sum("n_tokens").over(W.partitionBy("bucket").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("bucket", "seq", "n_tokens").withColumn("base", before + F.get(F.array(*[F.lit(x).cast("long") for x in first]), F.col("bucket"))).drop("n_tokens")
    schema = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, tokens = decode_file(b.column("data")[k].as_py())
                n = [len(t) for t in tokens]
                at = np.cumsum([0, *n[:-1]])
                yield batch_of(schema, [b.column("bucket")[k].as_py()] * len(ids), [b.column("seq")[k].as_py()] * len(ids), ids, at, n, [zlib.crc32(t.astype("<u4").tobytes()) for t in tokens])

    read = map_arrow(files.select("bucket", "seq", "data"), run, "bucket int, seq int, id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["bucket", "seq"]).select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs' token files to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, vocabulary, path, id_col, text_col)
    return read_token_files(docs.sparkSession, path).withColumnRenamed("id", id_col)
