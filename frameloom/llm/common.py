"""Shared helpers of the text operators: scratch tables, shipping the package, token caches, components."""

from __future__ import annotations

import gc
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import bucketed, join_by_share  # noqa: F401  for the operators
from ..scratch import discard, materialize, scratch_dir, scratch_path, ship  # noqa: F401


def _give_back() -> None:
    """Return freed memory to the system where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: What a worker process keeps between its tasks, by a name of its own.
KEPT: dict = {}


def map_arrow(df: DataFrame, fn, schema, keep: str | None = None) -> DataFrame:
    """mapInArrow; a task drops what earlier tasks of its worker kept, but for the entry that it names itself."""
    ship(df.sparkSession)

    def run(batches):
        if others := [k for k in KEPT if k != keep]:
            for name in others:
                del KEPT[name]
            gc.collect()
            _give_back()
        yield from fn(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column's strings come to about max_bytes in each; one longer row comes alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucketed_by_id(df: DataFrame, id_col: str, n_buckets: int, bucket: str) -> DataFrame:
    """Add a bucket number that ascends with id_col (null ids in bucket 0), cut at approximate quantiles of the ids.

    Only the ids are read for the cuts, and at most n_buckets - 1 numbers reach the driver.
    """
    cuts: list[int] = []
    if n_buckets > 1:
        found = df.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [i / n_buckets for i in range(1, n_buckets)], 0.2 / n_buckets)
        cuts = sorted({int(x) for x in found})
    return df.withColumn(bucket, F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(search_expr(cuts, F.col(id_col))).cast("int"))


def search_expr(cuts: list[int], x):
    """Number of cuts that are <= x, by binary search inside one expression."""
    n = len(cuts)
    if not n:
        return F.lit(0)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= x), at + s).otherwise(at))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each end of the edges (a, b); component is the smallest node that is reachable.

    Alternates large-star and small-star steps; each round is one written table, nothing reaches the driver but a count.
    """
    both = materialize(edges.where("a <> b").selectExpr("least(a, b) AS u", "greatest(a, b) AS v").distinct(), "cc")
    for _ in range(max_rounds):
        sym = both.selectExpr("u", "v").union(both.selectExpr("v", "u"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = sym.where("v > u").join(low, "u").selectExpr("m AS u", "v").where("u <> v").distinct()
        low2 = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        small = large.join(low2, large.v == low2.x).selectExpr("m AS u", "u AS v").where("u <> v").union(low2.selectExpr("m AS u", "x AS v"))
        new = materialize(small.selectExpr("least(u, v) AS u", "greatest(u, v) AS v").distinct(), "cc")
        # done when the edges are stars: no node is both a centre and a leaf, and each leaf has one centre
        leaves = new.groupBy("v").agg(F.count("*").alias("n"))
        bad = leaves.where("n > 1").select("v").union(new.select(F.col("u").alias("v")).distinct().join(leaves.select("v"), "v", "left_semi")).limit(1).count()
        both = new
        if not bad:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return both.selectExpr("v AS node", "u AS component").union(both.selectExpr("u AS node", "u AS component").distinct())


def joined_runs(lists: pa.Array, look_up) -> list[list[bytes]]:
    """For lists of strings, the joined values of each list's strings; look_up maps distinct strings to columns of values.

    Only distinct strings become Python objects: Arrow encodes them as a dictionary and takes the values by its indices.
    """
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    out = []
    for values in look_up(_strings(coded.dictionary)):
        taken = pa.array(values, pa.large_binary()).take(coded.indices)
        _, ends, raw = taken.buffers()
        cuts = np.frombuffer(ends, np.int64, taken.offset + len(taken) + 1)[taken.offset :][bounds].tolist() if len(taken) else [0] * len(bounds)
        raw = memoryview(raw or b"")
        out.append([bytes(raw[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
    return out


def _strings(found: pa.LargeStringArray) -> list[str]:
    """found.to_pylist(); by one joined string, which is several times faster, when no string holds a space."""
    n = len(found)
    whole = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), found.cast(pa.string()))
    out = pc.binary_join(whole, " ")[0].as_py().split(" ") if n else []
    return out if len(out) == n else found.to_pylist()


def known_runs(cache, runs: list[str]) -> list:
    """Values of distinct runs from a cache of two generations; runs of the old one move to the young, new ones are learnt."""
    found = list(map(cache.runs.get, runs))
    late, new, known = [k for k, v in enumerate(found) if v is None], [], cache.old.get
    for k in late:
        value = known(runs[k])
        if value is None:
            new.append(runs[k])
        else:
            cache.runs[runs[k]] = value
    if new:
        cache._learn(new)
    for k in late:
        found[k] = cache.runs[runs[k]]
    return found


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others, in order, for the letters from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class TokenCache:
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct run of text once.

    In this family of patterns a single space, or a single line feed, between two non-space characters always starts a
    new pre-token, so a text's ids are those of its runs, one after another. A run is kept by its text without that
    space, or with that line feed. A text's first run has neither: in plain texts it gets a line feed whose id is cut
    off, in others it is encoded by itself and never kept. New runs are encoded by the library many at a time, as one
    text: the only tokens in it that start with a space or are a line feed are the runs' first ones. Runs with other
    white space inside are encoded by themselves. Where the file's only splitting is the byte-level pattern, a run of
    Latin letters is one pre-token and goes to the library's model directly, and one mark after them is a pre-token of
    its own. At most max_runs stay cached, in two generations: when the young half is full it becomes the old one, from
    which runs still in use are taken over.
    """

    MARKS = ".,;:!?"

    def __init__(self, path: str, max_runs: int = 500_000):
        import re

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.runs, self.old, self.max_runs = Tokenizer.from_file(path), {}, {}, max_runs
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.split = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)").split
        self.plain = re.compile(r"\n?\S+").fullmatch
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.feed = len(self.tokenizer.encode("\n", add_special_tokens=False).ids) == 1
        self.starts = np.array([n[:1] == "\u0120" or n == "\u010a" for n in names])
        spec = json.loads(self.tokenizer.to_str())
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        pre = spec["pre_tokenizer"] or {}
        self.direct = not spec["normalizer"] and not spec["post_processor"] and all(pre.get(k) == v for k, v in byte_level.items()) and not any(t["content"].rstrip(self.MARKS).isalpha() for t in spec["added_tokens"])
        self.marks = dict(zip(self.MARKS, self._alone(list(self.MARKS)), strict=True)) if self.direct else {}
        self.letters, self.tokens = byte_letters(), self.tokenizer.model.tokenize

    def _is_plain(self, text: str) -> bool:
        """No white space but spaces and line feeds, each alone and between others."""
        spaced = text.replace("\n", " ")
        return bool(text) and self.feed and spaced.isprintable() and "  " not in spaced and spaced[0] != " " != spaced[-1]

    def _word(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters after a space, from the library's model; None for any other."""
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0250"):
            return None
        text = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.tokens("\u0120" + text)]).tobytes()

    def _learn_words(self, new: list[str]) -> list[str]:
        """Keep the runs that are a word, or a word and one mark; the others are returned."""
        rest, marks = [], self.marks
        for r in new:
            mark = marks.get(r[-1:])
            own = self._word(r if mark is None else r[:-1])
            if own is None:
                rest.append(r)
            else:
                self.runs[r] = own if mark is None else own + mark
        return rest

    def _learn(self, new: list[str]) -> None:
        if self.direct:
            new = self._learn_words(new)
        plain = [r for r in new if self.plain(r)]
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            text = "".join([r if r[0] == "\n" else " " + r for r in some])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) != len(some) or at[0]:
                self.runs.update(zip(some, self._alone([r if r[0] == "\n" else " " + r for r in some]), strict=True))
                continue
            raw, cuts = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
            self.runs.update(zip(some, [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        if len(plain) < len(new):
            rest = [r for r in new if not self.plain(r)]
            self.runs.update(zip(rest, self._alone([r if r[:1] == "\n" else " " + r for r in rest]), strict=True))

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian uint32 bytes, one string for each text."""
        if 2 * len(self.runs) > self.max_runs:
            self.runs, self.old = {}, self.runs
        out, plain, odd = [b""] * len(texts), [], []
        for k, t in enumerate(texts):
            (plain if self._is_plain(t) else odd).append(k)
        if plain:
            marked = pa.array(["\n" + texts[k].replace("\n", " \n") for k in plain], pa.large_string())
            for k, ids in zip(plain, joined_runs(pc.split_pattern(marked, " "), self._look_up)[0], strict=True):
                out[k] = ids[4:]  # without the line feed put before it
        if odd:
            parts = [self.split(texts[k]) for k in odd]
            rest = joined_runs(pa.array([p[1:] for p in parts], pa.list_(pa.large_string())), self._look_up)[0]
            for k, first, ids in zip(odd, self._alone([p[0] for p in parts]), rest, strict=True):
                out[k] = first + ids
        return out

    def _look_up(self, runs: list[str]) -> tuple[list[bytes]]:
        return (known_runs(self, runs),)


def token_cache(path: str, max_runs: int = 500_000) -> TokenCache:
    """One cache for each worker process and vocabulary; map_arrow's keep is the vocabulary's path."""
    if path not in KEPT:
        KEPT[path] = TokenCache(path, max_runs)
    KEPT[path].max_runs = max_runs
    return KEPT[path]
