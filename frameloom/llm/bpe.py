"""Word-level byte pair encoding by speculation and verification.

For each word a greedy longest match over the vocabulary proposes tokens. A vectorised check then asks of every adjacent
pair of proposed tokens whether merging by rank could ever have joined across their border; a word whose borders all
stand is encoded. Only words with a failing border are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, batch_of, byte_letters, joined_runs, known_runs, map_arrow, slices

#: White space as the vocabulary's normaliser knows it; Python's \s has four control characters more.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class WordBPE:
    """Encoder and decoder for a tokenizers JSON file whose normaliser drops white space and whose words end in a suffix."""

    def __init__(self, path: str, max_runs: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.letters = byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        same = {t: t for t in self.vocab}  # one string object for each token
        self.joins = {(same[a], same[b]): (k, same[a + b]) for k, (a, b) in enumerate(merges)}
        size = max(self.vocab.values()) + 1
        #: rank of the merge that makes a token (-1: none), and the two tokens it joins
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        pairs = []
        for k, (a, b) in enumerate(merges):
            t = self.vocab[a + b]
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = k, self.vocab[a], self.vocab[b]
            pairs.append((self.vocab[a] * size + self.vocab[b], k))
        pairs.sort()
        self.pair_keys, self.pair_ranks, self.size = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), size
        # a token can be proposed if its own borders stand all the way down, i.e. merging its letters gives it back
        whole = np.flatnonzero(self.rank >= 0)
        sound = np.ones(size, bool)
        sound[whole] = self.borders_stand(self.left[whole], self.right[whole], self.rank[whole])
        for t in whole[np.argsort(self.rank[whole])]:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        self.proposals = {t: i for t, i in self.vocab.items() if sound[i]}
        self.longest = max(map(len, self.proposals))
        self.runs: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.max_runs, self.checked, self.failed = max_runs, 0, 0

    def borders_stand(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: no merge across their border (of a rank under `below`) comes before the merges that
        make the two tokens, undone one by one, the latest first."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if below is None else below.copy()
        stands, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joined = np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)
            rx, ry = self.rank[x], self.rank[y]
            made = np.maximum(rx, ry)
            # while both are whole, their join applies if it ranks under what has been undone; it also has to come
            # before the next neighbour inside takes part, which the limit says
            bad = joined < limit[live]
            stands[live[bad]] = False
            go = ~bad & (made >= 0)
            undo_x = go & (rx > ry)
            undo_y = go & ~undo_x
            # of equal ranks at one border the left one is merged first, so a join of the rank undone on the left
            # side can't win, one of the rank undone on the right side can
            limit[live[undo_x]] = rx[undo_x]
            limit[live[undo_y]] = ry[undo_y] + 1
            a[live[undo_x]] = self.right[x[undo_x]]
            b[live[undo_y]] = self.left[y[undo_y]]
            live = live[go]
        return stands

    def symbols(self, word: str) -> list[str]:
        out = [self.letters[b] for b in word.encode()]
        out[-1] += self.end
        return out

    def propose(self, symbols: list[str]) -> list[int]:
        """Greedy longest match; every single symbol is in the vocabulary. Linear in the word's length."""
        out, at, n, known = [], 0, len(symbols), self.proposals
        text = "".join(symbols)
        last, size = n - 1, len(text)
        while at < n:
            if size - at <= self.longest and (tail := text[at:]) in known:  # reaches the word's end
                out.append(known[tail])
                break
            for to in range(min(last, at + self.longest), at, -1):
                piece = text[at:to]
                if piece in known:
                    out.append(known[piece])
                    at = to
                    break
            else:
                out.append(known[text[at:]])
                break
        return out

    def merge(self, symbols: list[str]) -> list[int]:
        """Exact merging: the pair of lowest rank, the leftmost of equals, until none is left. n log n in the word's length:
        pairs wait in a heap, and one whose symbols have changed since is passed over."""
        s, join, n = list(symbols), self.joins.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], k, m[1]) for k, p in enumerate(zip(s[:-1], s[1:], strict=True)) if (m := join(p))]
        heapify(heap)
        while heap:
            rank, k, joined = heappop(heap)
            right = after[k]
            if not s[k] or right >= n or (now := join((s[k], s[right]))) is None or now[0] != rank:
                continue
            s[k], s[right] = joined, ""
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if m := join((joined, s[right])):
                    heappush(heap, (m[0], k, m[1]))
            left = before[k]
            if left >= 0 and (m := join((s[left], joined))):
                heappush(heap, (m[0], left, m[1]))
        return [self.vocab[x] for x in s if x]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        split = [self.symbols(w) for w in words]
        out = [self.propose(s) for s in split]
        flat = np.array([t for o in out for t in o], np.int64)
        lengths = np.array([len(o) for o in out])
        if len(flat) > 1:
            word = np.repeat(np.arange(len(out)), lengths)
            inner = np.flatnonzero(word[:-1] == word[1:])
            pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            wrong = np.unique(word[inner[~self.borders_stand(pairs // self.size, pairs % self.size)[back]]])
            for k in wrong.tolist():
                out[k] = self.merge(split[k])
            self.checked, self.failed = self.checked + len(words), self.failed + len(wrong)
        return out

    def normalise(self, run: str) -> str:
        # letter by letter: the vocabulary's lower case doesn't know the final sigma
        return unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()

    def _learn(self, runs: list[str]) -> None:
        """Encode runs without white space and keep their ids and tokens' names, a space after each."""
        for k in range(0, len(runs), 20_000):
            self._learn_some(runs[k : k + 20_000])

    def _learn_some(self, runs: list[str]) -> None:
        parts = [[x if x in self.special else self.words(self.normalise(x)) for x in self.special_split(r)] for r in runs]
        words = list(dict.fromkeys(w for p in parts for x in p if isinstance(x, list) for w in x))
        ids = dict(zip(words, self.encode_words(words), strict=True)) if words else {}
        for r, p in zip(runs, parts, strict=True):
            own = [i for x in p for i in ([self.special[x]] if isinstance(x, str) else [i for w in x for i in ids[w]])]
            self.runs[r] = (np.array(own, "<u4").tobytes(), "".join([self.names[i] + " " for i in own]).encode())

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian uint32 bytes and its decoded text.

        At most max_runs runs stay cached, in two generations: when the young half is full it becomes the old one, from
        which runs still in use are taken over.
        """
        if 2 * len(self.runs) > self.max_runs:
            self.runs, self.old = {}, self.runs
        spaced = [t.replace("\n", " ") for t in texts]
        spaced = pa.array([t if t.isprintable() else BLANK.sub(" ", t) for t in spaced], pa.large_string())  # of white space, only the space is printable
        ids, names = joined_runs(pc.split_pattern(spaced, " "), self._look_up)
        return list(zip(ids, [n[:-1].decode() for n in names], strict=True))

    def _look_up(self, runs: list[str]) -> tuple[list[bytes], list[bytes]]:
        found = known_runs(self, runs)
        return [f[0] for f in found], [f[1] for f in found]

    def decode(self, ids: bytes) -> str:
        """Tokens' names, one space between two: the file has no decoder."""
        return " ".join(self.names[i] for i in np.frombuffer(ids, "<u4").tolist())


def encoder(path: str) -> WordBPE:
    if path not in KEPT:
        KEPT[path] = WordBPE(path)
    return KEPT[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids as little-endian uint32 bytes, decoded), or with digests (id, n_tokens, ids_sha256, decoded_sha256).

    Narrow: no shuffle. Edge cases: null and empty texts have no tokens and decode to the empty text; strings of
    special tokens in a text are those tokens; null and repeated ids are encoded row by row; other columns are ignored.
    """
    if digests:
        schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        ddl = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        schema, ddl = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]), "id long, ids binary, decoded string"

    def run(batches):
        bpe = encoder(vocabulary)
        for b in slices(batches, "text", 4 << 20):
            found = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            if digests:
                yield batch_of(schema, b.column("id"), [len(f[0]) // 4 for f in found], [hashlib.sha256(f[0]).hexdigest() for f in found], [hashlib.sha256(f[1].encode()).hexdigest() for f in found])
            else:
                yield batch_of(schema, b.column("id"), [f[0] for f in found], [f[1] for f in found])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, ddl, keep=vocabulary).withColumnRenamed("id", id_col)
