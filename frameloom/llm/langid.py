"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores with a switching penalty
labels spans of mixed-language text.

A model holds smoothed log probabilities of hashed character n-grams (1 to 3, with word edges) and whole words for each
language, and the languages seen in each script.
"""

from __future__ import annotations

import re
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_arrow, mix64, slices

#: First code point, last code point, script.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
)
NAMES = tuple(dict.fromkeys(s for _, _, s in SCRIPTS)) + ("Other",)


def _letters() -> str:
    """Pattern of runs of letters (Unicode category L): word characters but digits, the underscore and other numerals."""
    odd = [k for k in range(sys.maxunicode + 1) if (c := chr(k)).isalnum() and not c.isalpha() and not c.isdecimal()]
    starts = [k for k, before in zip(odd, [-2, *odd], strict=False) if k != before + 1]
    ends = [k for k, after in zip(odd, [*odd[1:], -2], strict=True) if after != k + 1]
    return r"[^\W\d_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]+"


WORD = re.compile(_letters())
BUCKETS = 1 << 15
_STARTS = np.array([s[0] for s in SCRIPTS])
_ENDS = np.array([s[1] for s in SCRIPTS])
_KIND = np.array([NAMES.index(s[2]) for s in SCRIPTS])


def script_of(first: np.ndarray) -> np.ndarray:
    """Index into NAMES for each code point."""
    at = np.searchsorted(_STARTS, first, side="right") - 1
    return np.where((at >= 0) & (first <= _ENDS[at]), _KIND[at], len(NAMES) - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature of each lower-case word, offsets by word, script of each word."""
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in words]) + 2
    starts = np.cumsum(lengths) - lengths
    ends = starts + lengths
    total = len(codes)
    word_at = np.repeat(np.arange(len(words)), lengths)
    left = ends[word_at] - np.arange(total)  # code points up to the word's end
    one = mix64(codes + np.uint64(1 << 32))
    two = mix64(one[:-1] * np.uint64(3) + codes[1:])
    three = mix64(two[:-1] * np.uint64(5) + codes[2:])
    whole = mix64(np.add.reduceat(mix64(codes + (left.astype(np.uint64) << np.uint64(40))), starts))
    at = np.concatenate([word_at, word_at[:-1][left[:-1] >= 2], word_at[:-2][left[:-2] >= 3], np.arange(len(words))])
    found = np.concatenate([one, two[left[:-1] >= 2], three[left[:-2] >= 3], whole])
    order = np.argsort(at, kind="stable")
    counts = np.bincount(at, minlength=len(words))
    return (found[order] >> np.uint64(49)).astype(np.int64), np.cumsum(counts) - counts, script_of(codes[starts + 1].astype(np.int64))


@dataclass(frozen=True)
class Model:
    """languages; log probabilities (bucket, language); allowed (script, language)."""

    languages: tuple[str, ...]
    log: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods relative to the best language, at least -12; -20 for languages of other scripts. And which words
        say something: one in a script that no language was learned in has zeros and counts for none."""
        found, offsets, script = features(words)
        s = np.add.reduceat(self.log[found], offsets, axis=0)
        ok = self.allowed[script]
        some = ok.any(axis=1)
        s = np.where(ok, s, -np.inf)
        s[some] = np.maximum(s[some] - s[some].max(axis=1, keepdims=True), -12)
        s[~ok] = -20
        s[~some] = 0
        return s.astype(np.float32), some


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 20_000, min_share: float = 0.01) -> Model:
    """Fit on at most about max_rows of docs' rows with text and language, picked by a hash of the id.

    Features are counted on the executors; languages * BUCKETS sums reach the driver. min_share: of a script's words
    that a language must have to be a candidate there.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in slices(batches, "text"):
            words: dict[str, list[str]] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, []).extend(WORD.findall(text.lower()))
            for lang, found in words.items():
                if found:
                    f, _, script = features(found)
                    for kind, x, size in ((0, f, BUCKETS), (1, script, len(NAMES))):
                        c = np.bincount(x, minlength=size)
                        hit = np.flatnonzero(c)
                        yield batch_of(schema, [lang] * len(hit), [kind] * len(hit), hit, c[hit])

    counted = map_arrow(rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), run, "lang string, kind int, bucket long, n long")
    sums = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = tuple(sorted({r["lang"] for r in sums}))
    counts, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(NAMES), len(languages)))
    for r in sums:
        (scripts if r["kind"] else counts)[r["bucket"], languages.index(r["lang"])] = r["n"]
    log = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS))
    allowed = (scripts > 0) & (scripts >= min_share * scripts.sum(axis=0).clip(1))
    return Model(languages, log.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, index: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; index points into scores, its parts of the given lengths are documents.

    All documents advance one word at a time together.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    n = lengths[order]
    languages = scores.shape[1]
    path = np.zeros(len(index), np.int16)
    if languages == 1 or not len(index):
        return path
    stay = np.zeros((len(index), languages), bool)
    best = np.zeros(len(index), np.int16)  # of the word before
    longest = int(n[0])
    active = np.searchsorted(-n, -np.arange(longest), side="left")  # documents with more than t words
    v = scores[index[starts[: active[0]]]].astype(np.float64)
    last = np.zeros(len(n), np.int64)
    for t in range(1, longest + 1):
        a = active[t] if t < longest else 0
        if a < len(v):
            last[a : len(v)] = v[a:].argmax(axis=1)
            v = v[:a]
        if not a:
            break
        at = starts[:a] + t
        top = v.argmax(axis=1)
        reach = v[np.arange(a), top][:, None] - penalty
        keep = v >= reach
        stay[at], best[at] = keep, top
        v = np.where(keep, v, reach) + scores[index[at]]
    state = np.zeros(0, np.int64)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        if a > len(state):
            state = np.concatenate([state, last[len(state) : a]])
        at = starts[:a] + t
        path[at] = state
        if t:
            state = np.where(stay[at, state], state, best[at])
    return path


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0, spans: bool = True) -> DataFrame:
    """docs with lang_pred, score and, if wanted, spans (start, end in code points, language) after its own columns.

    lang_pred is the language with the most letters in its spans, score its share of all letters; letters of words in
    scripts that no language was learned in are no language's, so a text of such words alone gets the first language and
    score 0. Only the text is read. Edge cases: null texts and texts without a letter (Unicode category L; numerals aren't
    letters) get `und` and score 0, no spans; ties go to the language first in order; a model without languages says `und`; repeated rows are labelled one by one; columns of docs that
    are called like the new ones, in any case, are replaced; an empty table gives an empty result. Narrow: no shuffle.
    """
    own = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score", "spans")]
    add = "lang_pred string, score double, spans array<struct<start:int,end:int,language:string>>"
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages * BUCKETS numbers, whatever the corpus
    names = [f.name for f in own]

    def run(batches):
        model, known, table, says = sent.value, {}, np.zeros((0, max(1, len(sent.value.languages))), np.float32), np.zeros(0, bool)
        for b in slices(batches, "text", 3 << 20):
            if len(known) > 150_000:
                known, table, says = {}, table[:0], says[:0]
            texts = [t or "" for t in b.column("text").to_pylist()]
            found = [WORD.findall(t.lower()) for t in texts]
            lengths = np.array([len(f) for f in found])
            new = list(dict.fromkeys(w for f in found for w in f if w not in known)) if model.languages else []
            for k in range(0, len(new), 50_000):
                some = new[k : k + 50_000]
                known.update(zip(some, range(len(known), len(known) + len(some)), strict=True))
                scores, learned = model.word_scores(some)
                table, says = np.concatenate([table, scores]), np.concatenate([says, learned])
            lang, score, parts = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if model.languages and lengths.sum():
                index = np.fromiter((known[w] for f in found for w in f), np.int64, int(lengths.sum()))
                letters = np.fromiter((len(w) for f in found for w in f), np.int64, len(index))
                path = viterbi(table, index, lengths, penalty)
                doc = np.repeat(np.arange(len(texts)), lengths)
                sums = np.bincount(doc * len(model.languages) + path, weights=letters * says[index], minlength=len(texts) * len(model.languages)).reshape(len(texts), -1)
                win = sums.argmax(axis=1)
                share = sums[np.arange(len(texts)), win] / np.bincount(doc, weights=letters, minlength=len(texts)).clip(1)
                for k in np.flatnonzero(lengths):
                    lang[k], score[k] = model.languages[win[k]], float(share[k])
                if spans:
                    first = np.cumsum(lengths) - lengths
                    for k in np.flatnonzero(lengths).tolist():
                        own_path = path[first[k] : first[k] + lengths[k]]
                        cuts = [0, *(np.flatnonzero(np.diff(own_path)) + 1).tolist(), len(own_path)]
                        at = [m.span() for m in WORD.finditer(texts[k])]
                        if len(at) != len(own_path):  # lower case changed what counts as a letter
                            at = [(0, len(texts[k]))] * len(own_path)
                        parts[k] = [{"start": at[x][0], "end": at[y - 1][1], "language": model.languages[own_path[x]]} for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string())]))
            columns = b.column("own").flatten()[: len(names)] + [pa.array(lang), pa.array(score, pa.float64()), pa.array(parts if spans else [None] * len(texts), kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "spans"])

    from pyspark.sql.types import StructType

    schema = StructType(own + StructType.fromDDL(add).fields)
    # one struct, so that no column of docs can be taken for the text
    held = F.struct(*(F.col(f"`{n}`") for n in names), F.lit(0).alias("_"))
    return map_arrow(docs.select(held.alias("own"), F.col(text_col).alias("text")), run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows set aside from training: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def crc_remainder(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
