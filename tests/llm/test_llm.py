"""Each text operator against a brute-force version or an exact round trip, with the edge cases of its docstring."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from frameloom.llm import arc, bpe, chat, common, fingerprints, langid, minhash, packing, quality, rangecoder, style_tree
from frameloom.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, bucket string, _w string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, ties and clashing names."""
    rnd = random.Random(5)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "Straße", "né"]) + str(rnd.randint(0, 99)) for _ in range(20_000))
    base = "the quick brown fox jumps over the lazy dog and then some more words follow here for good measure " * 4
    texts = [None, "", "  \n\t ", "one", "a b c d", long, long, base, base.upper(), base + " tail", "x" * 3000, "日本語 テキスト\nСлово и ещё", "!!! ??? 123", "same\nsame\nsame\n\n", None, "\u001c weird \u0085 spaces   <|endoftext|> end"]
    rows = [(i if i != 14 else None, t, "en" if i % 2 else None, None, None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[7:8], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_prefix_hash():
    a, b = fingerprints.PrefixHash("xxabcdefgh" * 50 + "é"), fingerprints.PrefixHash("abcdefgh" + "xxabcdefgh" * 49)
    assert a.equal(2, b, 0, 8) and not a.equal(0, b, 0, 8)
    assert a.common_extension(2, b, 0) == 498 and a.common_extension(0, b, 0) == 0


def test_fingerprint_blocks_and_likeness(monkeypatch):
    text = "".join(random.Random(1).choices("abcdefg hij", k=5000))
    whole = fingerprints.fingerprint(text)
    monkeypatch.setattr(fingerprints, "BLOCK", 128)
    assert fingerprints.fingerprint(text) == whole
    near = fingerprints.likeness(whole, fingerprints.fingerprint(text[:2500] + "Z" + text[2500:]))
    far = fingerprints.likeness(whole, fingerprints.fingerprint("".join(random.Random(2).choices("abcdefg hij", k=5000))))
    assert fingerprints.likeness(whole, whole) == 1 and 0.7 < near < 1 and far < 0.1


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_fingerprint_neighbours(request, name):
    df = request.getfixturevalue(name)
    rows = sorted(pairs(df), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = fingerprints.fingerprint_neighbours(df).collect()
    assert len(got) == len(rows)
    want = Counter()
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = fingerprints.edited(t, nxt)
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(e)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == want


def plain_fingerprint(text):
    """The fields of a fingerprint by loops over code points, from the definition in the module's first lines."""
    c, n, prime = [ord(x) + 1 for x in text], len(text), fingerprints.PRIME
    stride = 1
    while n > fingerprints.MARKS * stride:
        stride *= 2

    def value(start, length, base):  # the same wherever a span stands
        out = 0
        for k in reversed(range(length)):
            out = (out * base + c[start + k]) % prime
        return out

    both = lambda start, length: tuple(value(start, length, b) for b in fingerprints.BASES)
    short = lambda h: f"{((h[0] << 31 | h[1]) * 0x9E3779B97F4A7C15 >> 20) & 0xFFFFFFFF:08x}"
    whole = both(0, n)
    marks = range(stride, n // stride * stride + 1, stride)
    w = min(fingerprints.WINDOW, n)
    hashes = {int(common.mix64(np.array([value(k, w, fingerprints.BASES[0])], np.uint64))[0]) >> 32 for k in range(n - w + 1)} if n else set()
    sketch = "".join(f"{h:08x}" for h in sorted(hashes)[: fingerprints.SKETCH])
    return f"{n:x}:{stride:x}:{whole[0] << 31 | whole[1]:016x}:{''.join(short(both(0, m)) for m in marks)}:{''.join(short(both(n - m, m)) for m in marks)}:{sketch}"


def plain_likeness(s, t):
    """From the texts: the share of the longer that common starts and ends of sampled lengths cover, or the windows'."""
    if s == t:
        return 1.0
    n, m = max(len(s), len(t)), min(len(s), len(t))
    if not m:
        return 0.0
    stride = lambda x: max(1, 1 << max(0, -(-len(x) // fingerprints.MARKS) - 1).bit_length())
    step = max(stride(s), stride(t))
    run = lambda a, b: max((k for k in range(0, m + 1, step) if a[:k] == b[:k]), default=0)
    cover = (run(s, t) + run(s[::-1], t[::-1])) / n
    least = lambda x: {x_ for x_ in plain_fingerprint(x).rsplit(":", 1)[1:]}.pop()
    u, v = ({h[i : i + 8] for i in range(0, len(h), 8)} for h in (least(s), least(t)))
    low = set(sorted(u | v)[: fingerprints.SKETCH])
    return min(max(cover, len(u & v & low) / max(1, len(low))), 1 - 1 / (2 * n))


def test_fingerprint_query_by_brute_force(spark, docs):
    """Fingerprints and both likenesses of the query against loops over the texts."""
    from frameloom.llm.queries import op1_fingerprints

    rows = sorted(pairs(docs), reverse=True)
    got = {r["doc_id"]: r for r in op1_fingerprints(spark, SF).collect()}
    seen = 0
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        if len(t) < 1200:
            assert got[i]["fingerprint"] == plain_fingerprint(t) and got[i]["edited_fingerprint"] == plain_fingerprint(e)
            assert abs(got[i]["near_edited"] - plain_likeness(t, e)) < 1e-12
            seen += 1
            if len(nxt) < 1200:
                assert abs(got[i]["near_next"] - plain_likeness(t, nxt)) < 1e-12
    assert seen > 30


def test_range_coder():
    rnd = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 1), (1023, 3), (1024, 60_000), (5000, 50_257)):
        ids = [rnd.integers(0, top, n, dtype=np.uint32).tobytes(), b"", bytes(4)]
        got_ids, got = rangecoder.decode_file(rangecoder.encode_file([5, None, -1], ids))
        assert got_ids == [5, None, -1] and [g.astype("<u4").tobytes() for g in got] == ids
    for n, top in ((3000, 1 << 20), (30_000, 2)):  # the widest alphabet and the narrowest
        ids = rnd.integers(0, top, n).astype(np.uint32)
        ids[::7] = top - 1
        assert (rangecoder.decode_blocks(memoryview(rangecoder.encode_blocks(ids, top)), top) == ids).all()
    blocks = rangecoder.encode_blocks(np.arange(3000, dtype=np.uint32) % 777, 777)  # any block is decoded without the others
    second = 12 + 4 * struct.unpack_from("<III", blocks)[1]
    assert (rangecoder.decode_blocks(memoryview(blocks)[second:], 777) == np.arange(1024, 3000) % 777).all()
    with pytest.raises(ValueError, match="token id over"):
        rangecoder.encode_file([1], [struct.pack("<I", 1 << 20)])
    repeats = np.tile(np.arange(50, dtype=np.uint32), 400).tobytes()
    data = rangecoder.encode_file([1], [repeats])
    assert len(data) < len(repeats) / 12
    broken = bytearray(data)
    broken[-len(data) // 4] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rangecoder.decode_file(bytes(broken))


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_token_files(request, name):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(name)
    rows = sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in rangecoder.token_files(df, vocabulary("byte_bpe_50k.json")).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_chat_fold_and_round_trip(spark):
    rows = [
        (1, 0, 0, 0, "start", "user", None), (1, 0, 0, 1, "delta", None, "Hel"), (1, 0, 0, 2, "delta", None, "lo"),
        (1, 1, 1, 3, "start", "assistant", None), (1, 1, 1, 4, "delta", None, "first answer"),
        (1, 2, 2, 5, "start", "user", None), (1, 2, 2, 6, "delta", None, "dropped, as turn 1 is made anew"),
        (1, 1, 1, 7, "regenerate", None, None), (1, 1, 1, 8, "delta", None, "second"), (1, 0, 0, 9, "edit", None, "Hi\\ ###"),
        (2, 0, 0, 0, "delta", None, None), (None, 0, 0, 0, "start", "assistant", None), (None, 0, 0, 1, "delta", None, "</turn> é\n"),
    ]
    out = chat.format_events(spark.createDataFrame(rows, chat.EVENTS)).collect()
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in out}
    assert got == {1: [("user", "Hi\\ ###"), ("assistant", "second")], 2: [("", "")], None: [("assistant", "</turn> é\n")]}
    assert chat.format_events(spark.createDataFrame([], chat.EVENTS)).count() == 0


def test_chat_query(spark):
    from frameloom.llm.queries import op3_chat

    hard = r"\### Assistant: </turn> ok"
    conv = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        conv.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    conv[-7] = [("user", hard), ("assistant", hard)]
    got = {r["conv_id"]: r for r in op3_chat(spark, SF).collect()}
    assert set(got) == set(conv)
    for c, turns in conv.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        # a turn is "### role: text </turn>" and a line feed; each backslash, each ### and each </turn> of a text adds one
        marked = lambda t: len(t) + t.count("\\") + t.count("###") + t.count("</turn>")
        chars = sum(4 + marked(a) + a.count(":") + 2 + marked(b) + 9 for a, b in turns)
        want = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) == want


def test_viterbi_is_exact():
    rnd = np.random.default_rng(2)
    scores = rnd.normal(size=(30, 3)).astype(np.float32)
    lengths = np.array([0, 6, 1, 4, 0, 5])
    index = rnd.integers(0, 30, lengths.sum())
    path = langid.viterbi(scores, index, lengths, 0.7)
    at = 0
    for n in lengths:
        own, s = path[at : at + n], scores[index[at : at + n]].astype(float)
        value = lambda p, s=s: sum(s[k, x] for k, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p[:-1], p[1:], strict=True))
        best = max((value(p) for p in np.ndindex(*[3] * n)), default=0)
        assert abs(value(own) - best) < 1e-5
        at += n


def test_language(docs, odd, empty):
    model = langid.train(docs.where(~langid.held_out()))
    got = langid.identify(docs, model).toPandas()
    held = got[[langid.crc_remainder(i) == 2 for i in got.doc_id]]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    mixed = docs.sparkSession.createDataFrame([(1, " ".join(docs.where(f"lang = '{x}'").first()["text"][:400] for x in ("en", "de")))], "doc_id long, text string")
    spans = langid.identify(mixed, model).first()["spans"]
    assert {s["language"] for s in spans} >= {"en", "de"}
    rows = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 12))
    assert langid.identify(empty, model).count() == 0 and langid.train(empty).languages == ()
    assert langid.identify(odd, langid.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_language_clashing_names_and_many_languages(spark, docs):
    model = langid.train(docs.where(~langid.held_out()))
    text = docs.where("lang = 'en'").first()["text"]
    df = spark.createDataFrame([(1, text, "a", "b", "c"), (1, text, "a", "b", "c"), (None, None, None, None, None)], "doc_id long, text string, _text string, LANG_PRED string, own string")
    got = langid.identify(df, model)
    assert got.columns == ["doc_id", "text", "_text", "own", "lang_pred", "score", "spans"]
    assert sorted((r["doc_id"] or 0, r["_text"], r["own"], r["lang_pred"]) for r in got.collect() if r["doc_id"]) == [(1, "a", "c", "en")] * 2
    scores = np.full((200, 200), -5.0, np.float32)
    np.fill_diagonal(scores, 0)
    assert langid.viterbi(scores, np.arange(200), np.ones(200, int), 1.0).tolist() == list(range(200))


def test_language_query_by_brute_force(spark, docs):
    """Predictions of the query itself against a plain reading of the model: every word's scores, the best path by trial."""
    from frameloom.llm.queries import op4_language

    model = langid.train(docs.where(~langid.held_out()))
    got = {r["doc_id"]: r for r in op4_language(spark, SF).collect()}
    some = [(i, t) for i, t in pairs(docs) if len(t) < 600]
    assert set(got) == {i for i, _ in pairs(docs)} and len(some) > 20
    for i, t in some:
        words = langid.WORD.findall(t.lower())
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        s, says = model.word_scores(words)
        s = s.astype(float)
        best = s[0]
        back = []
        for row in s[1:]:
            step = best[:, None] - 8.0 * (1 - np.eye(len(best)))
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        state, letters = int(best.argmax()), np.zeros(len(best))
        path = [state]
        for b in reversed(back):
            path.append(state := int(b[state]))
        for w, p, known in zip(words, reversed(path), says, strict=True):
            letters[p] += len(w) * known
        k = model.languages.index(got[i]["lang_pred"])
        assert letters[k] == letters.max() and abs(got[i]["score"] - letters[k] / sum(map(len, words))) < 1e-9


def test_language_of_what_was_not_learned(spark, docs):
    """Numerals aren't letters, and a script that no language was learned in says nothing: a learned value, score 0."""
    import unicodedata

    letters = {k for k in range(0x110000) if unicodedata.category(chr(k))[0] == "L"}
    assert {ord(c) for k in range(0x110000) if not 0xD800 <= k < 0xE000 for c in langid.WORD.findall(chr(k))} == letters
    model = langid.train(docs.where(~langid.held_out()))
    english = docs.where("lang = 'en'").first()["text"][:300]
    cyrillic = "Слово и ещё слово " * 20
    texts = ["½ ² 3", "Ⅷ ፩ ㊿", cyrillic, "日本語のテキスト", f"{english} {cyrillic}", english, "1 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    assert [got[k] for k in (0, 1, 6)] == [("und", 0.0)] * 3
    assert all(got[k][0] in model.languages and got[k][1] == 0 for k in (2, 3))
    own = lambda t: sum(c.isalpha() for c in t)
    assert got[4][0] == "en" == got[5][0] and got[5][1] == 1 and abs(got[4][1] - own(english) / own(texts[4])) < 1e-9


def brute_quality(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen = Counter(tri)
    covered = {k + d for k, x in enumerate(tri) if seen[x] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_quality(request, name):
    df = request.getfixturevalue(name)
    got = Counter(tuple(r) for r in quality.quality_report(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in pairs(df))
    a = quality.quality_cascade(df).select("doc_id", "kept")
    assert Counter(a.collect()) == Counter(quality.quality_report(df).select("doc_id", "kept").collect())
    assert quality.quality_cascade(df).columns == [*df.columns, "kept", "rejected_by"]
    assert {r.name for r in quality.order_rules(df)} == {r.name for r in quality.RULES}


def test_quality_order(docs):
    """The order is the same in every run, follows what is rejected per cost, and shared stages count once."""
    orders = {tuple(r.name for r in quality.order_rules(docs, sample_rows=100)) for _ in range(10)}
    assert len(orders) == 1
    a, b, c = quality.Stage("_a", "1", "1"), quality.Stage("_b", "1", "1"), quality.Stage("_c", "1", "1")
    rules = (quality.Rule("dear", (a, c), "x"), quality.Rule("cheap", (b,), "x"), quality.Rule("shared", (a,), "x"), quality.Rule("never", (), "x"))
    counted = [{"mask": 0b0001, "n": 30, "_a": 100, "_b": 10, "_c": 900}, {"mask": 0b0110, "n": 20, "_a": 80, "_b": 8, "_c": 700}, {"mask": 0, "n": 50, "_a": 500, "_b": 50, "_c": 4000}]
    # cheap: 20/68, then dear: 30/5500; shared rejects nothing that cheap hasn't
    assert [r.name for r in quality.order_by_rate(rules, counted)] == ["cheap", "dear", "shared", "never"]
    assert [r.name for r in quality.order_by_rate(rules[:3], counted, ("_a", "_c"))] == ["dear", "shared", "cheap"]


def test_quality_short_circuit(spark):
    """What a later rule makes isn't made for a row that an earlier one has rejected, and clashing names are replaced."""
    rows = [(1, "few", "a", "b"), (2, "word " * 60, "a", "b"), (2, "word " * 60, "a", "b"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept string, _verdict string")
    out = quality._run(df.selectExpr("doc_id", "coalesce(text, '') AS _text"), quality.RULES, "_text").collect()
    assert all((r["_h"] is None) == (r["doc_id"] != 2) and (r["_y"] is None) for r in out)
    got = quality.quality_cascade(df)
    assert got.columns == ["doc_id", "text", "_verdict", "kept", "rejected_by"]
    by = {r["doc_id"]: r["rejected_by"] for r in got.collect()}
    assert by[1] == by[None] == "few_words" and by[2] == "repeated_words"
    lines = lambda f: "\n".join(f(k) for k in range(60))
    one = lambda t: quality.quality_cascade(spark.createDataFrame([(t,)], "text string")).first()["rejected_by"]
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03d}")
    assert one(lines(lambda k: f" - {word(k)} item")) == "bullet_lines" and one(lines(lambda k: f"{word(k)} more...")) == "cut_lines"
    assert one(lines(lambda k: f"{word(k)} 12345{k}")) == "digits" and one(lines(lambda k: f"{word(k)} {word(7 * k + 3)} said")) is None


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- c --><div class="ad box">buy</div>
<article><h1>Head&nbsp;line</h1><p><b>One<br><p>Two &lt;b&gt;  words
more</p><aside>side</aside><form><input><p>form text</p></form><p>Th<i>re</i>e</p><section class="comments"><p>reader</p></section></article>
<div id="cookie-notice">accept</div><footer>&copy; foot</footer>"""


def test_extract(spark):
    assert style_tree.extract(PAGE) == "Head line One Two <b> words more Three"
    assert [style_tree.extract(x) for x in (None, "", "<p>a<p>b", "<", "a < b", "<div>x<script>y", "<nav>m<article>t")] == ["", "", "a b", "<", "a < b", "x", "t"]
    rows = [(k, "http://h.example/x", f"<html><body><div class='bar'>same words</div><div><p>story {k} own</p></div></body></html>") for k in range(20)]
    rows += [(20, None, None), (20, "nohost", ""), (None, "http://one.example/", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in style_tree.extract_main_text(df).collect())
    want = Counter((k, f"story {k} own", len(f"story {k} own")) for k in range(20))
    assert got == want + Counter([(20, "", 0), (20, "", 0), (None, "Head line One Two <b> words more Three", 38)])
    assert style_tree.extract_main_text(df.limit(0)).count() == 0


def test_low_branches_inside_article(spark):
    page = "<html><body><article><h1>Title {k}</h1><div class='box'><p>the same <b>words</b> here</p></div><p>story {k} <b>same</b> end</p></article></body></html>"
    rows = [(k, "http://h.example/x", page.format(k=k)) for k in range(20)]
    rows += [(100 + k, "http://copy.example/x", f"<html><head><link href='{k}'></head><body><article><p>one text</p></article><!-- {k} --></body></html>") for k in range(20)]
    got = {r["page_id"]: r["text"] for r in style_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k} story {k} same end" for k in range(20)} | {100 + k: "one text" for k in range(20)}


def test_style_tree_against_brute_force(spark):
    """Entropies of every node from the pages' own elements, and the same texts whether branches are broadcast or streamed."""
    import math

    page = "<div class='a'><p>menu</p></div><div><h1>t{k}</h1>{more}<div class='box'><p>same {h}</p></div></div>"
    rows = [(k, f"http://{'xy'[k % 3 == 0]}.example/", page.format(k=k % 25, h=k % 2, more="<p>own</p>" * (k % 4))) for k in range(60)]
    rows += [(100, "http://x.example/", None), (101, None, "<p>no host</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "regexp_extract(url, '//([^/]*)', 1) AS host")
    got = {(r["host"], r["node"]): r for r in style_tree.site_style_tree(df).collect()}
    seen: dict = {}
    for h, html in {(re.sub(".*//|/", "", u or ""), x) for _, u, x in rows}:
        for node, _, style, content in style_tree.branches(html):
            seen.setdefault((h, node), []).append((style, content))
    assert set(got) == set(seen)
    for key, pairs_ in seen.items():
        n = len(pairs_)
        entropy = lambda xs, n=n: -sum(c / n * math.log(c / n) for c in Counter(xs).values()) / math.log(n) if n > 1 else 1.0
        r = got[key]
        assert r["pages"] == n and abs(r["presentation"] - entropy([a for a, _ in pairs_])) < 1e-9 and abs(r["content"] - entropy(pairs_)) < 1e-9
    a, b = (Counter(tuple(r) for r in style_tree.extract_main_text(df, broadcast_nodes=n).collect()) for n in (10**6, 0))
    assert a == b and sum(a.values()) == len(rows) and any("menu" not in r[2] and r[2].startswith("t") for r in a)


def test_names_and_hostile_pages():
    import time

    for page, want in (
        ("<article class='post has-sidebar'><p>x</p></article>", "x"), ("<div class='content with-sidebar'>y</div>", "y"),
        ("<article><div class='article-header'><h1>T</h1></div><p class='share-price'>z</p><div class='comments'>no</div></article>", "T z"),
        ("<div class=comments><article class=comment>no</article></div>a", "a"), ("<a href='x>y'>t</a> <b title=it's>c</b>", "t c"),
        ("<p title='the hidden valley'>a</p><p data-hidden=1>b</p>", "a b"), ("<div hidden>no</div><p style='color: red; DISPLAY : none'>no</p><p aria-hidden=true>no</p>c", "c"),
        ("<section class='comments-on-law'>d</section><div class='cookie-recipe'>e</div><p class='comment'>f</p>", "d e f"),
        ("<div class='user-comments'>no</div><div class='cookie-notice'>no</div><div class='newsletter-signup'>no</div><section class=comment>no</section>g", "g"),
        ("<div id=site-header>no</div><div class='post-header'>h</div><ul class='top menu-list'><li>no</ul>b", "h b"),
    ):
        assert style_tree.extract(page) == want
    for page in ("<a " * 300_000, '<a b="' * 170_000, "<div>" * 200_000, "<div>a" * 160_000, "<nav>" + "<article>x" * 100_000, "<p><b>x" * 140_000, "<div>" * 90_000 + "</p>" * 90_000):
        began = time.process_time()
        style_tree.extract(page)
        style_tree.branches(page)
        assert time.process_time() - began < 60  # seconds on a slow machine; anything quadratic takes hours


def test_main_text_ignores_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://h/", "<p>a</p>", "x", "y", "z")] * 2, "page_id long, url string, html string, host string, node string, salt string")
    assert [tuple(r) for r in style_tree.extract_main_text(df, broadcast_nodes=-1).collect()] == [(1, "http://h/", "a", 1)] * 2


def test_extract_pages(spark):
    import html as h

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        main = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(h.unescape(re.sub(r"</?(p|br|h1)\b[^>]*>", " ", re.sub(r"</?b>", "", main))).split())
        assert style_tree.extract(r["html"]) == want


def test_arc_versions():
    records = [arc.ArcRecord("http://a.example/x y", "1.2.3.4", "19991231235959", "text/html", b"HTTP/1.0 200 OK\n\n<p>\n\nWARC/1.1\r\n\r\n", 1), arc.ArcRecord("dns:a.example", "1.2.3.4", "2000", "text/dns", b"", 1)]
    for version in (1, 2):
        info, *got = arc.parse_arc(arc.write_arc(records, version))
        assert info.url.startswith("filedesc:") and [(r.url, r.date, r.body) for r in got] == [(r.url, r.date, r.body) for r in records]
        data = b"".join(arc.to_warc(r) + b"\r\n\r\n" for r in (info, *got))
        out = list(arc.parse_warc(data))
        assert [f["WARC-Type"] for f, _ in out] == ["warcinfo", "response", "resource"] and [b for _, b in out][1:] == [r.body for r in records]
    assert arc.timestamp("19991231235959") == "1999-12-31T23:59:59Z" and arc.timestamp("2000") == "2000-01-01T00:00:00Z" and arc.timestamp("x") == "1970-01-01T00:00:00Z"
    with pytest.raises(ValueError, match="shorter"):
        list(arc.parse_arc(arc.write_arc(records[:1])[:-5]))


def test_archives(spark):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a.example/ 1", big), (2, None, big), (3, "u", big + "x"), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (9, "u", big), (9, "u", big), (None, "u", "none")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in arc.archive_round_trip(df).collect())
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = 9 if h == big and i != 9 else None
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to] += 1
    assert got == want
    assert arc.archive_round_trip(df.limit(0)).count() == 0


def test_token_cache_equals_the_library():
    """100,000 short strings of what separates tokens, the most hostile ones beside plain words."""
    from tokenizers import Tokenizer

    path, rnd = vocabulary("byte_bpe_50k.json"), random.Random(1)
    tok, cache = Tokenizer.from_file(path), common.TokenCache(path, max_runs=20_000)
    for letters in (["\x00", "\n", "\r", "\x85", " ", " ", "  ", "a", "b", "The", "1", "'s", "<|endoftext|>", "\u2028", "\t", "\x1c", "日", "!", "\x00\n"], ["é", "É", "ß", "ª", "ŉ", "ǆ", "ʼ", "a", "Word", ".", ",", "?", "'", " ", " ", "\n", "Ω", "1"]):
        texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 9))) for _ in range(50_000)] + ["x \x00\n b"]
        for k in range(0, len(texts), 5000):
            some = texts[k : k + 5000]
            assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode(some)] == [e.ids for e in tok.encode_batch_fast(some, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_packing(request, name):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(name)
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    windows = packing.pack(df, vocabulary("byte_bpe_50k.json"))
    want = Counter((i, struct.pack(f"<{len(x) + 1}I", *x, 1)) for i, x in ((i, tok.encode(t, add_special_tokens=False).ids) for i, t in pairs(df)))
    by_sequence = {w["sequence_id"]: bytes(w["ids"]) for w in windows.collect()}
    rows = packing.placements(windows).collect()
    seen: dict = {}
    for r in rows:
        seen.setdefault(r["sequence_id"], []).append(r)
    assert set(seen) == set(by_sequence)
    found: dict = {}  # pieces by document, start and length
    for s, own in seen.items():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist()
        assert sum(r["length"] for r in own) * 4 == len(by_sequence[s]) <= 2048 * 4
        for r in own:
            ids = by_sequence[s][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
            assert zlib.crc32(ids) == r["ids_crc32"]
            found.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], ids))
    for (i, ids), n in want.items():  # rows that repeat one id are told apart by their number of tokens here
        pieces, at = sorted(found.pop((i, len(ids) // 4))), 0
        assert sum(p[1] for p in pieces) == n * len(ids) // 4
        for start, length, own in pieces:
            assert own == ids[4 * start : 4 * (start + length)] and (n > 1 or start == at)
            at = start + length
    assert not found
    if name == "docs":
        assert sum(r["length"] for r in rows) / (2048 * len(seen)) > 0.97
    for r in packing.padded(windows, pad_id=9).collect():
        n = r["used"]
        assert bytes(r["ids"]) == by_sequence[r["sequence_id"]] + (b"" if n & (n - 1) == 0 else struct.pack("<I", 9) * (2048 - n))


def test_packer_emits_the_fullest():
    packer = packing.OnlinePacker(capacity=10, n_open=2, least_cut=3)
    out = [w for x, n in (("a", 6), ("b", 8), ("c", 7)) for w in packer.add(x, n, lambda x, s, n: (x, s, n))]
    assert out == [(2, [("b", 0, 8)])] and sorted(f for f, _ in packer.leftovers()) == [3, 4]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_near_duplicates(request, name):
    df = request.getfixturevalue(name)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    want = brute_components([r for r in pairs(df) if r[0] is not None])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_fewer_words_than_a_shingle_in_all(spark):
    for n in range(1, 7):
        text = " ".join("abcdef"[:n])
        alone, beside = minhash.shingle_sets([text]), minhash.shingle_sets([None, text, "g h i j k l"])
        assert len(alone[0]) == max(1, n - 4) and (alone[0] == beside[1]).all()
    got = minhash.near_duplicates(spark.createDataFrame([(7, "a b c")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got] == [(7, 1, 7, True)]


def test_links_between_others_than_the_lead(spark):
    """Chains whose smallest id links to one end only, beside many documents that share a long passage."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    base = [word() for _ in range(200)]
    rows, text = [], base
    for k in range(12):
        rows.append((k, " ".join(text)))
        text = text[:]
        for j in range(k * 6 % 190, k * 6 % 190 + 8):
            text[j] = word()
    shared = [word() for _ in range(90)]
    rows += [(100 + k, " ".join(shared + [word() for _ in range(60)])) for k in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_repeated_ids_have_the_links_of_all_their_texts(spark):
    rnd = random.Random(8)
    text = lambda: " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(100))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (3, b), (4, c + " end"), (5, text()), (5, None), (6, a), (None, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 1), (None, None)}


def test_recall_near_the_threshold(spark):
    """Pairs between 0.75 and 0.80: at least 0.99 of the brute-force links are found, and none that isn't one."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghijklm", k=6))
    rows = []
    for k in range(150):
        base = [word() for _ in range(rnd.randint(80, 300))]
        other, n = base[:], len(base)
        cut = int(n * rnd.uniform(0.11, 0.15))
        other[-cut:] = [word() for _ in range(cut)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    near = [k for k, c in want.items() if c != k]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 40 and sum(got[k] == want[k] for k in near) >= 0.99 * len(near)
    assert all(got[k] in (k, want[k]) for k in got)


def test_common_passage_is_split(spark):
    """A key of more rows than a block goes through the finer tables; links among its documents are still found."""
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    shared = [word() for _ in range(60)]
    rows = []
    for k in range(90):
        own = [word() for _ in range(60)]
        rows.append((3 * k, " ".join(shared + own)))
        if k % 3 == 0:
            rows.append((3 * k + 1, " ".join(shared + own[:-6] + [word() for _ in range(6)])))
    df = spark.createDataFrame(rows, "id long, text string")
    rows_ = df.selectExpr("1L AS key", "id", "0 AS i", "0 AS j", "-1L AS lead", "id AS comp")
    sigs = minhash.sketch(df, "id", "text", 5, 9, 2)
    near = {(3 * k, 3 * k + 1) for k in range(0, 90, 3)}
    for split in (16, 10_000):
        got = {tuple(sorted(r)) for r in minhash.cross_pairs(rows_, sigs, df, 9, 2, 5, 75, block=16, split=split).collect()}
        assert len(got) < 200 and (split > 16 or near <= got)
    edges = spark.createDataFrame([(0, k) for k in range(1, 60) if k % 3 < 2], "a long, b long")
    assert [tuple(r) for r in minhash.verify(edges, df, 5, 75, share=7).collect()] == [(0, 1)]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 560)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert got == {k: v for k, v in top.items() if k in got} and all(top[x] == x for x in top if x not in got)


def test_bpe(docs, odd, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    own = bpe.WordBPE(path)
    rnd = random.Random(7)
    texts = [t for _, t in pairs(docs)] + [t for _, t in pairs(odd)] + ["ΣΑΣ Σ", "İ Ǆ ﬁ", "it's I'LL x's", "<|startoftext|>a<|endoftext|>", "é ² Ⅷ", "a\u001cb"]
    texts += ["".join(rnd.choices("etaoinshrdlu'", k=rnd.randint(1, 30))) for _ in range(3000)]
    for t, (ids, decoded) in zip(texts, own.encode(texts), strict=True):
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == tok.decode(want, skip_special_tokens=False) == own.decode(ids)
    assert 0 < own.failed < own.checked
    for word in ("".join(rnd.choices("acgt", k=200_000)), "aab" * 50_000, "x" * 100_000, "straße" * 20_000):  # quadratic: hours
        ids, _ = own.encode([word])[0]
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(word, add_special_tokens=False).ids
    for df in (odd, empty):
        assert Counter(tuple(r) for r in bpe.encode_decode(df, path, digests=True).collect()) == brute_bpe(df, tok)


def brute_bpe(df, tok):
    coded = [(i, tok.encode(t, add_special_tokens=False).ids) for i, t in pairs(df)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(tok.decode(x, skip_special_tokens=False).encode())) for i, x in coded)


def test_bpe_query_by_the_library(spark, docs):
    from tokenizers import Tokenizer

    from frameloom.llm.queries import op10_bpe

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert Counter(tuple(r) for r in op10_bpe(spark, SF).collect()) == brute_bpe(docs, tok)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "language", "near_duplicates", "packing"]
    rows = {i: t for i, t in pairs(docs)}
    a = p.STAGES[0][1](spark, docs, SF)
    assert a.columns == list(p.COLUMNS)
    kept = {r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()}
    assert {r["doc_id"] for r in a.collect()} == kept
    b = p.STAGES[1][1](spark, a, SF)
    assert {r["doc_id"] for r in b.collect()} <= kept and b.count() > 0.97 * len(kept)
    c = p.STAGES[2][1](spark, b, SF)
    left = {r["doc_id"] for r in b.collect()}
    assert {r["doc_id"] for r in c.collect()} == {x for _, x in brute_components([(i, rows[i]) for i in left]).values()}
    d = p.STAGES[3][1](spark, c, SF)
    assert {r["doc_id"] for r in d.collect()} == {r["doc_id"] for r in c.collect()}


def test_pipeline_stages_on_odd_rows(spark, docs, odd, empty):
    """Nulls, empty texts, repeated rows and ids, clashing names, an empty table, each stage on its own."""
    import corpus_pipeline as p

    good = docs.where("lang = 'en' AND n_chars BETWEEN 400 AND 3000").limit(3).collect()
    rows = [(7, good[0]["text"], "en", "s", 1)] * 10 + [(8, good[1]["text"], None, None, None), (8, good[2]["text"], "en", None, None), (None, good[1]["text"], "en", None, None), (9, None, "en", "s", 0), (10, "", "en", "s", 0), (11, "Слово " * 80, "en", "s", 0), (12, "½ ² 3", "en", "s", 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, score string")
    alike = lambda f: Counter((r["doc_id"], r["text"]) for r in f.collect())
    quality_, language, near, pack = (f for _, f in p.STAGES)
    for stage in (quality_, language, near):
        assert stage(spark, empty, SF).count() == 0 and stage(spark, df, SF).columns == list(p.COLUMNS)
    assert pack(spark, empty, SF).count() == 0
    assert alike(quality_(spark, df, SF))[(7, good[0]["text"])] == 10
    assert not {9, 10} & {r["doc_id"] for r in quality_(spark, df, SF).collect()}
    model = langid.train(docs.where(~langid.held_out()))
    labelled = langid.identify(df.select(*p.COLUMNS), model).where("lang_pred <> 'und' AND score >= 0.5")
    assert alike(labelled)[(7, good[0]["text"])] == 10 and not {9, 10, 11, 12} & {r["doc_id"] for r in labelled.collect()}
    kept = alike(near(spark, df, SF))
    least = min(good[1]["text"], good[2]["text"])
    assert kept[(7, good[0]["text"])] == 1 and kept[(8, least)] == 1 and kept[(None, good[1]["text"])] == 1
    assert sum(n for (i, _), n in kept.items() if i == 8) == 1 and all(kept[(i, t)] == 1 for i, t in [(9, None), (10, ""), (12, "½ ² 3")])
    pieces = pack(spark, near(spark, df, SF), SF).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(i for i, _ in kept.elements())
