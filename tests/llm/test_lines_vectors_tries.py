"""Line dedup, whitening and the prefix trie against brute-force versions, with the edge cases of their docstrings."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from frameloom.llm import common, line_dedup, prefix_trie, whitening
from frameloom.llm.queries import op11_line_dedup, op12_whitening, op13_prefix_trie

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def test_join_by_share(spark):
    left = spark.createDataFrame([(0, k) for k in range(900)] + [(k, k) for k in range(1, 60)] + [(None, 1)], "k long, v long")
    right = spark.createDataFrame([(k, k * 10, 900 if k == 0 else 1) for k in range(50)], "k long, w long, n long")
    for share in (1, 3, 10**6):
        got = Counter(tuple(r) for r in common.join_by_share(left, right, ["k"], "n", share).select("k", "v", "w").collect())
        assert got == Counter(tuple(r) for r in left.join(right, "k").select("k", "v", "w").collect()) and sum(got.values()) == 949
    assert common.join_by_share(left, right.where("false"), ["k"], "n").count() == 0


def brute_lines(rows, least=40, documents=5):
    """(id, text) rows; rows of one id are one document, rows without id documents by their text, before all others."""
    doc = lambda i, t: (1, i, "") if i is not None else (0, 0, t or "")
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc(i, t))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(h := holders.get(key(x), ())) >= documents and max(h) != doc(i, t))]
        out[(i, len(lines), len(lines) - len(stay), sha("\n".join(stay)))] += 1
    return out


DOCS = "doc_id long, text string, real string, h1 string, batch string, TEXT_ string"


@pytest.fixture(scope="module")
def lined(spark):
    rnd = random.Random(4)
    common_lines = [f"this line number {k} stands in many documents and has over forty letters" for k in range(12)]
    odd = ["", "short", "   " + common_lines[0] + "\t ", common_lines[1].upper(), "É" * 40, "é" * 40, "x" * 39, "y" * 40, "ſ" * 45, "S" * 45, "日本" * 20]
    rows = [(i, "\n".join(rnd.choices(common_lines + odd, k=rnd.randint(0, 9)))) for i in rnd.sample(range(-50, 10_000), 90)]
    rows += [(None, None), (None, ""), (None, common_lines[2]), (None, common_lines[2]), (None, common_lines[3] + "\n" + common_lines[2]), (20_000, None), (20_001, "")]
    rows += [(30_000, common_lines[4]), (30_000, common_lines[4]), (30_000, common_lines[5] + "\n" + common_lines[4]), rows[0], rows[1]]
    rows += [(k, "the very same line in six documents, the largest of which keeps both\n" * 2) for k in range(40_000, 40_006)]
    rows += [(50_000, "\n".join([common_lines[0], "a line that only this long document has, number %d"] * 20_000))]
    return [(i, t, "x", "x", "x", "x") for i, t in rows]


@pytest.mark.parametrize("fanout", [2, 3, 100])
def test_line_dedup(spark, lined, fanout):
    got = line_dedup.dedup_lines(spark.createDataFrame(lined, DOCS), fanout=fanout)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    found = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"])) for r in got.collect())
    assert found == brute_lines([r[:2] for r in lined]) and any(n for (_, _, n, _) in found)


def test_line_dedup_other_parameters_and_empty_table(spark, lined):
    df = spark.createDataFrame(lined, DOCS).withColumnsRenamed({"doc_id": "ID", "text": "body"})
    got = line_dedup.dedup_lines(df, "ID", "body", least=5, documents=2, batches=1)
    assert Counter((r["ID"], r["n_lines"], r["n_dropped"], sha(r["body"])) for r in got.collect()) == brute_lines([r[:2] for r in lined], 5, 2)
    none = line_dedup.dedup_lines(spark.createDataFrame([], DOCS))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "n_lines", "n_dropped"]


def test_runs_are_disjoint_sorted_and_compacted(spark):
    rnd = random.Random(9)
    index = line_dedup.LineRuns(spark, buckets=3, fanout=3)
    seen, shapes = {}, []
    for k in range(8):
        batch = [(rnd.randint(0, 40), rnd.randint(0, 3), True, 100 * (8 - k) + rnd.randint(0, 9)) for _ in range(60)]
        own = index.add(spark.createDataFrame(batch, "h1 long, h2 long, real boolean, doc long"))
        new = {}
        for a, b, _, d in batch:
            if (a, b) not in seen:
                new[a, b] = max(new.get((a, b), 0), d)
        assert {(r["h1"], r["h2"]): r["doc"] for r in own.collect()} == new
        seen |= new
        shapes.append([len(level) for level in index.levels])
    assert shapes == [[1], [2], [0, 1], [1, 1], [2, 1], [0, 2], [1, 2], [2, 2]]
    assert Counter((r["h1"], r["h2"], r["doc"]) for r in index.all().collect()) == Counter((*k, d) for k, d in seen.items())
    keys = spark.createDataFrame([(1, 1, True, 1)], "h1 long, h2 long, real boolean, doc long")
    plan = keys.join(index.runs()[0].select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the run isn't moved


def test_line_dedup_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in op11_line_dedup(spark, SF).collect()) == brute_lines(rows)


def check_whitened(rows, vectors, components=8):
    """rows: of by_component; vectors: (id, entries) that remain."""
    x = np.floor(1024 * np.array([v for _, v in vectors], float)) + 100_000
    exact = [[int(c) for c in v] for v in x]
    n, d = x.shape
    sums = [sum(c) for c in zip(*exact, strict=True)]
    cov = np.cov(x.T, bias=True).reshape(d, d)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    want = (x - x.mean(axis=0)) @ u / np.sqrt(e)
    by_id = defaultdict(list)
    for r in rows:
        assert r["n"] == n and r["identity_error"] <= 1e-4
        by_id[r["vec_id"], r["deviation"]].append((r["component"], r["whitened"], r["explained"]))
    signs = None
    assert len(rows) == n * len(e)
    order = defaultdict(list)
    for k, (i, _) in enumerate(vectors):
        order[i, sum((n * c - s) ** 2 for c, s in zip(exact[k], sums, strict=True))].append(k)
    assert set(order) == set(by_id)
    for key, ks in order.items():
        found = sorted(by_id[key])
        assert [c for c, _, _ in found] == sorted(c for c in range(1, len(e) + 1) for _ in ks)
        assert np.allclose([s for _, _, s in found], [e[c - 1] / np.trace(cov) for c, _, _ in found], rtol=1e-4)
        if len(ks) == 1:
            w = np.array([v for _, v, _ in found])
            if signs is None:
                signs = np.sign(w * want[ks[0]])
            assert np.allclose(w * signs, want[ks[0]], atol=1e-6)


def test_whitening_query(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(op12_whitening(spark, SF).collect(), vectors)


VECS = "vec_id long, embedding array<float>, id string, x string, n string, whitened string"


def test_whitening_odd_rows(spark):
    rnd = np.random.default_rng(1)
    good = [(k, [float(np.float32(c)) for c in rnd.normal(size=5) * [5, 3, 2, 1, 0.5]]) for k in range(60)]
    good += [good[3], (None, good[4][1]), (3, good[9][1])]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [0.0, 0.0, 0.0, 0.0, float("-inf")]), (105, []), (106, [1.0] * 4), (107, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in good + bad], VECS)
    rows = whitening.by_component(whitening.whiten(df)).collect()
    check_whitened(rows, good)
    assert Counter(r["component"] for r in rows) == {k: len(good) for k in range(1, 6)}
    check_whitened(whitening.by_component(whitening.whiten(df, components=2)).collect(), good, 2)
    assert whitening.whiten(df.where("false")).count() == 0 and whitening.whiten(df.where("vec_id = 105")).count() == 0
    wide = whitening.covariance(whitening.grid_vectors(df.where("vec_id < 60")), {f"c{i}": f"x[{i}]" for i in range(5)}, [100_000.0] * 5, 60)
    parts = whitening.covariance(whitening.grid_vectors(df.where("vec_id < 60")), {f"c{i}": f"x[{i}]" for i in range(5)}, [100_000.0] * 5, 60, most=4)
    assert np.array_equal(wide, parts)


def test_whitening_without_variance_and_with_large_sums(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], "vec_id long, embedding array<double>")
    for r in whitening.by_component(whitening.whiten(same)).collect():
        assert (r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (4, 0, None, None, None)
    flat = spark.createDataFrame([(k, [float(k), 2.0]) for k in range(4)], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.by_component(whitening.whiten(flat)).collect()}
    assert all(got[k, 2]["whitened"] is None and got[k, 2]["explained"] < 1e-12 and abs(got[k, 1]["explained"] - 1) < 1e-12 for k in range(4))
    assert abs(abs(got[0, 1]["whitened"]) - 1.5 / np.sqrt(1.25)) < 1e-9 and got[0, 1]["deviation"] == (4 * 1.5 * 1024) ** 2
    large = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0e6, 1.0]), (2, [1.0e5, 2.0])], "vec_id long, embedding array<double>")
    x = [[100_000, 100_000], [1024 * 3_000_000 + 100_000, 101_024], [1024 * 100_000 + 100_000, 102_048]]
    want = [sum((3 * v[k] - sum(y[k] for y in x)) ** 2 for k in range(2)) for v in x]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(large).collect()}
    assert max(want) > 1 << 63 and got == {k: w if w < 1 << 63 else None for k, w in enumerate(want)}


def brute_trie(rows, graft=True):
    """rows: (conv, turn, role, text)."""
    turn_digest = lambda r, t: hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{t or ''}".encode()).digest()
    own = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            own[c].append(((n is not None, n or 0), turn_digest(r, t), (r or "", t or "")))
    turns = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = turns.get(base, [])[:h] + v[h:] if graft else v
    nodes = defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].add(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out = Counter()
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids[p]) if kids[p] else 1
        saved = sum(below[k][1] for k in kids[p]) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        below[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(c for c in nodes[p] if len(built[c]) == len(p)))
        out[(min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), leaves, saved, sha(ends))] += 1
    return out


TURNS = "conv_id long, turn long, role string, text string, conv string, depth string, digest string"


def turns_of(rnd):
    rows = []
    for c in [*range(-12, 60), 900, 901, 904, 10**12]:
        for k in range(rnd.choice([0, 1, 2, 3, 8, 12])):
            rows.append((c, k, rnd.choice(["user", "assistant", None]) if k > 3 else "user", rnd.choice(["a", "é", None, ""]) if k % 3 else "hello"))
    rows += [(2, None, "system", "x"), (2, 1, "user", "tie"), (2, 1, "user", "another"), (2, 1, "user", "tie"), (None, 0, "user", "no conversation")]
    rows += [(c, k, "user", "shared " * 2000) for c in range(100, 130) for k in range(4)]
    return [(*r, "p", "q", "r") for r in rows]


def found_trie(rows, convs, block=prefix_trie.BLOCK):
    return Counter(tuple(r) for r in prefix_trie.prefix_trie(rows, convs, block).collect())


def test_prefix_trie(spark):
    rows = turns_of(random.Random(3))
    own = prefix_trie.positions(spark.createDataFrame(rows, TURNS))
    want = brute_trie([r[:4] for r in rows])
    got = prefix_trie.prefix_trie(*prefix_trie.grafted(own))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert Counter(tuple(r) for r in got.collect()) == want
    plain = brute_trie([r[:4] for r in rows], graft=False)
    for block in (1, 3, 4096):
        assert found_trie(*prefix_trie.sequences(own), block) == plain


def test_prefix_trie_of_long_and_nested_conversations(spark):
    """A conversation with most of all rows, whose turns fill several ranges, and a ladder of 40 that each leave the one before."""
    rows = [(0, k, "user", f"t{k}") for k in range(3000)] + [(c, k, "user", f"t{k}" if k < 70 * c else f"own {c} {k}") for c in range(1, 4) for k in range(70 * c + 2)]
    rows += [(1000 + c, k, "user", f"{max(k, c) if k > c else k}-{min(c, k)}") for c in range(40) for k in range(c + 2)]
    rows = [(*r, "p", "q", "r") for r in rows]
    own = prefix_trie.positions(spark.createDataFrame(rows, TURNS).repartition(7))
    pos = {(r["conv"], r["pos"]) for r in own.collect()}
    assert len(pos) == len(rows) and {(0, k) for k in range(3000)} <= pos
    assert found_trie(*prefix_trie.sequences(own), 64) == brute_trie([r[:4] for r in rows], graft=False)


def test_prefix_trie_empty_and_single(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(*prefix_trie.grafted(prefix_trie.positions(none))).count() == 0
    one = [(7, 0, "user", "x", "p", "q", "r")]
    for graft in (True, False):
        own = prefix_trie.positions(spark.createDataFrame(one, TURNS))
        made = prefix_trie.grafted(own) if graft else prefix_trie.sequences(own)
        assert found_trie(*made) == brute_trie([r[:4] for r in one], graft)


def test_end_digests_in_pieces(spark):
    rows = [(d, 1, 2, c) for d in (0, 1) for c in range(-5, 200)] + [(2, 1, 2, 5)]
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie.end_digests(spark.createDataFrame(rows, "depth long, a long, b long, conv long"), 50).collect()}
    whole = sha(",".join(map(str, range(-5, 200))))
    assert got == {0: whole, 1: whole, 2: sha("5")}


def test_prefix_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in op13_prefix_trie(spark, SF).collect()) == brute_trie(rows)
