"""Frame operators: every query against its SQL, and properties that hold whatever the implementation."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import expressions as X
from frameloom.operators import binning, ensemble, lineage, msm, posterior, sequence, spawning, spectral, states
from frameloom.plans.queries import ORACLE_SQL, QUERIES
from frameloom.sources import frames as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    rel = duck.sql(ORACLE_SQL[name])
    assert list(rel.columns) == df.columns
    assert sorted(got, key=repr) == sorted((tuple(r) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10 and set(e.oracle_sql()) <= set(e.queries())


def test_resample_conserves_weight():
    rng = np.random.default_rng(0)
    w = rng.random(20)
    for target in (1, 3, 40):
        out = ensemble.resample_bin(range(20), w, target, rng)
        assert len(out) == target and abs(sum(x for _, x in out) - w.sum()) < 1e-12
    assert [x for _, x in ensemble.resample_bin([0], [1.0], 4, rng)] == [0.25] * 4
    out = [x for _, x in ensemble.resample_bin(range(5), [0.4] + [1e-21] * 4, 4, rng, equalise=True)]
    assert max(out) <= 4 * min(out)


def test_large_merge_is_fast():
    import time

    began = time.time()
    out = ensemble.resample_bin(range(176_124), np.full(176_124, 1 / 176_124), 4, np.random.default_rng(0))
    assert len(out) == 4 and abs(sum(x for _, x in out) - 1) < 1e-9 and time.time() - began < 15


def test_slots(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate([0] * 5 + [1] * 2 + [2])], "walker long, cell long")
    assert {r["cell"]: r["slots"] for r in ensemble.slots(df, "cell", 8).collect()} == {2: 3, 1: 3, 0: 2}
    with pytest.raises(Exception, match="more occupied bins"):
        ensemble.slots(df, "cell", 2).collect()


def test_mfpt_closed_form(spark):
    make = lambda xs: spark.createDataFrame([(k, float(x)) for k, x in enumerate(xs)], "iteration int, flux double")
    r = sequence.mfpt(make([0.01] * 100), 2.0).first()
    assert abs(r["mfpt_ns"] - 0.2) < 1e-9 and abs(r["plateau_ratio"] - 1) < 1e-9 and r["converged"]
    r = sequence.mfpt(make([0] * 50 + [0.02] * 50), 2.0, 0.5).first()
    assert abs(r["mfpt_ns"] - 0.1) < 1e-9 and r["n_flux_events"] == 50
    assert not sequence.mfpt(make(np.linspace(0.001, 0.02, 100)), 2.0).first()["converged"]
    for xs in ([], [0, 0]):
        r = sequence.mfpt(make(xs), 2.0).first()
        assert r["mfpt_ns"] is None and r["tail_mean_flux"] == 0


def test_markov_model_recovers_chain():
    p = np.array([[0.9, 0.1, 0.0], [0.05, 0.9, 0.05], [0.0, 0.2, 0.8]])
    pi = spectral.stationary(p)
    m = spectral.markov_model(np.round(pi[:, None] * p * 1e6), 1)
    assert np.allclose(m["pi"], pi, atol=1e-3) and np.allclose(m["matrix"], p, atol=1e-3)
    assert spectral.largest_connected(np.array([[1, 1, 0], [1, 1, 1], [0, 0, 5]])).tolist() == [0, 1]
    with pytest.raises(RuntimeError):
        spectral.markov_model(np.array([[1.0, 1.0], [0.0, 1.0]]), 1)
    q = np.kron(np.eye(2), np.full((3, 3), 1 / 3)) * 0.98 + 0.02 / 6
    assert len({tuple(sorted(np.flatnonzero(spectral.pcca(q, 2) == k))) for k in (0, 1)} & {(0, 1, 2), (3, 4, 5)}) == 2


def test_reweighting_recovers_stationary_distribution(spark):
    rng = np.random.default_rng(1)
    p = np.array([[0.80, 0.15, 0.05], [0.10, 0.70, 0.20], [0.05, 0.25, 0.70]])
    s = rng.choice(3, 6000, p=(0.85, 0.10, 0.05))
    e = np.array([rng.choice(3, p=p[k]) for k in s])
    x, y = (10.0 * a + rng.normal(0, 0.05, 6000) for a in (s, e))
    df = spark.createDataFrame([(k, [float(x[k])], [float(y[k])]) for k in range(6000)], "seg_id long, x0 array<double>, x1 array<double>")
    w, drift = spectral.reweighting_rounds(df, 24, 3, average_last=1)
    got = np.zeros(6000)
    for r in w.collect():
        got[r["seg_id"]] = r["weight"]
    assert np.abs(np.array([got[s == k].sum() for k in range(3)]) - spectral.stationary(p)).max() < 0.05 and drift[0] > drift[-1]
    assert not spectral.drift_converged(drift) and spectral.drift_converged([0.5] * 10 + [0.001] * 20)
    empty, none = spectral.reweighting_rounds(df.limit(0), 4, 2)
    assert empty.count() == 0 and none == []


def test_greedy_vamp_picks_the_slow_column(spark):
    rng = np.random.default_rng(0)
    state, rows = 1, []
    for k in range(3000):
        state = -state if rng.random() < 0.02 else state
        rows.append((0, k, [state + 0.1 * rng.normal(), *rng.normal(size=4).tolist()]))
    c = spectral.covariances(spark.createDataFrame(rows, "walker int, frame int, v array<double>"), "v", 10, ["walker"])
    assert spectral.greedy_vamp(c, [[k] for k in range(5)], 0.05)[0] == [0]
    with pytest.raises(ValueError):
        spectral.covariances(spark.createDataFrame(rows[:5], "walker int, frame int, v array<double>"), "v", 10, ["walker"])


def test_lags_stay_in_their_segment(spark):
    df = spark.createDataFrame([(w, f, f) for w in range(3) for f in range(w + 1)], "walker int, frame int, x int")
    assert sorted(tuple(r) for r in sequence.lagged(df, ["x"], 1, ["walker"]).select("walker", "x", "x_lag").collect()) == [(1, 0, 1), (2, 0, 1), (2, 1, 2)]


def test_edges_are_ascending_and_adapt(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(-2, 0.3, 2000), rng.normal(2, 0.3, 2000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for edges in (binning.gradient_edges(df, "x", 10, -4, 4), binning.mab_edges(df, "x", 10, -4, 4)):
        assert edges[0] == -4 and edges[-1] == 4 and (np.diff(edges) > 0).all()
    inner = np.array(binning.gradient_edges(df, "x", 10, -4, 4)[1:-1])
    assert (np.abs(inner) < 1.5).sum() >= 4  # the barrier gets the edges


def test_voronoi_areas_fill_the_box():
    c = np.random.default_rng(0).random((12, 2))
    for periodic in (False, True):
        assert abs(binning.voronoi_areas(c, np.zeros(2), np.ones(2), periodic).sum() - 1) < 1e-9
    assert np.allclose(binning.voronoi_areas(np.array([[0.25, 0.5], [0.75, 0.5]]), np.zeros(2), np.ones(2)), 0.5)


def test_farthest_points(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 0.0, 9.0), (3, 0.1, 0.1)], "id long, x double, y double")
    assert spawning.farthest_points(df, "id", ["x", "y"], 3, target=[0.0, 0.0]) == [0, 1, 2]
    assert len(spawning.farthest_points(df, "id", ["x", "y"], 9)) == 4


def test_weighted_draw(spark):
    df = spark.range(100).withColumn("w", F.when(F.col("id") < 10, 1.0).otherwise(0.0))
    assert {r["id"] for r in spawning.weighted_draw(df, "w", 10, 1, "id").collect()} == set(range(10))
    assert spawning.weighted_draw(df.withColumn("w", F.lit(0.0)), "w", 7, 1, "id").count() == 7


def test_draw_with_replacement(spark):
    df = spark.createDataFrame([(k, 1.0 if k < 3 else 0.0) for k in range(6)], "id long, w double")
    got = [r["id"] for r in spawning.weighted_draw(df, "w", 50, 1, "id").collect()]
    assert len(got) == 50 and set(got) == {0, 1, 2}
    assert len(spawning.weighted_draw(df.withColumn("w", F.lit(float("nan"))), "w", 9, 1, "id").collect()) == 9
    assert spawning.weighted_draw(df.limit(0), "w", 5, 1, "id").count() == 0


def test_knn_by_blocks_and_by_broadcast(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, (60, 3)).astype(float)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    want = {(k, j, r + 1) for k in range(60) for r, j in enumerate([j for j in np.lexsort((np.arange(60), d[k])) if j != k][:4])}
    for size in (1 << 20, 0):
        assert {(r["id"], r["neighbour"], r["rank"]) for r in spawning.knn(df, "id", "v", 4, 16, size).collect()} == want


def test_lineage_errors(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "gone"), ("x", "y"), ("y", "x"), ("it's", "a")], "frame_key string, parent string")
    assert [r["frame_key"] for r in lineage.connected_path(df, "b", "a").orderBy("step").collect()] == ["b", "a"]
    assert [r["frame_key"] for r in lineage.to_root(df, "it's").orderBy("depth").collect()] == ["it's", "a"]
    with pytest.raises(Exception, match="no shared ancestor"):
        lineage.connected_path(df, "b", "c").collect()
    with pytest.raises(ValueError, match="cycle"):
        lineage.to_root(df, "x")
    assert lineage.to_root(df, "nobody").count() == 0
    with pytest.raises(ValueError, match="cycle"):
        lineage.ancestors_by_doubling(df, max_rounds=8)
    with pytest.raises(ValueError, match="no records"):
        lineage.nearest_record(df.limit(0), ["frame_key"], [0.0], [])


def test_survivors_and_conservation(spark):
    w = spark.createDataFrame([(k, 0.25) for k in range(4)], "walker long, weight double")
    some = lambda *ids: w.where(F.col("walker").isin(list(ids)))
    assert sorted(tuple(r) for r in ensemble.survivors(w, some(0, 1)).collect()) == [(0, 0.5), (1, 0.5)]
    assert [r["weight"] for r in ensemble.survivors(w.withColumn("weight", F.lit(0.0)), some(2, 3)).collect()] == [0.5, 0.5]
    for alive, least in ((w.limit(0), 0.0), (some(0), 0.5)):
        with pytest.raises(Exception, match="walkers are left"):
            ensemble.survivors(w, alive, least=least).collect()
    assert ensemble.conserved(w).count() == 4
    with pytest.raises(Exception, match="weights sum to"):
        ensemble.conserved(some(0)).collect()


def test_registries():
    from frameloom import registry as R

    assert {"uniform", "gradient", "mab", "eigenvector", "voronoi"} <= set(R.BINNERS.names()) and "pca" in R.MODELS.available()
    with pytest.raises(ValueError, match="no binner is called"):
        R.BINNERS.make("nothing")
    for name in ("tvae", "vampnet", "deep_tica", "spib"):
        with pytest.raises((RuntimeError, NotImplementedError), match="needs|outside"):
            R.MODELS.make(name)
    with pytest.raises(NotImplementedError):
        R.MODELS.make("deep_lda")
    R.PROJECTIONS.register("Twice", lambda df: df.withColumn("twice", F.col("id") * 2))
    assert "twice" in R.PROJECTIONS.names()
    with pytest.raises(ValueError):
        R.PROJECTIONS.register("", None)


def test_projection_plug_in(spark):
    from frameloom import registry as R

    R.PROJECTIONS.register("twice", lambda df: df.withColumn("twice", F.col("id") * 2))
    R.PROJECTIONS.register("loses", lambda df: df.select((F.col("id") * 2).alias("x")))
    assert [r["twice"] for r in R.project(spark.range(3), "twice").orderBy("id").collect()] == [0, 2, 4]
    with pytest.raises(ValueError, match="drops"):
        R.project(spark.range(3), "loses")


def test_checkpoints(spark, tmp_path):
    import shutil

    from frameloom.sources import checkpoints as C

    store = C.Checkpoints(spark, f"file://{tmp_path}/run")
    with pytest.raises(FileNotFoundError):
        store.load()
    history = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "iteration int, entry string")
    store.save(0, history.where("iteration < 1"), {"flux_history": [0.5]})
    store.save(2, history)
    assert spark.read.parquet(f"{tmp_path}/run/history/ckpt=2").count() == 2  # the gap is in the delta
    assert sorted(r["entry"] for r in store.load().collect()) == ["a", "b", "c"] and store.flux_history() == [0.5]
    assert [r["entry"] for r in store.load(0).collect()] == ["a"] and store.state(0) == {"flux_history": [0.5]}
    with pytest.raises(FileNotFoundError):
        store.load(1)
    shutil.rmtree(tmp_path / "run" / "history" / "ckpt=0")
    with pytest.raises(C.BrokenChain):
        store.load()
    with pytest.warns(UserWarning, match="incomplete"):
        assert sorted(r["entry"] for r in store.load(ignore_missing=True).collect()) == ["b", "c"]
    shutil.rmtree(tmp_path / "run" / "manifest" / "ckpt=2")
    assert store.complete() == [0]
    state = {}
    assert C.frozen_basis(state, [1.0, 2.0]) == [1.0, 2.0] == C.frozen_basis(state, [5.0, 6.0])
    with pytest.raises(ValueError):
        C.frozen_basis(state, [1.0])
    with pytest.raises(ValueError, match="no frame records"):
        C.history_records(spark.createDataFrame([], "iteration int, frames array<struct<walker:int>>"))
    deltas = spark.createDataFrame([(0, 0, "a"), (2, 1, "b")], "ckpt long, iteration int, entry string")
    chain = spark.createDataFrame([(2, 0), (2, 1), (2, 2)], "ckpt long, required long")
    with pytest.raises(Exception, match="chain is broken: deltas 1 are missing"):
        C.merged(deltas, chain, 2).collect()
    assert C.merged(deltas, chain, 2, ignore_missing=True).count() == 2
    C.write_outcome(spark, f"{tmp_path}/outcome", True, 7, None)
    assert spark.read.json(f"{tmp_path}/outcome").first()["iterations"] == 7


def test_inputs(spark, tmp_path):
    from frameloom.sources import inputs as I

    (tmp_path / "a.json").write_text('[{"start": [1, 2], "end": [3, 4]}]')
    (tmp_path / "b.csv").write_text('start,end\n"1,2","3,4"\n')
    (tmp_path / "c.csv").write_text("start_0,start_1,end_0,end_1\n1,2,3,4\n")
    for name in ("a.json", "b.csv", "c.csv"):
        assert [(r["start"], r["end"]) for r in I.read_pairs(spark, f"{tmp_path}/{name}").collect()] == [([1.0, 2.0], [3.0, 4.0])]
    (tmp_path / "d.json").write_text('[{"start": [1, 2], "end": [3]}]')
    (tmp_path / "e.json").write_text("[]")
    for name, text in (("d.json", "one dimension"), ("e.json", "one at least")):
        with pytest.raises(ValueError, match=text):
            I.read_pairs(spark, f"{tmp_path}/{name}")
    (tmp_path / "run.json").write_text('{"walkers": 3, "topology": "top.pdb", "n_bins": [4], "bounds": [[0, 1]]}')
    c = I.load_campaign(f"{tmp_path}/run.json")
    assert c.walkers == 3 and c.topology == f"{tmp_path}/top.pdb" and c.n_bins == (4,)
    for text in ('{"walker": 3}', '{"walkers": 0}', '{"bounds": [[1, 0], [0, 1]]}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError):
            I.load_campaign(f"{tmp_path}/bad.json")
    frames = spark.createDataFrame([(w, f) for w in range(2) for f in range(3)], "walker int, frame int")
    ask = lambda *xs: spark.createDataFrame(list(enumerate(xs)), "request int, idx long")
    assert [(r["request"], r["walker"], r["frame"]) for r in I.by_index(frames, ask(5, 0, 5)).orderBy("request").collect()] == [(0, 1, 2), (1, 0, 0), (2, 1, 2)]
    for bad in (-1, 6):
        with pytest.raises(Exception, match="outside the frames"):
            I.by_index(frames, ask(bad)).collect()
    with pytest.raises(ValueError):
        I.labels_of_files(spark.createDataFrame([("x",)], "path string"))


def test_criteria(spark):
    from frameloom.operators import criteria as K

    nan = float("nan")
    rows = [(0, [10.0, 5.0], 2.0, [0.5]), (1, [nan], None, None), (2, [10.5, 5.0], 2.05, [0.6]), (3, [10.5], 3.0, [2.0]), (4, [20.0], 3.0, None)]
    s = spark.createDataFrame(rows, "iteration int, timescales array<double>, vamp2 double, errors array<double>")
    one = lambda df: [(r["satisfied"], r["reason"]) for r in df.orderBy("iteration").collect()]
    assert one(K.timescales(s)) == [(False, K.NO_BASE), (False, "no finite timescales"), (True, None), (False, K.NO_BASE), (False, None)]
    assert one(K.score(s)) == [(False, K.NO_BASE), (False, "no VAMP-2 score"), (True, None), (False, None), (True, None)]
    assert one(K.statistical_error(s)) == [(True, None), (False, "no Bayesian errors"), (True, None), (False, None), (False, "no Bayesian errors")]
    pops = spark.createDataFrame([(0, [0.2, 0.8]), (1, [0.79, 0.21]), (2, None), (3, [0.5, 0.5])], "iteration int, populations array<double>")
    assert one(K.populations(pops)) == [(False, K.NO_BASE), (True, None), (False, "no metastable populations"), (False, None)]
    flags = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate([(True, True), (True, True), (False, True), (False, False), (True, True)])], "iteration int, a boolean, b boolean")
    got = lambda mode, n: [(r["streak"], r["converged"]) for r in K.monitor(flags, ["a", "b"], mode, n).orderBy("iteration").collect()]
    assert got("all", 2) == [(1, False), (2, True), (0, True), (0, True), (1, True)] and got("any", 3)[2] == (3, True) and not got("all", 3)[-1][1]
    for bad in (([], "all"), (["a"], "most")):
        with pytest.raises(ValueError):
            K.monitor(flags, *bad)
    kept = K.keep_features(list(range(40)), 5000)
    assert len(kept) == 10 and kept[0] == 0 and kept[-2:] == [38, 39] and kept == sorted(kept) and K.keep_features([1, 2], 9) == [1, 2]


def test_models(spark):
    from frameloom.operators import msm

    c = np.round(spectral.stationary(P3 := np.array([[0.9, 0.1, 0.0], [0.05, 0.9, 0.05], [0.0, 0.2, 0.8]]))[:, None] * P3 * 1e5)
    rows = [(0, i, j, int(c[i, j])) for i in range(3) for j in range(3) if c[i, j]] + [(1, 7, 7, 5)]
    counts = spark.createDataFrame(rows, "iteration int, i long, j long, c long")
    got = {r["iteration"]: r for r in msm.models(counts, "iteration", 1, 2, 2, 50).collect()}
    assert np.allclose(got[0]["pi"], spectral.stationary(P3), atol=1e-3) and len(got[0]["populations"]) == 2 and min(got[0]["errors"]) > 0
    assert got[1]["timescales"] is None and msm.latest(msm.models(counts, "iteration", 1)).first()["iteration"] == 0
    pads = msm.padded(spark.createDataFrame([(0, [1.0, 2.0]), (1, [float("nan")]), (2, None)], "iteration int, timescales array<double>"))
    assert [r["timescales"] for r in pads.orderBy("iteration").collect()] == [[1.0, 2.0], [None, None], [None, None]]
    frames = spark.createDataFrame([(k, s) for k, s in enumerate([0, 0, 1, 2, 9])], "id int, s long")
    w = {r["id"]: (r["active"], r["weight"]) for r in msm.frame_weights(frames, "s", msm.models(counts.where("iteration = 0"), "iteration", 1)).collect()}
    assert w[4] == (-1, 0.0) and w[0] == w[1] and abs(sum(x for _, x in w.values()) - 1) < 1e-9


def test_regular_space_centres(spark):
    df = spark.createDataFrame([(float(x), 0.0) for x in (0, 1, 2, 9, 10, 20)], "x double, y double")
    assert sorted(c[0] for c in binning.regular_centres(df, ["x", "y"], 5.0)) == [0.0, 10.0, 20.0]
    assert len(binning.regular_centres(df, ["x", "y"], 0.5)) == 6 and len(binning.regular_centres(df.limit(0), ["x", "y"], 1.0)) == 0
    with pytest.raises(ValueError, match="2 centres leave points"):
        binning.regular_centres(df, ["x", "y"], 0.5, most=2)


def test_fitted_deviation_is_free_of_rotation(spark):
    from frameloom.functions import geometry as G

    rng = np.random.default_rng(0)
    ref = rng.normal(size=(7, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    df = spark.createDataFrame([(0, (ref @ q + 5).tolist()), (1, (ref * [1, 1, -1]).tolist())], "id int, xyz array<array<double>>")
    got = {r["id"]: r["rmsd"] for r in G.fitted(df, "xyz", ref.tolist()).collect()}
    assert got[0] < 1e-6 < 0.1 < got[1]


def test_whole_tables(spark, duck):
    """Every event gets its stem, and lookups by index reach the last frame."""
    n, last = duck.sql("SELECT count(*), max(user_id) FROM events").fetchall()[0]
    assert QUERIES["safe_stems_all"](spark, SF).count() == n
    rows = {r["request"]: r["walker"] for r in QUERIES["positions_whole_range"](spark, SF).collect()}
    assert len(rows) == 50 and rows[49] == last


def test_lineage_roots_of_all_records(spark):
    up = {r["frame_key"]: r["parent"] for r in QUERIES["frames_view"](spark, SF).collect()}

    def walk(k):
        depth = 0
        while up.get(k) in up:
            k, depth = up[k], depth + 1
        return k, depth

    got = {r["frame_key"]: (r["root"], r["depth"]) for r in QUERIES["lineage_roots_all"](spark, SF).collect()}
    assert len(got) == len(up) == 1000 and got == {k: walk(k) for k in up}
    chain = spark.range(3000).selectExpr("CAST(id AS string) AS frame_key", "CAST(id - 1 AS string) AS parent")
    assert {(int(r["frame_key"]), r["root"], r["depth"]) for r in lineage.ancestors_by_doubling(chain).collect()} == {(k, "0", k) for k in range(3000)}


def test_scale_vectors(spark):
    from frameloom.operators import scaling

    v = np.array([[0.0, 5.0, -1.0], [1.0, 5.0, 2.0], [4.0, 5.0, 2.0], [5.0, 5.0, 2.0], [10.0, 5.0, 2.0], [7.0, 5.0, 2.0]])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(9, None)], "id long, v array<double>")
    got = {r["id"]: r for r in scaling.scale_vectors(df, "v").collect()}
    q1, q2, q3 = np.percentile(v, [25, 50, 75], axis=0)
    one = lambda x: np.where(x > 0, x, 1.0)
    want = {"minmax": (v - v.min(0)) / one(np.ptp(v, 0)), "standard": (v - v.mean(0)) / one(v.std(0)), "robust": (v - q2) / one(q3 - q1)}
    for n, w in want.items():
        assert np.allclose([got[k][n] for k in range(len(v))], w) and got[9][n] is None
    assert QUERIES["scale_all_features"](spark, SF).count() == 64 * spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_history_window(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "iteration int")
    assert [S.last_iterations(df, w).count() for w in (None, 0, 1, 2, 99)] == [5, 0, 1, 2, 5]
    with pytest.raises(ValueError):
        S.last_iterations(df, -1)


def test_box_dimensions():
    with pytest.raises(ValueError):
        X.in_box(["x"], [(0, 1), (0, 1)])


def test_streaming_occupancy(spark, tmp_path):
    from frameloom.streaming.occupancy import first_seen

    rows = [(k % 7, k // 10) for k in range(50)]
    spark.createDataFrame(rows, "cell int, iteration int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell int, iteration int").parquet(str(tmp_path / "in"))
    q = first_seen(stream).writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select cell, iteration from seen").collect()) == [(k, 0) for k in range(7)]


def test_text_folder_is_optional():
    import subprocess
    import sys

    code = "import sys; sys.modules['frameloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)


def test_posterior_errors_have_the_size_of_the_delta_method():
    n0, n1, a, b = 4e5, 2e5, 0.05, 0.1
    counts = np.array([[n0 * (1 - a), n0 * a], [n1 * b, n1 * (1 - b)]])
    size = 1 - a - b
    expected = np.sqrt(a * (1 - a) / n0 + b * (1 - b) / n1) / (size * np.log(size) ** 2)
    assert abs(posterior.bayesian_errors(counts, 1, 2000, 1)[0] / expected - 1) < 0.1


def test_sets_of_too_few_states_are_the_states(spark):
    counts = spark.createDataFrame([(0, 0, 0, 90), (0, 0, 1, 10), (0, 1, 0, 10), (0, 1, 1, 190)], "part int, i long, j long, c long")
    for n in (2, 3):
        assert np.allclose(msm.models(counts, "part", 1, 1, n_metastable=n).first()["populations"], [1 / 3, 2 / 3], atol=1e-6)


def test_feature_choice():
    choice, calls = states.FeatureChoice(["near", "angle"], "near", cadence=3), []

    def scores(**found):
        return lambda: calls.append(1) or found

    assert choice.step(1, scores()) == "near" and choice.selected is None  # nothing could be computed: still due
    assert choice.step(2, scores(near=0.5, angle=0.9, other=2.0)) == "angle"
    choice.columns = [3, 1]
    assert choice.step(4, scores(near=5.0)) == "angle" and len(calls) == 2
    assert choice.step(6, scores(near=0.1, angle=0.2)) == "angle" and choice.columns == [3, 1]
    assert choice.step(9, scores(near=0.3, angle=0.2)) == "near" and choice.columns is None
    assert states.FeatureChoice([], "near").step(0, scores(near=1.0)) == "near"
    cov = {"c00": np.diag([1.0, 2.0, 0.0]), "ctt": np.diag([1.0, 2.0, 0.0]), "c0t": np.diag([0.5, 1.8, 0.0])}
    found = states.type_scores(cov, {"a": [0], "b": [1], "both": [0, 1], "none": []})
    assert np.allclose([found["a"], found["b"], found["both"]], [0.25, 0.81, 1.06]) and "none" not in found


def test_score_of_a_model(spark):
    rng = np.random.default_rng(3)
    slow = np.cumsum(rng.normal(size=400)) * 0.1
    df = spark.createDataFrame([(0, k, [float(slow[k]), float(rng.normal())]) for k in range(400)], "walker int, frame int, v array<double>")
    keep = lambda k: lambda f: f.withColumn("cv", F.array(F.get("v", F.lit(k))))
    assert states.projected_score(df, keep(0), "cv", 1, ["walker"]) > 0.8 > 0.2 > states.projected_score(df, keep(1), "cv", 1, ["walker"])
    assert states.projected_score(df, None, "cv", 1, ["walker"]) is None and states.projected_score(df, keep(0), "cv", 400, ["walker"]) is None


def test_labels_are_refined_until_they_settle(spark):
    df = spark.createDataFrame([(k, float(k % 10), k % 3) for k in range(60)], "frame int, x double, label int")
    fits = []

    def fit(frames, label):
        fits.append(frames.agg(F.countDistinct(label)).first()[0])
        low, high = (4, 9) if len(fits) == 1 else (0, 1)  # the first fit leaves most of its states empty
        return lambda f: f.withColumn("predicted", F.when(F.col("x") < 5, low).otherwise(high))

    got, changes = states.refine(df, "label", fit, lambda f: f.checkpoint())
    assert changes == [1.0, 0.0] and fits == [3, 2]
    assert {(r.x < 5, r.label) for r in got.collect()} == {(True, 0), (False, 1)}
    one, changes = states.refine(df, "label", lambda f, c: lambda g: g.withColumn("predicted", F.lit(1)), lambda f: f.checkpoint())
    assert len(changes) == 1 and {r.label for r in one.collect()} == {0}
    none, changes = states.refine(df.limit(0), "label", fit, lambda f: f.checkpoint())
    assert changes == [] and none.count() == 0
    nulls = states.relabel(spark.createDataFrame([(1, None), (2, 7), (3, 3), (4, 7)], "frame int, p int"), "p")
    assert {(r.frame, r.state) for r in nulls.collect()} == {(1, None), (2, 1), (3, 0), (4, 1)}
    assert {(r.frame, r.target) for r in states.label_pairs(df.withColumn("w", F.lit(0)).where("frame < 5"), "x", "label", 3, ["w"]).collect()} == {(0, 0), (1, 1)}


def test_label_bookkeeping_of_nothing(spark):
    r = states.churn(spark.createDataFrame([], "label int, p int"), "label", "p").first()
    assert r["changed"] is None and r["states"] == 0
