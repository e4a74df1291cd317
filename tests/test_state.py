"""Stored state, ensembles, neighbours, connected sets, quantiles, predictors and geometry against plain versions."""

import os
import shutil
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import expressions as X
from frameloom.functions import geometry as G
from frameloom.operators import binning, components, ensemble, neighbours, predictor, scaling, spawning, states
from frameloom.operators.ensemble_table import EnsembleTable
from frameloom.sources import checkpoints as C
from frameloom.sources import frames as S


# ---- checkpoints --------------------------------------------------------------------------------------------------


def history(spark, top=100):
    return spark.range(top).select((F.col("id") % 10).cast("int").alias("iteration"), F.col("id").alias("walker"), (F.col("id") * 0.5).alias("x"), F.array("id").alias("v")).repartition(4)


def values(df):
    return sorted(tuple(r) for r in df.select("iteration", "walker", "x", "v").collect())


def test_a_lost_or_changed_part_file_is_an_error(spark, tmp_path):
    store = C.Checkpoints(spark, f"file://{tmp_path}/run")
    store.save(4, history(spark))
    store.save(9, history(spark))
    assert values(store.load()) == values(history(spark))
    parts = sorted(glob(f"{tmp_path}/run/history/ckpt=4/try=*/part-*.parquet"))
    assert len(parts) > 1
    kept = open(parts[0], "rb").read()
    os.remove(parts[0])
    with pytest.raises(C.BrokenChain, match="delta 4, which has .* rows of 50"):
        store.load()
    with pytest.warns(UserWarning, match="incomplete"):
        assert values(store.load(ignore_missing=True)) == values(history(spark).where("iteration > 4"))
    open(parts[0], "wb").write(kept)
    assert store.load().count() == 100
    folder = os.path.dirname(parts[0])
    shutil.rmtree(folder)
    history(spark).where("iteration <= 4").withColumn("x", F.col("x") + F.when(F.col("walker") == 13, 1).otherwise(0)).write.parquet(f"file://{folder}")
    with pytest.raises(C.BrokenChain, match="other rows than were written"):
        store.load()
    shutil.rmtree(folder)
    with pytest.raises(C.BrokenChain, match="can't be read"):
        store.load()


def test_a_crash_between_steps_leaves_what_was_there(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/run"
    store = C.Checkpoints(spark, f"file://{root}")
    store.save(4, history(spark, 50), {"n": 1})
    store.save(9, history(spark, 50), {"n": 2})
    before = values(store.load())
    figures = C.Checkpoints._figures

    def crash(*a):
        raise KeyboardInterrupt

    for at, top in ((4, 70), (9, 70), (12, 70)):  # history and state are written, the manifest isn't
        monkeypatch.setattr(C.Checkpoints, "_figures", crash)
        with pytest.raises(KeyboardInterrupt):
            store.save(at, history(spark, top), {"n": 3})
        monkeypatch.setattr(C.Checkpoints, "_figures", figures)
        assert store.complete() == [4, 9] and values(store.load()) == before and store.state() == {"n": 2}
    store.save(4, history(spark, 70), {"n": 4})  # replaced: 9 goes on resting on what 4 was
    assert values(store.load(4)) == values(history(spark, 70).where("iteration <= 4")) and values(store.load(9)) == before
    assert store.state(4) == {"n": 4} and len(os.listdir(f"{root}/history/ckpt=4")) == 2 and len(os.listdir(f"{root}/manifest/ckpt=4")) == 1
    store.save(9, history(spark, 70), {"n": 5})
    assert values(store.load()) == values(history(spark, 70)) and store.state() == {"n": 5}
    old = os.path.join(f"{root}/manifest/ckpt=9", os.listdir(f"{root}/manifest/ckpt=9")[0])
    assert len(os.listdir(f"{root}/manifest/ckpt=9")) == 1 and os.path.isdir(old)


def test_log_checks_every_row(spark):
    log = spark.createDataFrame([(0, 5, 5, 0), (1, 4, 8, 1), (2, 1, 10, 0)], "iteration int, frames_this_iteration int, cumulative_frames int, failed_walkers int")
    r = C.check_log(log).first()
    assert (r["iterations"], r["failed"], r["gapless"], r["adds_up"], r["first_off"]) == (3, 1, True, False, 1)
    assert C.check_log(log.where("iteration = 0")).first()["adds_up"]


def test_history_by_dimension_and_projected_anew(spark, tmp_path):
    rows = [(0, 1, [1.0], 1), (1, 1, [2.0], 2), (2, 1, None, 2), (2, 2, [4.0], 2), (3, 1, [5.0], 2)]
    df = spark.createDataFrame(rows, "iteration int, walker int, features array<double>, cv_dim int")
    df.write.partitionBy("iteration").parquet(f"file://{tmp_path}/h")
    read = lambda *a: sorted((r["iteration"], r["walker"]) for r in S.read_history(spark, f"file://{tmp_path}/h", *a).collect())
    assert read() == [(0, 1), (1, 1), (2, 1), (2, 2), (3, 1)] and read(2) == [(1, 1), (2, 1), (2, 2), (3, 1)] and read(2, 2) == [(2, 1), (2, 2), (3, 1)]
    new = C.reproject(df.withColumn("cv", F.array(F.lit(0.0))), lambda f: f.withColumn("cv", F.concat("features", "features")), 7)
    assert sorted((r["iteration"], r["cv"], r["cv_dim"], r["space_version"]) for r in new.collect()) == [(0, [1.0, 1.0], 2, 7), (1, [2.0, 2.0], 2, 7), (3, [5.0, 5.0], 2, 7)]


def test_safe_divide(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -1e-15), (None, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(X.safe_divide(F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 1e12, -1e12, None]  # a divisor near 0 is held off it, by its sign


# ---- the ensemble -------------------------------------------------------------------------------------------------


def test_ensemble_table(spark, tmp_path):
    rng = np.random.default_rng(0)
    cells = lambda df: binning.uniform_cells(df, ["x"], [5], {"x": (0.0, 10.0)})
    opened = lambda name="a": EnsembleTable(spark, f"file://{tmp_path}/{name}", ["x"], cells, [(9.0, float("inf"))], seed=5)
    ends = [spark.createDataFrame([(w, float(x)) for w, x in enumerate(rng.uniform(0, 10, size=12))], "walker long, x double") for _ in range(4)]
    weights = {k: 1 / 12 for k in range(12)}
    flux = []
    for b in range(3):
        table = opened()  # a restart before each batch
        got = {r["slot"]: r for r in table.step(b, ends[b], [0.5]).collect()}
        where = {r["walker"]: r["x"] for r in ends[b].collect()}
        home = {w: 0.5 if x >= 9 else x for w, x in where.items()}
        flux.append(sum(weights[w] for w, x in where.items() if x >= 9))
        cell = {w: min(int(x // 2), 4) for w, x in home.items()}
        assert len(got) == 12 and abs(sum(r["weight"] for r in got.values()) - 1) < 1e-9
        for c in set(cell.values()):
            own = [r for r in got.values() if r["cell"] == c]
            assert abs(sum(r["weight"] for r in own) - sum(weights[w] for w in cell if cell[w] == c)) < 1e-12
            assert all(cell[r["walker"]] == c and r["parent"] == (-1 if where[r["walker"]] >= 9 else r["walker"]) for r in own)
        weights = {k: r["weight"] for k, r in got.items()}
    log = {r["iteration"]: r for r in opened().log().collect()}
    assert [round(log[b]["flux"], 12) for b in range(3)] == [round(f, 12) for f in flux] and sum(flux) > 0 and log[2]["basis"] == [0.5]
    shutil.rmtree(f"{tmp_path}/a/log/iteration=2")  # a crash before the log: the batch is done again, alike
    last = sorted(tuple(r) for r in opened().slots(2).collect())
    assert sorted(tuple(r) for r in opened().step(2, ends[2], [3.0]).collect()) == last
    assert sorted(tuple(r) for r in opened().step(2, ends[3]).collect()) == last  # given twice
    left = opened().step(3, ends[3].where("walker < 9"))  # three walkers are lost
    assert left.count() == 9 and abs(left.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    with pytest.raises(ValueError, match="comes after"):
        shutil.rmtree(f"{tmp_path}/a/log/iteration=1")
        opened().step(1, ends[1])
    with pytest.raises(ValueError, match="basis"):
        opened("b").step(0, ends[0])
    free = EnsembleTable(spark, f"file://{tmp_path}/c", ["x"], cells).step(0, ends[0], budget=20)
    assert free.count() == 20 and free.where("parent < 0").count() == 0
    with pytest.raises(Exception, match="more occupied bins"):
        EnsembleTable(spark, f"file://{tmp_path}/d", ["x"], cells).step(0, ends[0], budget=1)
    assert ensemble.effective_size(left).first()["ess"] > 1


# ---- neighbours ---------------------------------------------------------------------------------------------------


def plain_neighbours(ids, x, k):
    out = set()
    for i, a in zip(ids, x, strict=True):
        d = ((x - a) ** 2).sum(axis=1)
        order = sorted((e, j) for e, j in zip(d.tolist(), ids, strict=True) if j != i)[:k]
        out |= {(i, j, e, r + 1) for r, (e, j) in enumerate(order)}
    return out


@pytest.mark.parametrize("pivots,block", [(None, 512), (1, 7), (40, 16)])
def test_neighbours_by_cells(spark, pivots, block):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.round(rng.normal(size=(150, 3)), 1), np.zeros((60, 3)), rng.normal(size=(40, 3)) + 30, [[1e3, 0, 0]]])
    ids = rng.permutation(1000)[: len(x)].tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
    got, report = neighbours.nearest_neighbours(df, "id", "v", 6, pivots, block)
    assert {tuple(r) for r in got.select("id", "neighbour", "d2", "rank").collect()} == plain_neighbours(ids, x, 6)
    r = report.agg(F.sum("queries"), F.sum("pairs"), F.sum("met"), F.count("*")).first()
    distinct = len(np.unique(x, axis=0))
    assert r[0] == distinct and r[1] <= distinct**2 and r[2] <= r[3] ** 2
    if pivots == 40:
        assert r[1] < 0.8 * distinct**2 and r[2] < 0.9 * r[3] ** 2  # partitions are skipped


def test_neighbours_of_few_points(spark):
    near = lambda rows, k: {tuple(r) for r in neighbours.nearest_neighbours(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", k)[0].select("id", "neighbour", "rank").collect()}
    assert near([], 3) == set() and near([(1, [0.0])], 3) == set()
    assert near([(1, [0.0]), (2, [5.0])], 3) == {(1, 2, 1), (2, 1, 1)}
    assert near([(k, [1.0]) for k in range(50)], 2) == {(k, j, r + 1) for k in range(50) for r, j in enumerate([i for i in (0, 1, 2) if i != k][:2])}
    df = spark.createDataFrame([(k, [float(k % 7), float(k % 5)]) for k in range(80)], "id long, v array<double>")
    one, other = ({tuple(r) for r in spawning.knn(df, "id", "v", 4, broadcast_bytes=b).select("id", "neighbour", "d2", "rank").collect()} for b in (0, 1 << 20))
    assert one == other and len(one) == 320


# ---- connected sets -----------------------------------------------------------------------------------------------


def plain_components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    while True:
        new = {n: reach[n].union(*(reach[j] for i, j in edges if i in reach[n])) for n in nodes}
        if new == reach:
            return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
        reach = new


def test_strong_components(spark):
    rng = np.random.default_rng(8)
    frames = lambda e: spark.createDataFrame(e, "i long, j long")
    found = lambda e: {r["node"]: r["component"] for r in components.strong_components(frames(e)).collect()}
    for n, m in ((30, 35), (30, 60)):
        edges = [tuple(map(int, e)) for e in rng.integers(0, n, size=(m, 2))]
        assert found(edges) == plain_components(set(edges))
    ring = [(k, (k + 1) % 9) for k in range(9)] + [(3, 20), (20, 21), (21, 22), (22, 20), (30, 30), (40, 41)]
    assert found(ring) == {**dict.fromkeys(range(9), 0), **dict.fromkeys((20, 21, 22), 20), 30: 30, 40: 40, 41: 41}
    assert found([]) == {}
    counts = spark.createDataFrame([(i, j, 2) for i, j in ring] + [(50, 51, 7), (51, 50, 7)], "i long, j long, c long")
    assert {(r["i"], r["j"]) for r in components.largest(counts).collect()} == {(k, (k + 1) % 9) for k in range(9)}


# ---- quantiles ----------------------------------------------------------------------------------------------------


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    columns = [rng.normal(size=401), np.round(rng.normal(size=401)), np.full(401, -0.0), np.where(rng.random(401) < 0.9, 7.0, rng.normal(size=401) * 1e300), np.arange(401) * 5e-324, rng.choice([-1e-310, 0.0, 3.5], 401)]
    x = np.stack(columns, axis=1)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    assert np.array_equal(scaling.exact_quantiles(df, "v", shares), np.percentile(x, [100 * q for q in shares], axis=0).T)
    few, scaling.FEW = scaling.FEW, 0  # every bit is counted
    assert np.array_equal(scaling.exact_quantiles(df, "v", shares), np.percentile(x, [100 * q for q in shares], axis=0).T)
    scaling.FEW = few
    odd = spark.createDataFrame([([1.0, None],), ([2.0, None, 5.0],), (None,), ([],), ([float("nan"), None],), ([4.0],)], "v array<double>")
    got = scaling.exact_quantiles(odd, "v", [0.5])
    assert got[0, 0] == 2.0 and np.isnan(got[1, 0]) and got[2, 0] == 5.0
    assert scaling.exact_quantiles(odd.where("false"), "v", [0.5]).shape[0] == 0


# ---- predictors ---------------------------------------------------------------------------------------------------


def test_gradient_of_the_predictor():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    make = lambda w: predictor.Logistic((0, 1, 2), w, x.mean(0), x.std(0))
    w = rng.normal(size=(3, 4))
    _, g = predictor.sums(make(w), x, y)
    for k in range(3):
        for d in range(4):
            e = np.zeros((3, 4))
            e[k, d] = 1e-6
            assert abs((predictor.sums(make(w + e), x, y)[0] - predictor.sums(make(w - e), x, y)[0]) / 2e-6 - g[k, d]) < 1e-3


def test_predictor_recovers_planted_states(spark):
    rng = np.random.default_rng(4)
    rows, state = [], 0
    for f in range(600):
        if rng.random() < 0.05:
            state = int(rng.integers(0, 3))
        x = np.array([[0, 0], [4, 0], [0, 4]], float)[state] + rng.normal(size=2) * 0.5
        rows.append((f // 300, f, [float(c) for c in x], state, state if rng.random() < 0.8 else int(rng.integers(0, 3))))
    df = spark.createDataFrame(rows, "walker int, frame int, v array<double>, truth int, label int").withColumn("label", F.col("label").cast("long"))
    got, changes = states.refine(df, "label", predictor.lagged_fit("v", 1, ["walker"]), lambda f: f.checkpoint(), rounds=4)
    assert got.where("label = truth").count() > 0.97 * 600 and changes[-1] < 0.02 < changes[0]
    model = predictor.fit(df, "v", "truth")
    assert model.classes == (0, 1, 2) and predictor.predict(df, "v", model).where("predicted = truth").count() > 590
    nulls = spark.createDataFrame([(None, None), ([0.0, 0.0], None)], "v array<double>, truth int")
    assert [r["predicted"] for r in predictor.predict(nulls, "v", model).collect()] == [None, 0]
    named = df.withColumn("name", F.concat(F.lit("s"), "truth"))
    assert predictor.predict(named, "v", predictor.fit(named, "v", "name")).where("predicted = name").count() > 590
    one = predictor.fit(df.withColumn("truth", F.lit(5)), "v", "truth")
    assert predictor.predict(df, "v", one).where("predicted = 5").count() == 600
    with pytest.raises(ValueError, match="no labelled rows"):
        predictor.fit(nulls, "v", "truth")


# ---- geometry -----------------------------------------------------------------------------------------------------


def turn(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def test_superposed_coordinates_are_free_of_rotation(spark):
    rng = np.random.default_rng(0)
    shape = rng.normal(size=(9, 3))
    x = [shape, shape @ turn(rng) + 7, shape * [1, 1, -1], (shape + 0.1 * rng.normal(size=(9, 3))) @ turn(rng) - 3]
    df = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(x)] + [(9, None)], "id int, xyz array<array<double>>")
    got = {r["id"]: r["fitted"] for r in G.superposed(df, "xyz", shape.tolist()).collect()}
    assert got[9] is None and np.allclose(got[0], shape) and np.allclose(got[1], shape) and np.abs(np.array(got[2]) - shape).max() > 0.1
    again = spark.createDataFrame([(0, (np.array(got[3]) @ turn(rng) + 5).tolist())], "id int, xyz array<array<double>>")
    assert np.allclose(G.superposed(again, "xyz", shape.tolist()).first()["fitted"], got[3])
    dev = {r["id"]: r["rmsd"] for r in G.fitted(df.where("id < 9"), "xyz", shape.tolist()).collect()}
    for k in range(4):
        assert abs(np.sqrt(((np.array(got[k]) - shape) ** 2).sum() / 9) - dev[k]) < 1e-6
    part = {r["id"]: r["fitted"] for r in G.superposed(df, "xyz", shape[[0, 2, 5, 7]].tolist(), atoms=[0, 2, 5, 7]).collect()}
    assert np.allclose(part[1], shape)


def plain_torsion(a, b, c, d):
    u, v, w = b - a, c - b, d - c
    n, m = np.cross(u, v), np.cross(v, w)
    return np.degrees(np.arctan2(np.dot(np.cross(n, m), v) / np.linalg.norm(v), np.dot(n, m)))


def test_backbone_torsions(spark):
    rng = np.random.default_rng(5)
    rows, at = [], {}
    for frame in range(3):
        for res in (1, 2, 3, 5, 6):  # 4 is missing
            for name in ("N", "CA", "C", "CB"):
                if (res, name) != (6, "C"):
                    p = rng.normal(size=3)
                    at[frame, res, name] = p
                    rows.append((frame, res, name, *map(float, p)))
    df = spark.createDataFrame(rows, "frame int, residue int, name string, x double, y double, z double").repartition(3)
    got = {(r["frame"], r["residue"]): (r["phi"], r["psi"]) for r in G.backbone_torsions(df, ["frame"]).collect()}
    assert len(got) == 15
    for (f, r), (phi, psi) in got.items():
        for found, four in ((phi, [(r - 1, "C"), (r, "N"), (r, "CA"), (r, "C")]), (psi, [(r, "N"), (r, "CA"), (r, "C"), (r + 1, "N")])):
            if all((f, *x) in at for x in four):
                assert abs(found - plain_torsion(*(at[f, *x] for x in four))) < 1e-9
            else:
                assert found is None
    assert sum(p is not None for p, _ in got.values()) == 6 and sum(p is not None for _, p in got.values()) == 9
