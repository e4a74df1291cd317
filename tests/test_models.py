"""Centres, counts, posteriors and models from features, retraining and lineage by walkers, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import binning, clustering, criteria, ensemble, feature_models, lineage, posterior, sequence, spawning, spectral
from frameloom.scratch import discard, materialize
from frameloom.sources import frames as S

VEC = "id long, v array<double>"


def rows_of(x):
    return [(k, [float(c) for c in r]) for k, r in enumerate(x)]


def test_scratch_tables_are_removed(spark):
    import os

    df = materialize(spark.range(5).toDF("x"), "five")
    path = df._scratch.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    discard(df, spark.range(1))
    assert not os.path.isdir(path)


@pytest.mark.parametrize("d,k", [(1, 1), (1, 50), (2, 400), (3, 70), (40, 90)])
def test_centre_index(d, k):
    rng = np.random.default_rng(d * k)
    c = np.round(rng.normal(size=(k, d)), 1)  # some stand twice
    x = np.concatenate([rng.normal(size=(500, d)), c, np.round(rng.normal(size=(500, d)), 1), np.full((1, d), 1e9)])
    far = np.stack([((x - z) ** 2).sum(axis=1) for z in c], axis=1)
    at, near = clustering.CentreIndex(c).nearest(x)
    assert np.array_equal(at, far.argmin(axis=1)) and np.array_equal(near, far.min(axis=1))
    assert len(clustering.CentreIndex(c).nearest(np.zeros((0, d)))[0]) == 0
    with pytest.raises(ValueError):
        clustering.CentreIndex(np.zeros((0, d)))


def test_many_centres_are_faster_by_the_index():
    import time

    rng = np.random.default_rng(5)
    c, x = rng.normal(size=(1000, 2)), rng.normal(size=(40_000, 2))
    index = clustering.CentreIndex(c)
    began = time.process_time()
    at = index.nearest(x)[0]
    own, began = time.process_time() - began, time.process_time()
    best, plain = np.full(len(x), np.inf), np.zeros(len(x), int)
    for k, z in enumerate(c):
        d = ((x - z) ** 2).sum(axis=1)
        hit = d < best
        best[hit], plain[hit] = d[hit], k
    assert np.array_equal(at, plain) and own * 2 < time.process_time() - began


def test_nearest_centre_by_expression_and_index(spark):
    rng = np.random.default_rng(0)
    pts, c = np.round(rng.normal(size=(300, 2)), 1), np.round(rng.normal(size=(20, 2)), 1)
    df = spark.createDataFrame([(k, *map(float, p), "old") for k, p in enumerate(pts)], "id long, x double, y double, centre string")
    a, b = (sorted(tuple(r) for r in binning.nearest_centre(df, ["x", "y"], c, "centre", "d", few).select("id", "x", "y", "centre", "d").collect()) for few in (32, 0))
    assert a == b and len(a) == 300


def test_kmeans_recovers_clusters_and_keeps_labels(spark):
    rng = np.random.default_rng(1)
    true = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [30, 30]], float)
    x = np.concatenate([t + rng.normal(size=(80, 2)) for t in true])
    df = spark.createDataFrame(rows_of(x), VEC).repartition(3)
    centres, cost, _ = clustering.kmeans(df, "id", "v", 5)
    got = centres[[int(((centres - t) ** 2).sum(axis=1).argmin()) for t in true]]
    assert np.abs(got - true).max() < 0.6 and cost < 2.5 * len(x)
    for r in clustering.cells(df, "v", centres, np.ones(5)).collect():
        assert r["population"] == 80 and np.allclose(x[((x[:, None] - centres) ** 2).sum(2).argmin(1) == r["centre"]].mean(0), r["vector"], atol=0.05)
    again, _, rounds = clustering.kmeans(df, "id", "v", 5, centres + 0.2)
    assert np.abs(again - centres).max() < 0.05 and rounds < 5  # a warm start keeps the numbers
    lonely, _, _ = clustering.kmeans(df, "id", "v", 2, np.array([[5.0, 5.0], [1e6, 1e6]]))
    assert lonely[1].tolist() == [1e6, 1e6]
    assert len(clustering.seed_centres(df.where("id < 3"), "id", "v", 5)) == 3 and len(clustering.seed_centres(df.limit(0), "id", "v", 5)) == 0
    assert len(clustering.seed_centres(spark.createDataFrame([(k, [1.0]) for k in range(9)], VEC), "id", "v", 3)) == 1
    with pytest.raises(RuntimeError, match="still moved"):
        clustering.kmeans(df, "id", "v", 5, x[:5], rounds=1)
    with pytest.raises(ValueError):
        clustering.kmeans(df.limit(0), "id", "v", 5)


def test_seeded_centres_settle_in_few_rounds(spark):
    n = 40_000
    df = spark.range(n).select(((F.col("id") * 7919) % 104_729).cast("double").alias("x"), (F.col("id") % 50).cast("double").alias("y"))
    c = binning.lloyd(df, ["x", "y"], 20, rounds=10)
    x = np.array([[k * 7919 % 104_729, k % 50] for k in range(n)], float)
    at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    off = [np.abs(x[at == k].mean(0) - c[k]) for k in range(20)]
    assert len(c) == 20 and np.max(off) < 50  # a centre has some 5000 for itself
    wild = np.concatenate([x[:300], [[1e12, 0.0]]])
    means, held = clustering.cell_means(spark.createDataFrame(rows_of(wild), VEC), "v")
    assert held.sum() == 301 and np.allclose(held @ means, wild.sum(0)) and len(means) > 50  # an outlier spoils no cell but its own
    wide = np.random.default_rng(0).normal(size=(3000, 40))
    means, held = clustering.cell_means(spark.createDataFrame(rows_of(wide), VEC), "v", bits=6)
    assert held.sum() == 3000 and np.allclose(held @ means, wide.sum(0)) and 32 < len(means) <= 64
    assert clustering.seeded(spark.createDataFrame([(k, [1.0]) for k in range(9)], VEC), "v", 1) is None


def test_cells_have_their_points_means(spark):
    x = np.random.default_rng(8).normal(size=(200, 2))
    c = np.array([[-1.0, 0.0], [1.0, 0.0], [50.0, 50.0]])
    at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    rows = {r["centre"]: r for r in clustering.cells(spark.createDataFrame(rows_of(x), VEC), "v", c).collect()}
    assert all(rows[k]["population"] == (at == k).sum() and np.allclose(rows[k]["mean"], x[at == k].mean(0)) for k in (0, 1))
    assert rows[2]["population"] == 0 and rows[2]["mean"] is None and rows[2]["area"] is None


def test_models_of_unsettled_centres_follow_the_sql(spark, tmp_path):
    import duckdb

    from frameloom.plans.queries import ORACLE_SQL, QUERIES

    x = np.random.default_rng(1).normal(size=(800, 2))  # the second and fourth fit take 22 and 18 rounds to settle
    spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["msm_from_features"](spark, str(tmp_path)).collect())
    assert len(got) == 4 and got == sorted(con.sql(ORACLE_SQL["msm_from_features"]).fetchall())


def test_centres_after_exactly_so_many_rounds(spark):
    x = np.random.default_rng(3).normal(size=(300, 2))
    start = np.array([[-0.1, 0.0], [0.1, 0.0]])
    df, c = spark.createDataFrame(rows_of(x), VEC), start
    for _ in range(3):
        at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([x[at == k].mean(0) for k in (0, 1)])
    got, cost, rounds = clustering.kmeans(df, "id", "v", 2, start, exactly=3)
    assert np.allclose(got, c) and rounds == 3 and np.isclose(cost, ((x[:, None] - c) ** 2).sum(2).min(1).sum())


def test_regular_centres_cover_all_points(spark):
    x = np.random.default_rng(2).uniform(0, 10, size=(200, 2))
    c = clustering.regular_centres(spark.createDataFrame(rows_of(x), VEC), "id", "v", 2.0)
    far = np.sqrt(((x[:, None] - c) ** 2).sum(2))
    between = np.sqrt(((c[:, None] - c) ** 2).sum(2)) + 9 * np.eye(len(c))
    assert c[0].tolist() == x[0].tolist() and far.min(axis=1).max() < 2 <= between.min()


def plain_effective(runs, lag):
    """runs: state sequences; the definition of effective_counts, pair by pair."""
    out = {}
    pairs = [(a, b) for r in runs for a, b in zip(r[:-lag], r[lag:], strict=True)]
    for i in {a for a, _ in pairs}:
        visits = [[b for a, b in zip(r[:-lag], r[lag:], strict=True) if a == i] for r in runs]
        n = sum(map(len, visits))
        for j in {b for v in visits for b in v}:
            a = [np.array([b == j for b in v], float) for v in visits]
            c = sum(x.sum() for x in a)
            p, g = c / n, 1.0
            for k in range(1, max(map(len, a))):
                m = sum(max(0, len(x) - k) for x in a)
                first, second = (np.concatenate([y for x in a if len(x) > k for y in [cut(x)]]) for cut in (lambda x, k=k: x[:-k], lambda x, k=k: x[k:]))
                rho = ((first * second).mean() - first.mean() * second.mean()) / (p - p * p) if p < 1 else -1
                if rho <= 1e-15:
                    break
                g += 2 * rho * m / n
            out[i, j] = (int(c), g)
    return out


def test_effective_counts(spark):
    rng = np.random.default_rng(4)
    runs = []
    for n in (400, 90, 3, 1, 2):
        s = [0]
        for _ in range(n - 1):
            s.append(len(s) // 40 % 2 if rng.random() < 0.8 else int(rng.integers(0, 3)))  # not Markovian
        runs.append(s)
    df = spark.createDataFrame([(w, f, s) for w, r in enumerate(runs) for f, s in enumerate(r)], "walker int, frame int, state int")
    for lag, span in ((1, 4), (1, 200), (3, 7)):
        got = {(r["i"], r["j"]): (r["c"], r["g"], r["effective"]) for r in feature_models.effective_counts(df, "state", lag, ["walker"], span=span).collect()}
        want = plain_effective(runs, lag)
        assert set(got) == set(want)
        for pair, (c, g) in want.items():
            assert got[pair][0] == c and abs(got[pair][1] - g) < 1e-9 and got[pair][2] <= c and abs(got[pair][2] - c / g) < 1e-9
        assert max(g for _, g in want.values()) > 3
    flat = spark.createDataFrame([(0, f, 7) for f in range(20)], "walker int, frame int, state int")
    assert [tuple(r) for r in feature_models.effective_counts(flat, "state", 1, ["walker"]).collect()] == [(7, 7, 19, 1.0, 19.0)]
    assert feature_models.effective_counts(flat.limit(1), "state", 1, ["walker"]).count() == 0


def test_posterior_of_two_states_is_beta():
    c = np.array([[30.0, 12.0], [5.0, 50.0]])
    found = np.array([(1 - m[0, 0], 1 - m[1, 1]) for m in posterior.reversible_samples(c, 3000, every=1, seed=2)])
    for k, (go, stay) in enumerate(((12, 30), (5, 50))):
        n = go + stay
        mean, sd = go / n, np.sqrt(go * stay / (n * n * (n + 1)))
        assert abs(found[:, k].mean() - mean) < 5 * sd / np.sqrt(3000) and abs(found[:, k].std() / sd - 1) < 0.1


def test_posterior_samples_are_reversible_and_narrow_with_counts():
    p = np.array([[0.9, 0.1, 0.0, 0.0], [0.05, 0.85, 0.1, 0.0], [0.0, 0.1, 0.8, 0.1], [0.0, 0.0, 0.3, 0.7]])
    pi = spectral.stationary(p)
    for size, off in ((1e3, 0.1), (1e6, 0.004)):
        c = np.round(pi[:, None] * p * size)
        found = list(posterior.reversible_samples(c, 200, every=3))
        for m in found:
            w = spectral.stationary(m)
            flow = w[:, None] * m
            assert np.allclose(flow, flow.T, atol=1e-12) and np.allclose(m.sum(1), 1) and not m[p == 0].any()
        assert np.abs(np.mean(found, axis=0) - p).max() < off
    assert sorted(e for g in posterior.matchings(np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3])) for e in g.tolist()) == [0, 1, 2, 3]


def chain(p, n, rng):
    s = [0]
    for _ in range(n - 1):
        s.append(int(rng.choice(len(p), p=p[s[-1]])))
    return s


def test_three_states_from_features(spark):
    """Three wells, jumps between them: the states, their weights and the slowest timescale come back."""
    rng = np.random.default_rng(6)
    p = np.array([[0.95, 0.05, 0.0], [0.04, 0.92, 0.04], [0.0, 0.1, 0.9]])
    wells = np.array([[0.0, 0.0], [5.0, 0.0], [5.0, 5.0]])
    rows, n = [], 0
    for walker in range(12):
        for f, s in enumerate(chain(p, 500, rng)):
            rows.append((walker // 4, walker, f, n, [float(x) for x in wells[s] + rng.normal(size=2) * 0.5]))
            n += 1
    df = spark.createDataFrame(rows, "iteration int, walker int, frame int, frame_id long, v array<double>")
    m = feature_models.models_by_iteration(df, "v", 1, 3, ["walker"], counting="effective", samples=60, n_metastable=3)
    got = {r["iteration"]: r for r in m.collect()}
    assert sorted(got) == [0, 1, 2] and [got[k]["frames"] for k in range(3)] == [2000, 4000, 6000] and not any(r["reason"] for r in got.values())
    last, before = got[2], got[1]
    assert sum(last["sizes"]) == 6000 and np.abs(np.array(last["centres"]) - np.array(before["centres"])).max() < 0.2  # labels stay
    at = [int(((np.array(last["centres"]) - w) ** 2).sum(1).argmin()) for w in wells]
    assert np.allclose(np.array(last["pi"])[at], spectral.stationary(p), atol=0.08)
    slow = -1 / np.log(np.sort(np.abs(np.linalg.eigvals(p)))[1])
    assert 0.6 < last["timescales"][0] / slow < 1.6 and 0 < last["errors"][0] < last["timescales"][0]


def test_iterations_without_a_model_leave_a_reason(spark):
    rows = [(k // 10, k // 5, k, k, [float(k % 2 * (k >= 20))]) for k in range(60)]
    df = spark.createDataFrame(rows, "iteration int, walker int, frame int, frame_id long, v array<double>")
    build = lambda **o: {r["iteration"]: (r["frames"], r["reason"], r["timescales"] is not None) for r in feature_models.models_by_iteration(df, "v", 1, 2, ["walker"], **o).collect()}
    got = build(cadence=2, min_frames=15)
    assert got == {0: (10, "fewer than 15 frames", False), 2: (30, None, True), 4: (50, None, True)}
    assert build()[0] == (10, "fewer than two connected states", False)
    assert feature_models.models_by_iteration(df, "v", 9, 2, ["walker"]).where("reason = 'no two frames are a lag apart'").count() == 6
    assert feature_models.models_by_iteration(df.limit(0), "v", 1, 2, ["walker"]).count() == 0
    broken = df.withColumn("v", F.when(F.col("frame_id") == 25, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("v")))
    reasons = [r["reason"] for r in feature_models.models_by_iteration(broken, "v", 1, 2, ["walker"]).orderBy("iteration").collect()]
    assert reasons[1] == "fewer than two connected states" and all(reasons[2:])  # a vector of another length: no exception
    with pytest.raises(ValueError):
        build(counting="other")


def test_retraining(spark):
    its = spark.createDataFrame([(k, k != 2) for k in range(7)], "iteration int, has_model boolean")
    trained = lambda df: [r["iteration"] for r in df.where("trained").orderBy("iteration").collect()]
    assert trained(criteria.retrained_every(its, 3)) == [0, 3, 6] and trained(criteria.retrained_every(its, 0)) == []
    assert trained(criteria.retrained_every(its, 3, "has_model")) == [0, 2, 3, 6]
    rows = [(0, None, 2.0), (1, 1.0, 9.0), (2, 1.0, 1.0), (3, 1.0, 1.5), (4, 1.95, None), (5, 1.95, None), (6, None, None), (7, 1.7, 3.0), (8, 1.0, 1.0), (9, 2.95, 1.0), (10, 2.95, 1.0), (11, 2.95, 1.0), (12, 2.95, 1.0), (13, 2.95, 1.0)]
    s = spark.createDataFrame(rows, "iteration int, score double, trained_score double")
    got = criteria.retrained_on_decline(s, 0.1, least=2, most=4).orderBy("iteration").collect()
    # 0: no model; 1, 2 too early; 3: 1.0 under 2.0 - 10 %; best stays 2.0; 7: 1.7 under 1.8; then best 3.0: 9 has waited 1, 12: 4 rows
    assert [r["iteration"] for r in got if r["trained"]] == [0, 3, 7, 12] and [r["best"] for r in got][-1] == 3.0
    assert [r["waited"] for r in got][:5] == [0, 1, 2, 0, 1]
    assert criteria.retrained_on_decline(s.limit(0)).count() == 0


def test_paths_by_walkers(spark):
    sizes = {0: 5, 1: 4, 2: 6, 3: 2, 4: 3, 6: 7, 7: 1, 9: 2}
    f = spark.createDataFrame([(w % 3, w, k) for w, n in sizes.items() for k in range(n)], "iteration int, walker long, frame long")
    births = S.walker_births(f)
    up = {r["frame_key"]: r["parent"] for r in S.with_lineage(f).collect()}
    keyed = S.with_lineage(f).select("walker", "frame", "frame_key")

    def walk(k):
        out = [k]
        while up.get(k) in up:
            out.append(k := up[k])
        return out

    key = lambda w, k: f"{w % 3}:{w}:{k}"
    starts = [(7, 0), (6, 5), (0, 0), (4, 2), (9, 1), (99, 0)]
    for (w, k), path in zip(starts, lineage.walker_paths(births, starts), strict=True):
        got = [r["frame_key"] for r in lineage.path_frames(keyed, path).orderBy("depth").collect()]
        assert got == (walk(key(w, k)) if w in sizes else [])
    for a, b in (((7, 0), (6, 5)), ((4, 2), (2, 5)), ((0, 1), (7, 0)), ((3, 1), (3, 1)), ((9, 1), (6, 0))):
        got = [r["frame_key"] for r in lineage.walker_path(keyed, births, a, b).orderBy("step").collect()]
        one, other = walk(key(*a)), walk(key(*b))
        common = next(x for x in one if x in other)
        assert got == one[: one.index(common) + 1] + other[: other.index(common)][::-1]
        assert got == [r["frame_key"] for r in lineage.connected_path(S.with_lineage(f), key(*a), key(*b)).orderBy("step").collect()]
    apart = spark.createDataFrame([(1, None, None), (2, None, None), (3, 4, 0), (4, 3, 0)], "walker long, parent_walker long, parent_frame long")
    with pytest.raises(ValueError, match="no shared ancestor"):
        lineage.walker_path(keyed, apart, (1, 0), (2, 0))
    with pytest.raises(ValueError, match="cycle"):
        lineage.walker_paths(apart, [(3, 0)])


def test_least_counts_of_fresh_centres(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(90, 2)), rng.normal(size=(10, 2)) + 20])
    got = spawning.least_counts_of(spark.createDataFrame(rows_of(x), VEC), "id", "v", 2).collect()
    by = {s: [r["weight"] for r in got if r["state"] == s] for s in {r["state"] for r in got}}
    assert sorted(map(len, by.values())) == [10, 90] and all(abs(sum(w) - 1 / len(w)) < 1e-12 for w in by.values())


def test_states_that_nothing_leaves_keep_themselves(spark):
    counts = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (2, 0, 5)], "i long, j long, c long")
    got = {(r["i"], r["j"]): (r["n"], r["p"]) for r in sequence.transition_matrix(counts, states=spark.range(4).toDF("i")).collect()}
    assert got == {(0, 0): (4, 0.75), (0, 1): (4, 0.25), (2, 0): (5, 1.0), (1, 1): (0, 1.0), (3, 3): (0, 1.0)}
    assert sequence.transition_matrix(counts).count() == 3


def test_endpoints_of_uneven_walkers(spark):
    f = spark.createDataFrame([(w, k, 10.0 * w + k) for w in range(3) for k in range(4)], "walker int, frame int, x double")
    assert {(r["walker"], r["x"]) for r in ensemble.endpoints(f, ["x"], even=True).collect()} == {(0, 3.0), (1, 13.0), (2, 23.0)}
    ragged = f.where("walker < 2 OR frame < 2")
    assert ensemble.endpoints(ragged, ["x"]).count() == 3 and ensemble.endpoints(f.limit(0), ["x"], even=True).count() == 0
    with pytest.raises(Exception, match="walkers have from 2 to 4 frames"):
        ensemble.endpoints(ragged, ["x"], even=True).collect()
