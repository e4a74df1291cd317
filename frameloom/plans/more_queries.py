"""Queries on selections, criteria, stored state, geometry and inputs, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import geometry as G
from ..operators import binning, criteria, msm, sequence, spawning, spectral, states
from ..scratch import scratch_dir
from ..sources import checkpoints as C
from ..sources import frames as S
from ..sources import inputs
from .queries import _CELL, _ECELL, _FR, _KNN, _SERIES, _TWO, BOUNDS, EDGES, SHAPE, _features, _model_series, _rounded, _sc, _two, ev, ev_cells, li, query


def _scratch(spark, name: str) -> str:
    import uuid

    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- selections ---------------------------------------------------------------------------------------------------


@query("centre population weight", f"SELECT centre, population, {_sc('area / population / (SELECT sum(area / population) FROM p JOIN a USING (centre))', 9)} AS weight FROM p JOIN a USING (centre)", _FR + ", p AS (SELECT CASE WHEN x <= 150 THEN 0 WHEN x <= 300 THEN 1 ELSE 2 END AS centre, count(*) AS population FROM fr GROUP BY 1), a AS (SELECT * FROM (VALUES (0, 15000.0::DOUBLE), (1, 15000.0), (2, 20000.0)) v(centre, area))")
def voronoi_weights(spark, d):
    """Three centres on a line: their cells are upright strips of the box."""
    c = np.array([[100.0, 50.0], [200.0, 50.0], [400.0, 50.0]])
    pops = binning.nearest_centre(ev(spark, d), ["x", "y"], c).groupBy("centre").agg(F.count("*").alias("population"))
    return spawning.voronoi_weights(pops, binning.voronoi_areas(c, np.array([0.0, 0.0]), np.array([500.0, 100.0])).tolist()).withColumn("weight", X.scaled("weight", 9))


@query("vec_id weight", f"SELECT n.id AS vec_id, {_sc('(lof - (SELECT min(lof) FROM s)) / ((SELECT max(lof) FROM s) - (SELECT min(lof) FROM s))', 5)} AS weight FROM s n", _KNN + ", kd AS (SELECT id, max(sqrt(d2)) AS kd FROM k GROUP BY 1), l AS (SELECT k.id, 1 / greatest(avg(greatest(kd.kd, sqrt(k.d2))), 1e-12) AS lrd FROM k JOIN kd ON kd.id = k.neighbour GROUP BY 1), s AS (SELECT n.id, m / greatest(l.lrd, 1e-12) AS lof FROM (SELECT k.id, avg(lrd) AS m FROM k JOIN l ON k.neighbour = l.id GROUP BY 1) n JOIN l ON n.id = l.id)")
def outlier_weights(spark, d):
    return spawning.outlier_weights(spawning.local_outlier_factor(_rounded(spark, d), "vec_id", "v"), "vec_id").withColumn("weight", X.scaled("weight", 5))


@query("cell weight", f"SELECT cell, {_sc('w / (SELECT sum(w) FROM z)', 9)} AS weight FROM z", f"p AS (SELECT {_CELL} AS cell, count(*) AS population FROM lineitem GROUP BY 1), g AS (SELECT range AS cell, abs(1.0 + (range // 30 + 0.5) * (49.0::DOUBLE / 30) - 20.0) AS d FROM range(900)), z AS (SELECT cell, 1.0::DOUBLE / population * ((SELECT max(d) FROM g) - d) / ((SELECT max(d) FROM g) - (SELECT min(d) FROM g)) AS w FROM p JOIN g USING (cell))")
def density_target_weights(spark, d):
    near = binning.closeness(binning.full_grid(spark, SHAPE, list(BOUNDS.values())), ["c0"], [20.0])
    return spawning.density_weights(binning.uniform_cells(li(spark, d), list(BOUNDS), SHAPE, BOUNDS), closeness=near).withColumn("weight", X.scaled("weight", 9))


@query("pick state!", "SELECT range AS pick, state FROM range(12) JOIN (SELECT state, row_number() OVER (ORDER BY state) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT event_type AS state FROM events)) ON k = range % m")
def tiled_picks(spark, d):
    return spawning.tiled(S.table(spark, d, "events").select(F.col("event_type").alias("state")).distinct(), 12, ["state"])


@query("n least most", "SELECT 50 AS n, min(s) AS least, max(s) AS most FROM (SELECT DISTINCT CAST(x >= 250 AS BIGINT) AS s FROM sx)", _TWO)
def draw_with_replacement(spark, d):
    """Two rows with a weight, fifty draws: fifty rows."""
    rows = _two(spark, d).groupBy("s").agg(F.lit(0.5).alias("w"))
    return spawning.weighted_draw(rows, "w", 50, 3, "s").agg(F.count("*").alias("n"), F.min("s").alias("least"), F.max("s").alias("most"))


@query("cell population first last", f"SELECT CAST({_ECELL} AS BIGINT) AS cell, count(*) AS population, min(event_id) AS first, max(event_id) AS last FROM fr GROUP BY 1", _FR)
def cell_members(spark, d):
    m = binning.members(ev_cells(spark, d), "event_id")
    return m.select("cell", "population", F.get("members", F.lit(0)).alias("first"), F.element_at("members", -1).alias("last"))


@query("cell population centre", f"SELECT k AS cell, population, (e[k + 1] + e[k + 2]) / 2 * 10 AS centre FROM (SELECT least(greatest(len(list_filter({EDGES}::DOUBLE[], lambda e: e <= l_quantity)) - 1, 0), {len(EDGES) - 2}) AS k, {EDGES}::DOUBLE[] AS e, count(*) AS population FROM lineitem GROUP BY ALL)")
def edge_centres(spark, d):
    """Cells between edges that line items occupy, with ten times their centres."""
    counts = binning.populations(binning.edge_cells(li(spark, d), ["l_quantity"], [EDGES]))
    return counts.withColumn("centre", F.get(F.lit(binning.edge_centres(EDGES)), F.col("cell").cast("int")) * 10)


# ---- criteria -----------------------------------------------------------------------------------------------------


@query("iteration change satisfied? reason!", f"SELECT iteration, CASE WHEN t IS NOT NULL THEN {_sc('abs(t - p) / greatest(abs(p), abs(t), 1e-12)', 3)} END AS change, coalesce(t IS NOT NULL AND abs(t - p) / greatest(abs(p), abs(t), 1e-12) < 0.1, false) AS satisfied, CASE WHEN t IS NULL THEN 'no finite timescales' WHEN p IS NULL THEN 'baseline established' END AS reason FROM (SELECT *, last_value(t IGNORE NULLS) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM se)", _SERIES)
def timescale_criterion_series(spark, d):
    return criteria.timescales(_model_series(spark, d), k=1).withColumn("change", X.scaled("value", 3))


_OCCUPIED = _FR + f", oc AS (SELECT iteration, count(DISTINCT {_ECELL}) // 20 AS occupied, iteration >= 5 AS at_top FROM fr GROUP BY 1)"


@query("iteration streak converged?", "SELECT iteration, streak, max(streak) OVER (ORDER BY iteration) >= 3 AS converged FROM (SELECT iteration, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY iteration) AS streak FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY iteration) AS g FROM (SELECT *, at_top AND NOT coalesce(occupied > lag(occupied) OVER (ORDER BY iteration), true) AS ok FROM oc)))", _OCCUPIED)
def no_growth_counter(spark, d):
    o = ev_cells(spark, d).groupBy("iteration").agg(F.floor(F.countDistinct("cell") / 20).alias("occupied"), (F.col("iteration") >= 5).alias("at_top"))
    return criteria.no_growth(o, 3)


@query("iteration trained?", "SELECT DISTINCT iteration, iteration % 4 = 0 AS trained FROM fr", _FR)
def retrain_schedule(spark, d):
    return criteria.retrained_every(ev(spark, d).select("iteration").distinct(), 4)


@query("iteration trained? waited", "SELECT iteration, trained, waited FROM fold", "RECURSIVE " + _SERIES + """, o AS (SELECT iteration, score, row_number() OVER (ORDER BY iteration) AS k FROM se), fold AS (
  SELECT iteration, k, true AS trained, CAST(0 AS BIGINT) AS waited, score AS best FROM o WHERE k = 1
  UNION ALL SELECT n.iteration, n.k, t, CASE WHEN t THEN 0 ELSE f.waited + 1 END, CASE WHEN t THEN greatest(f.best, n.score) ELSE f.best END
  FROM fold f JOIN o n ON n.k = f.k + 1, LATERAL (SELECT f.waited >= 1 AND (f.best - n.score > 0.005 * greatest(abs(f.best), 1e-9) OR f.waited >= 5) AS t) x)""")
def retrain_on_decline(spark, d):
    """The score of each iteration's model stands for the model in use and for one that is trained there."""
    series = _model_series(spark, d).select("iteration", F.col("vamp2").alias("score"), F.col("vamp2").alias("trained_score"))
    return criteria.retrained_on_decline(series, 0.005, 1, 5)


@query("walker frames", "SELECT walker, count(*) AS frames FROM fr GROUP BY 1 HAVING count(*) > 1", _FR)
def walker_segments(spark, d):
    return sequence.segments(ev(spark, d).withColumn("cv_dim", F.lit(2)), ["walker"], "cv_dim").groupBy("walker").agg(F.count("*").alias("frames"))


# ---- stored state -------------------------------------------------------------------------------------------------


@query("iteration frames total", f"SELECT iteration, count(*) AS frames, {_sc('sum(x)', 2)} AS total FROM fr WHERE iteration <= 20 GROUP BY 1", _FR)
def checkpoint_round_trip(spark, d):
    """Saved at iterations 5, 12 and 20, the last one replaced, and read back from the deltas."""
    store = C.Checkpoints(spark, _scratch(spark, "checkpoints"))
    history = ev(spark, d).select("iteration", "walker", "frame", "x")
    for at in (5, 12, 20, 20):
        store.save(at, history, {"flux_history": [0.1] if at == 12 else []})
    if store.complete() != [5, 12, 20] or store.flux_history() != [0.1]:
        raise AssertionError("the manifest doesn't hold what was saved")
    return store.load().groupBy("iteration").agg(F.count("*").alias("frames"), X.scaled(F.sum("x"), 2).alias("total"))


@query("iteration entry! ckpt", "SELECT iteration, arg_max(entry, ckpt) AS entry, max(ckpt) AS ckpt FROM (SELECT unnest([iteration // 4, iteration // 4 + iteration % 2]) AS ckpt, iteration, concat_ws('-', iteration, min(event_id)) AS entry FROM fr GROUP BY iteration) WHERE ckpt <= 5 GROUP BY iteration", _FR)
def checkpoint_chain_merge(spark, d):
    from .queries import _deltas

    chain = spark.createDataFrame([(5, k) for k in range(6)], "ckpt long, required long")
    return C.merged(_deltas(spark, d), chain, 5)


@query("iteration position event_id", "SELECT iteration, row_number() OVER (PARTITION BY iteration ORDER BY event_id) - 1 AS position, event_id FROM fr", _FR)
def history_flat(spark, d):
    entries = ev(spark, d).groupBy("iteration").agg(F.array_sort(F.collect_list(F.struct("event_id", "walker"))).alias("frames"))
    return C.history_records(entries)


@query("iteration frames", "SELECT iteration, count(*) AS frames FROM fr WHERE iteration % 7 <> 3 GROUP BY 1", _FR)
def usable_iterations(spark, d):
    f = ev(spark, d)
    sizes = f.groupBy("iteration", "walker").agg(F.when(F.col("iteration") % 7 != 3, F.count("*")).alias("n_frames"))
    return C.usable_iterations(f, sizes).groupBy("iteration").agg(F.count("*").alias("frames"))


_LOGGED = _FR + f", lg AS (SELECT iteration, count(DISTINCT walker) AS walkers, count(*) AS frames, count(DISTINCT {_ECELL}) AS cells FROM fr GROUP BY 1)"


@query("iteration walkers frames cumulative share", f"SELECT iteration, walkers, frames, sum(frames) OVER (ORDER BY iteration) AS cumulative, {_sc('cells / 900.0::DOUBLE')} AS share FROM lg", _LOGGED)
def run_log(spark, d):
    from pyspark.sql import Window as W

    per = ev_cells(spark, d).groupBy("iteration").agg(F.countDistinct("walker").alias("successful_walkers"), F.count("*").alias("frames_this_iteration"), F.countDistinct("cell").alias("occupied_bins"))
    rows = per.withColumn("cumulative_frames", F.sum("frames_this_iteration").over(W.orderBy("iteration"))).withColumns({"total_bins": F.lit(900), "exploration_fraction": F.col("occupied_bins") / 900.0, "failed_walkers": F.lit(0), "spawn_indices": F.array(F.lit(0), F.lit(1))})
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in C.LOG if c not in rows.columns})
    path = _scratch(spark, "log")
    C.append_log(rows, path, {"tau_ps": 2.0})
    back = C.read_log(spark, path)
    if not C.check_log(back).first()["adds_up"]:
        raise AssertionError("the log's frames don't add up")
    return back.select("iteration", F.col("successful_walkers").alias("walkers"), F.col("frames_this_iteration").alias("frames"), F.col("cumulative_frames").alias("cumulative"), X.scaled("exploration_fraction").alias("share"))


@query("iteration vamp2", f"SELECT iteration, {_sc('score', 5)} AS vamp2 FROM se", _SERIES)
def stored_models(spark, d):
    path = _scratch(spark, "models")
    C.write_models(_model_series(spark, d), path)
    return C.read_models(spark, path).select("iteration", X.scaled("vamp2", 5).alias("vamp2"))


@query("iteration walker files", "SELECT iteration, walker, count(*) AS files FROM fr GROUP BY ALL", _FR)
def file_labels(spark, d):
    """A file name for each event, by its iteration and walker."""
    names = ev(spark, d).select(F.format_string("run/iter_%d/walker_%04d.part%d.xtc", F.col("iteration").cast("int"), F.col("walker").cast("int"), F.col("event_id").cast("int")).alias("path"))
    return inputs.labels_of_files(names).groupBy("iteration", "walker").agg(F.count("*").alias("files"))


@query("step walker frame", "SELECT frame AS step, walker, frame FROM fr WHERE walker = 5", _FR)
def connected_rows(spark, d):
    f = S.with_lineage(ev(spark, d))
    path = f.where("walker = 5").select(F.col("frame").alias("step"), "frame_key")
    return inputs.connected_frames(path, f)


# ---- geometry and vectors -----------------------------------------------------------------------------------------


def _atoms(spark, d):
    """A vector's first 63 values as 21 atoms."""
    e = S.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.transform(F.slice("embedding", k * 3 + 1, 3), lambda v: v.cast("double")))).alias("atom", "p"))
    return G.coordinates(e.select("vec_id", "atom", *(F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz"))), ["vec_id"])


_AT = lambda a, k: f"embedding[{3 * a + k + 1}]::DOUBLE"
_DIST = lambda a, b: "sqrt(" + " + ".join(f"({_AT(a, k)} - {_AT(b, k)}) * ({_AT(a, k)} - {_AT(b, k)})" for k in range(3)) + ")"
_VEC = "v AS (SELECT vec_id, " + ", ".join(f"{_AT(a + 1, k)} - {_AT(a, k)} AS {n}{k}" for n, a in (("u", 0), ("v", 1), ("w", 2)) for k in range(3)) + " FROM embeddings)"
_CR = lambda n, a, b: f"{a}1 * {b}2 - {a}2 * {b}1 AS {n}0, {a}2 * {b}0 - {a}0 * {b}2 AS {n}1, {a}0 * {b}1 - {a}1 * {b}0 AS {n}2"


@query("vec_id d01 d02 rg", f"SELECT vec_id, {_sc(_DIST(0, 1), 5)} AS d01, {_sc(_DIST(0, 2), 5)} AS d02, {_sc('rg', 4)} AS rg FROM embeddings JOIN (SELECT vec_id, sqrt(sum(s)) AS rg FROM (SELECT vec_id, k % 3 AS axis, var_pop(x) AS s FROM (SELECT vec_id, unnest(range(63)) AS k, unnest(embedding[1:63])::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY 1) USING (vec_id)")
def atom_features(spark, d):
    a = _atoms(spark, d).select("vec_id", G.distances("xyz", [(0, 1), (0, 2)]).alias("p"), G.radius_of_gyration("xyz").alias("g"))
    return a.select("vec_id", X.scaled(F.get("p", F.lit(0)), 5).alias("d01"), X.scaled(F.get("p", F.lit(1)), 5).alias("d02"), X.scaled("g", 4).alias("rg"))


@query("vec_id angle", f"SELECT vec_id, {_sc('degrees(atan2((s0 * v0 + s1 * v1 + s2 * v2) / sqrt(v0 * v0 + v1 * v1 + v2 * v2), n0 * m0 + n1 * m1 + n2 * m2))', 3)} AS angle FROM x", _VEC + f", nm AS (SELECT *, {_CR('n', 'u', 'v')}, {_CR('m', 'v', 'w')} FROM v), x AS (SELECT *, {_CR('s', 'n', 'm')} FROM nm)")
def dihedrals(spark, d):
    return _atoms(spark, d).select("vec_id", X.scaled(G.dihedral("xyz", 0, 1, 2, 3), 3).alias("angle"))


@query("vec_id rmsd~")
def fitted_deviation(spark, d):
    a = _atoms(spark, d)
    ref = a.orderBy("vec_id").first()["xyz"]
    return G.fitted(a, "xyz", ref).select("vec_id", "rmsd")


@query("vec_id a gamma back?", f"SELECT vec_id, {_sc('sqrt(u0 * u0 + u1 * u1 + u2 * u2)', 5)} AS a, {_sc('degrees(acos((u0 * v0 + u1 * v1 + u2 * v2) / sqrt((u0 * u0 + u1 * u1 + u2 * u2) * (v0 * v0 + v1 * v1 + v2 * v2))))', 3)} AS gamma, true AS back FROM v", _VEC)
def unit_cells(spark, d):
    """Cells of three vectors, and that the cell of the vectors made from it is the same."""
    a = _atoms(spark, d)
    step = lambda k: F.zip_with(F.get("xyz", F.lit(k + 1)), F.get("xyz", F.lit(k)), lambda x, y: x - y)
    a = a.select("vec_id", *(step(k).alias(n) for k, n in enumerate("pqr"))).withColumn("cell", G.cell_of_vectors("p", "q", "r"))
    a = a.withColumn("made", G.vectors_of_cell("cell")).withColumns({n: F.get("made", F.lit(k)) for k, n in enumerate("pqr")}).withColumn("again", G.cell_of_vectors("p", "q", "r"))
    same = F.array_max(F.zip_with("cell", "again", lambda x, y: F.abs(x - y))) < 1e-4
    return a.select("vec_id", X.scaled(F.get("cell", F.lit(0)), 5).alias("a"), X.scaled(F.get("cell", F.lit(5)), 3).alias("gamma"), same.alias("back"))


@query("vec_id first last", f"SELECT vec_id, {_sc('embedding[6]::DOUBLE', 5)} AS first, {_sc('embedding[2]::DOUBLE', 5)} AS last FROM embeddings")
def column_subset(spark, d):
    v = X.subset("embedding", [5, 1])
    return S.table(spark, d, "embeddings").select("vec_id", X.scaled(F.get(v, F.lit(0)).cast("double"), 5).alias("first"), X.scaled(F.get(v, F.lit(1)).cast("double"), 5).alias("last"))


@query("vec_id top total", f"SELECT vec_id, {_sc('1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e))))', 7)} AS top, 1000000 AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def softmax_vectors(spark, d):
    s = S.table(spark, d, "embeddings").select("vec_id", X.softmax(F.transform("embedding", lambda v: v.cast("double"))).alias("s"))
    return s.select("vec_id", X.scaled(F.array_max("s"), 7).alias("top"), X.scaled(F.aggregate("s", F.lit(0.0), lambda a, b: a + b)).alias("total"))


@query("event_id first~ second~", "SELECT event_id, -(event_id + 0.5::DOUBLE) AS first, user_id * 10::DOUBLE AS second FROM events")
def parse_points(spark, d):
    """Points written with signs, spaces and powers of ten, from the events' numbers."""
    text = F.concat(F.lit(" -"), "event_id", F.lit(".5 , "), "user_id", F.lit("e1 "))
    return S.table(spark, d, "events").select("event_id", inputs.parse_point(text).alias("p")).select("event_id", F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("second"))


@query("segments total drift?", f"SELECT count(*) AS segments, 1000000 AS total, true AS drift FROM (SELECT lead(x) OVER (PARTITION BY walker ORDER BY frame) AS y FROM fr) WHERE y IS NOT NULL", _FR)
def reweighting(spark, d):
    """Two rounds over all steps of the walkers: the weights sum to 1, and what moves is finite."""
    steps = sequence.lagged(ev(spark, d), ["x", "y"], 1, ["walker"]).select(F.col("event_id").alias("seg_id"), F.array("x", "y").alias("x0"), F.array("x_lag", "y_lag").alias("x1"))
    w, drift = spectral.reweighting_rounds(steps, 12, 2, average_last=2)
    return w.agg(F.count("*").alias("segments"), X.scaled(F.sum("weight")).alias("total")).withColumn("drift", F.lit(bool(np.isfinite(drift).all() and max(drift) < 2)))


# ---- models and labels --------------------------------------------------------------------------------------------


def _lagged_sql(value: str, lag: int) -> str:
    """Moments of pairs of a value of embeddings' vectors, in segments of 50, by k."""
    return f"pr AS (SELECT k, u, lead(u, {lag}) OVER (PARTITION BY k, vec_id // 50 ORDER BY vec_id) AS w FROM ({value})), mn AS (SELECT k, (avg(u) + avg(w)) / 2 AS m FROM pr WHERE w IS NOT NULL GROUP BY k), ks AS (SELECT k, least(avg((u - m) * (w - m)) ** 2 / (avg((u - m) ** 2) * avg((w - m) ** 2)), 1) AS score FROM pr JOIN mn USING (k) WHERE w IS NOT NULL GROUP BY k)"


@query("score", f"SELECT {_sc('score', 7)} AS score FROM ks", _lagged_sql("SELECT 0 AS k, vec_id, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS u FROM embeddings", 2))
def projected_score(spark, d):
    """A model that averages the 64 columns."""
    model = lambda f: spectral.project(f, "v", np.zeros(64), np.full((64, 1), 1 / 64))
    score = states.projected_score(_features(spark, d), model, "cv", 2, ["walker"])
    return spark.createDataFrame([(score,)], "score double").withColumn("score", X.scaled("score", 7))


@query("type! score selected?", f"SELECT 'column ' || k AS type, {_sc('score', 7)} AS score, row_number() OVER (ORDER BY score DESC) = 1 AS selected FROM ks", _lagged_sql("SELECT * FROM (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS u FROM embeddings)", 1))
def feature_types(spark, d):
    """Each of the 64 columns as a feature type of its own."""
    types = {f"column {k}": [k] for k in range(64)}
    scores = states.type_scores(spectral.covariances(_features(spark, d), "v", 1, ["walker"]), types)
    chosen = states.FeatureChoice(list(types), "column 0").step(0, lambda: scores)
    return spark.createDataFrame([(k, v, k == chosen) for k, v in scores.items()], "type string, score double, selected boolean").withColumn("score", X.scaled("score", 7))


@query("vec_id state target", "SELECT vec_id, dense_rank() OVER (ORDER BY p) - 1 AS state, t AS target FROM pl", "pl AS (SELECT vec_id, label // 3 * 7 AS p, lead(label, 2) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS t FROM embeddings)")
def relabelled_states(spark, d):
    """Three labels become one state; the target is the label two steps later."""
    f = S.table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).alias("walker"), F.col("vec_id").alias("frame"), "label", (F.floor(F.col("label") / 3) * 7).alias("predicted"))
    targets = states.label_pairs(f, "vec_id", "label", 2, ["walker"]).select("vec_id", "target")
    return states.relabel(f, "predicted").join(targets, "vec_id", "left")


@query("changed states", f"SELECT {_sc('avg(CASE WHEN label <> label // 3 * 7 THEN 1.0::DOUBLE ELSE 0 END)')} AS changed, count(DISTINCT label // 3) AS states FROM embeddings")
def label_churn(spark, d):
    f = S.table(spark, d, "embeddings").withColumn("predicted", F.floor(F.col("label") / 3) * 7)
    return states.churn(f, "label", "predicted").withColumn("changed", X.scaled("changed"))


@query("rank population", f"SELECT row_number() OVER (ORDER BY p) AS rank, {_sc('p / sum(p) OVER ()')} AS population FROM (SELECT s, sum(n)::DOUBLE AS p FROM (SELECT s, count(*) AS n FROM od WHERE t IS NOT NULL GROUP BY s UNION ALL SELECT t, count(*) FROM od WHERE t IS NOT NULL GROUP BY t) GROUP BY s)", "od AS (SELECT o_custkey % 2 AS s, lead(o_custkey % 2) OVER (PARTITION BY o_custkey // 2 ORDER BY o_custkey, o_orderdate, o_orderkey) AS t FROM orders)")
def metastable_populations(spark, d):
    """Orders one after another in pairs of customers: a state is a priority and which of the two it was, and changes between
    the two are rare, so these are the sets. Each pair of orders is counted both ways."""
    from pyspark.sql import Window as W

    o = S.table(spark, d, "orders")
    kinds = F.dense_rank().over(W.orderBy("o_orderpriority")) - 1
    names = o.select("o_orderpriority").distinct().withColumn("k", kinds)  # as few as there are priorities
    state = (F.col("o_custkey") % 2) * 100 + F.col("k")
    w = W.partitionBy("g").orderBy("o_custkey", "o_orderdate", "o_orderkey")
    steps = o.join(F.broadcast(names), "o_orderpriority").withColumn("g", F.floor(F.col("o_custkey") / 2)).select(state.alias("i"), F.lead(state).over(w).alias("j")).where("j IS NOT NULL")
    both = steps.groupBy("i", "j").agg(F.count("*").alias("c"))
    both = both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "c")).groupBy("i", "j").agg(F.sum("c").alias("c"))
    sets = msm.models(both.withColumn("part", F.lit(0)), "part", 1, 4, n_metastable=2).select(F.posexplode(F.array_sort("populations")).alias("k", "population"))
    return sets.select((F.col("k") + 1).alias("rank"), X.scaled("population").alias("population"))
