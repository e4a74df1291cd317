"""Queries on stored ensembles, neighbours by cells, connected sets, quantiles, fitted predictors, torsions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import geometry as G
from ..operators import binning, components, neighbours, predictor, scaling, sequence
from ..operators.ensemble_table import EnsembleTable
from ..scratch import scratch_path
from ..sources import frames as S
from .more_queries import _atoms
from .queries import _ECELL, _FR, _KNN, _rounded, _sc, ev, ev_cells, query


@query("id neighbour rank", "SELECT id, neighbour, rank FROM k", _KNN)
def knn_by_cells(spark, d):
    """The neighbours of knn_graph, by cells around pivots."""
    return neighbours.nearest_neighbours(_rounded(spark, d), "vec_id", "v", 20)[0]


@query("point neighbours d2", f"SELECT a.event_id AS point, 3 AS neighbours, {_sc('list_sum(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 3))', 3)} AS d2 FROM fr a JOIN fr b ON a.event_id <> b.event_id GROUP BY 1", _FR)
def nearest_frames(spark, d):
    """Squared distances of the three nearest frames of every frame, in the plane."""
    f = ev(spark, d).select("event_id", F.array("x", "y").alias("v"))
    near = neighbours.nearest_neighbours(f, "event_id", "v", 3)[0]
    return near.groupBy(F.col("id").alias("point")).agg(F.count("*").alias("neighbours"), X.scaled(F.sum("d2"), 3).alias("d2"))


_EDGES = _FR + f", ce AS (SELECT walker, frame, CAST({_ECELL} AS BIGINT) AS c FROM fr), ed AS (SELECT DISTINCT i, j FROM (SELECT c AS i, lead(c) OVER (PARTITION BY walker ORDER BY frame) AS j FROM ce) WHERE j IS NOT NULL)"


@query("state component", "SELECT s AS state, least(s, min(f.b)) AS component FROM (SELECT i AS s FROM ed UNION SELECT j FROM ed) LEFT JOIN (SELECT f.a, f.b FROM re f JOIN re g ON g.a = f.b AND g.b = f.a) f ON f.a = s GROUP BY s", "RECURSIVE " + _EDGES + ", re AS (SELECT i AS a, j AS b FROM ed UNION SELECT r.a, e.j FROM re r JOIN ed e ON e.i = r.b)")
def transition_components(spark, d):
    """Strongly connected sets of the grid's cells under the walkers' steps."""
    steps = sequence.lagged(ev_cells(spark, d).select("walker", "frame", "cell"), ["cell"], 1, ["walker"])
    return components.strong_components(steps.select(F.col("cell").alias("i"), F.col("cell_lag").alias("j"))).withColumnsRenamed({"node": "state"})


@query("column_no q1 q2 q3", "SELECT k AS column_no, " + ", ".join(f"{_sc(f'quantile_cont(v, {q})', 9)} AS q{n}" for n, q in ((1, 0.25), (2, 0.5), (3, 0.9))) + " FROM (SELECT unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1")
def column_quantiles(spark, d):
    q = scaling.exact_quantiles(S.table(spark, d, "embeddings"), "embedding", [0.25, 0.5, 0.9])
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(q)], "column_no int, a double, b double, c double")
    return rows.select("column_no", *(X.scaled(c, 9).alias(f"q{n}") for n, c in ((1, "a"), (2, "b"), (3, "c"))))


@query("label frames right?")
def predicted_labels(spark, d):
    """A predictor of the vectors' labels: how many rows it gives each label, and whether it beats always saying the commonest."""
    e = S.table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    found = predictor.predict(e, "embedding", predictor.fit(e, "embedding", "label"))
    n = e.count()
    hits = found.where("predicted = label").count()
    most = e.groupBy("label").count().agg(F.max("count")).first()[0]
    return found.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("frames")).withColumn("right", F.lit(bool(hits >= most and n >= hits)))


_BATCHES = (
    _FR
    + """, st AS (SELECT DISTINCT walker FROM fr WHERE iteration <= 9),
  en AS (SELECT b, walker, arg_max(x, frame) AS x, arg_max(y, frame) AS y FROM fr JOIN (SELECT unnest([0, 1, 2]) AS b) ON iteration <= 10 * b + 9 JOIN st USING (walker) GROUP BY ALL),
  ba AS (SELECT x AS bx, y AS b_y FROM fr WHERE frame = 0 ORDER BY walker LIMIT 1),
  re AS (SELECT b, walker, x >= 450 AS r, CASE WHEN x >= 450 THEN bx ELSE x END AS x, CASE WHEN x >= 450 THEN b_y ELSE y END AS y FROM en, ba),
  ce AS (SELECT b, CAST(least(greatest(floor(x / 100), 0), 4) * 4 + least(greatest(floor(y / 25), 0), 3) AS BIGINT) AS cell, count(*) AS population, count(*) FILTER (r) AS recycled FROM re GROUP BY ALL),
  sl AS (SELECT *, sum(population) OVER (PARTITION BY b) AS n, count(*) OVER (PARTITION BY b) AS bins, row_number() OVER (PARTITION BY b ORDER BY population, cell) AS k FROM ce)"""
)


@query("batch cell population recycled slots weight anew?", f"SELECT b AS batch, cell, population, recycled, n // bins + CASE WHEN k <= n % bins THEN 1 ELSE 0 END AS slots, CASE WHEN b = 0 THEN {_sc('population / n::DOUBLE', 9)} END AS weight, true AS anew FROM sl", _BATCHES)
def ensemble_batches(spark, d):
    """Three batches of ten days: each walker's last frame so far moves the stored ensemble on. Weights by bin are known to
    SQL for the first batch alone. The second batch is given twice, to a table that was opened anew: the same slots."""
    f = ev(spark, d)
    first = f.where("frame = 0").orderBy("walker").select("x", "y").first()
    live = f.where("iteration <= 9").select("walker").distinct()
    cells = lambda df: binning.uniform_cells(df, ["x", "y"], [5, 4], {"x": (0.0, 500.0), "y": (0.0, 100.0)})
    root, inf = scratch_path(spark, "ensemble"), float("inf")
    opened = lambda: EnsembleTable(spark, root, ["x", "y"], cells, [(450.0, inf), (-inf, inf)])
    out, table = None, opened()
    for b in range(3):
        ends = f.where(F.col("iteration") <= 10 * b + 9).join(live, "walker", "left_semi").groupBy("walker").agg(F.max_by("x", "frame").alias("x"), F.max_by("y", "frame").alias("y"))
        slots = table.step(b, ends, [first["x"], first["y"]])
        same = True
        if b == 1:
            table = opened()
            again = table.step(b, ends, [0.0, 0.0])
            same = slots.exceptAll(again).isEmpty() and again.exceptAll(slots).isEmpty() and table.log().count() == 2
        per = table.binned(b).groupBy("cell").agg(F.count("*").alias("population"), F.sum(F.col("recycled").cast("long")).alias("recycled"))
        got = per.join(slots.groupBy("cell").agg(F.count("*").alias("slots"), F.sum("weight").alias("w")), "cell", "left")
        got = got.select(F.lit(b).alias("batch"), "cell", "population", "recycled", "slots", (X.scaled("w", 9) if b == 0 else F.lit(None)).cast("long").alias("weight"), F.lit(same).alias("anew"))
        out = got if out is None else out.unionByName(got)
    return out


def _at(a: int, k: int) -> str:
    return f"embedding[{3 * a + k + 1}]::DOUBLE"


def _torsion_sql(a: int, b: int, c: int, e: int) -> str:
    """Degrees of the torsion of four atoms of a vector: the angle of two planes, signed by the side."""
    u, v, w = ([f"({_at(q, k)} - {_at(p, k)})" for k in range(3)] for p, q in ((a, b), (b, c), (c, e)))
    cross = lambda p, q: [f"({p[1]} * {q[2]} - {p[2]} * {q[1]})", f"({p[2]} * {q[0]} - {p[0]} * {q[2]})", f"({p[0]} * {q[1]} - {p[1]} * {q[0]})"]
    dot = lambda p, q: "(" + " + ".join(f"{x} * {y}" for x, y in zip(p, q, strict=True)) + ")"
    n, m = cross(u, v), cross(v, w)
    return f"degrees(atan2({dot(u, m)} * sqrt({dot(v, v)}), {dot(n, m)}))"


@query(
    "vec_id residue phi psi",
    " UNION ALL ".join(
        f"SELECT vec_id, {r} AS residue, {_sc(_torsion_sql(3 * r - 1, 3 * r, 3 * r + 1, 3 * r + 2), 3) if r else 'NULL'} AS phi, {_sc(_torsion_sql(3 * r, 3 * r + 1, 3 * r + 2, 3 * r + 3), 3) if r < 6 else 'NULL'} AS psi FROM embeddings" for r in range(7)
    ),
)
def backbone_torsions(spark, d):
    """A vector's 21 atoms as seven residues of N, CA and C."""
    a = _atoms(spark, d).select("vec_id", F.posexplode("xyz").alias("atom", "p"))
    names = F.element_at(F.array(*map(F.lit, ("N", "CA", "C"))), F.col("atom") % 3 + 1)
    rows = a.select("vec_id", F.floor(F.col("atom") / 3).alias("residue"), names.alias("name"), *(F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz")))
    return G.backbone_torsions(rows, ["vec_id"]).select("vec_id", "residue", X.scaled("phi", 3).alias("phi"), X.scaled("psi", 3).alias("psi"))


_FAR = lambda a, b: "sqrt(" + " + ".join(f"({_at(a, k)} - {_at(b, k)}) * ({_at(a, k)} - {_at(b, k)})" for k in range(3)) + ")"
_MEAN = "(SELECT avg(v) FROM (SELECT unnest([" + ", ".join(_at(a, 0) for a in range(21)) + "]) AS v FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1)))"


@query("vec_id near far centre least?", f"SELECT vec_id, {_sc(_FAR(0, 1), 5)} AS near, {_sc(_FAR(0, 20), 5)} AS far, {_sc(_MEAN, 5)} AS centre, true AS least FROM embeddings")
def superposed_frames(spark, d):
    """Coordinates fitted onto the first vector's atoms: distances stay, the centre is the reference's, and what is left of
    the deviation is what fitted_deviation says."""
    a = _atoms(spark, d)
    ref = a.orderBy("vec_id").first()["xyz"]
    got = G.superposed(G.fitted(a, "xyz", ref), "xyz", ref)
    coord = lambda p, k: F.get(p, F.lit(k))
    left = F.aggregate(F.zip_with("fitted", F.lit(ref), lambda p, q: sum(((coord(p, k) - coord(q, k)) * (coord(p, k) - coord(q, k)) for k in range(3)), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    pairs = G.distances("fitted", [(0, 1), (0, 20)])
    mean = F.aggregate("fitted", F.lit(0.0), lambda s, p: s + coord(p, 0)) / 21
    return got.select("vec_id", X.scaled(F.get(pairs, F.lit(0)), 5).alias("near"), X.scaled(F.get(pairs, F.lit(1)), 5).alias("far"), X.scaled(mean, 5).alias("centre"), (F.abs(F.sqrt(left / 21) - F.col("rmsd")) < 1e-6).alias("least"))
