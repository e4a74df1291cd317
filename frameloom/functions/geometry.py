"""Geometry of atoms as column expressions: distances, sizes, dihedrals, unit cells, and fitted deviations.

A frame's coordinates are an array of atoms, each an array of three; a table of atoms is gathered by coordinates().
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import ship


def coordinates(atoms: DataFrame, by: list[str], atom: str = "atom", xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """by and xyz, the atoms of each frame in order. A frame's atoms are a bounded group."""
    return atoms.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(atom, F.array(*xyz).alias("p")))).alias("_a")).select(*by, F.transform("_a", lambda a: a["p"]).alias("xyz"))


def _at(xyz, k: int) -> list[Column]:
    a = F.get(F.col(xyz) if isinstance(xyz, str) else xyz, F.lit(k))
    return [F.get(a, F.lit(i)).cast("double") for i in range(3)]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _minus(a, b) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def _cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def distances(xyz, pairs: list[tuple[int, int]]) -> Column:
    """Distances of atom pairs, in order."""
    out = []
    for i, j in pairs:
        d = _minus(_at(xyz, i), _at(xyz, j))
        out.append(F.sqrt(_dot(d, d)))
    return F.array(*out)


def radius_of_gyration(xyz: str) -> Column:
    """Root of the mean squared distance to the centre, all atoms alike."""
    n = F.size(xyz)

    def total(value):
        return F.aggregate(xyz, F.lit(0.0), lambda s, atom: s + value([F.get(atom, F.lit(k)).cast("double") for k in range(3)]))

    mean = [total(lambda p, k=k: p[k]) / n for k in range(3)]
    return F.sqrt(F.greatest(total(lambda p: _dot(p, p)) / n - _dot(mean, mean), F.lit(0.0)))


def dihedral(xyz, i: int, j: int, k: int, m: int) -> Column:
    """Torsion angle of four atoms in degrees, in (-180, 180]."""
    a, b, c, d = (_at(xyz, x) for x in (i, j, k, m))
    u, v, w = _minus(b, a), _minus(c, b), _minus(d, c)
    n1, n2 = _cross(u, v), _cross(v, w)
    return F.degrees(F.atan2(_dot(_cross(n1, n2), v) / F.sqrt(_dot(v, v)), _dot(n1, n2)))


def cell_of_vectors(a: str, b: str, c: str) -> Column:
    """(a, b, c, alpha, beta, gamma) of three box vectors; angles in degrees, 90 beside a vector of no length."""
    v = [[F.get(x, F.lit(k)).cast("double") for k in range(3)] for x in (a, b, c)]
    size = [F.sqrt(_dot(x, x)) for x in v]

    def angle(i, j):
        cosine = _dot(v[i], v[j]) / F.nullif(size[i] * size[j], F.lit(0.0))
        return F.coalesce(F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))), F.lit(90.0))

    return F.array(*size, angle(1, 2), angle(0, 2), angle(0, 1))


def vectors_of_cell(cell: str) -> Column:
    """Box vectors of (a, b, c, alpha, beta, gamma): a along x, b in the xy plane."""
    a, b, c, al, be, ga = (F.get(cell, F.lit(k)).cast("double") for k in range(6))
    cos = lambda x: F.cos(F.radians(x))
    sg = F.sin(F.radians(ga))
    cx, cy = c * cos(be), c * (cos(al) - cos(be) * cos(ga)) / sg
    cz = F.sqrt(F.greatest(c * c - cx * cx - cy * cy, F.lit(0.0)))
    zero = F.lit(0.0)
    return F.array(F.array(a, zero, zero), F.array(b * cos(ga), b * sg, zero), F.array(cx, cy, cz))


def _rotations(x: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For centred frames x (n, atoms, 3): the proper rotations onto ref, and the singular values with their signs."""
    u, s, vt = np.linalg.svd(np.einsum("nai,aj->nij", x, ref))
    sign = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    s[:, 2] *= sign
    u[:, :, 2] *= sign[:, None]
    return u @ vt, s


def _stacked(column, ref: np.ndarray) -> np.ndarray:
    return np.stack([np.stack(v) for v in column]).astype(float) if len(column) else np.zeros((0, *ref.shape))


def fitted(frames: DataFrame, xyz: str, reference: list[list[float]], name: str = "rmsd") -> DataFrame:
    """frames with the deviation from reference after the best rotation (Kabsch), batch by batch in Arrow."""
    ref = np.asarray(reference, float)
    ref = ref - ref.mean(axis=0)
    ship(frames.sparkSession)

    @F.pandas_udf("double")
    def deviation(column):
        import pandas as pd

        x = _stacked(column, ref)
        x = x - x.mean(axis=1, keepdims=True)
        left = (x**2).sum(axis=(1, 2)) + (ref**2).sum() - 2 * _rotations(x, ref)[1].sum(axis=1)
        return pd.Series(np.sqrt(np.maximum(left, 0) / len(ref)))

    return frames.withColumn(name, deviation(F.col(xyz).cast("array<array<double>>")))


def superposed(frames: DataFrame, xyz: str, reference: list[list[float]], name: str = "fitted", atoms: list[int] | None = None) -> DataFrame:
    """frames with all atoms' coordinates after the best rotation and shift onto reference, by the chosen atoms (all): the
    same whatever rotation and shift a frame came with. reference has the chosen atoms. Batch by batch in Arrow; a frame
    without coordinates has null."""
    ref = np.asarray(reference, float)
    centre = ref.mean(axis=0)
    ship(frames.sparkSession)

    @F.pandas_udf("array<array<double>>")
    def move(column):
        import pandas as pd

        out = pd.Series([None] * len(column), dtype=object)
        has = np.flatnonzero(column.notna())
        if len(has):
            x = _stacked(column.iloc[has], ref)
            own = x[:, atoms] if atoms is not None else x
            mean = own.mean(axis=1, keepdims=True)
            turn, _ = _rotations(own - mean, ref - centre)
            for k, c in zip(has, (x - mean) @ turn + centre, strict=True):
                out.iloc[k] = c.tolist()
        return out

    return frames.withColumn(name, move(F.col(xyz).cast("array<array<double>>")))


def backbone_torsions(atoms: DataFrame, by: list[str], residue: str = "residue", name: str = "name", xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(by, residue, phi, psi) in degrees for each residue, from a table of atoms (by, residue, name, x, y, z).

    phi is the torsion of C of the residue before, N, CA and C, psi that of N, CA, C and the N of the one after; null where
    an atom or a neighbour (residue numbers one apart) is missing. Atoms of other names aren't read; of atoms that are
    named twice in a residue the smallest coordinates count. A frame's residues are one window.
    """
    from pyspark.sql import Window as W

    at = lambda n: F.min(F.when(F.col(name) == n, F.array(*(F.col(c).cast("double") for c in xyz)))).alias(n)
    rows = atoms.where(F.col(name).isin("N", "CA", "C")).groupBy(*by, residue).agg(at("N"), at("CA"), at("C"))
    w = W.partitionBy(*by).orderBy(residue)
    beside = lambda c, f, step: F.when(f(F.col(residue)).over(w) == F.col(residue) + step, f(F.col(c)).over(w))
    rows = rows.withColumn("_c", beside("C", F.lag, -1)).withColumn("_n", beside("N", F.lead, 1))
    angle = lambda *four: F.when(sum((F.col(c).isNull().cast("int") for c in four), F.lit(0)) == 0, dihedral(F.array(*four), 0, 1, 2, 3))
    return rows.select(*by, residue, angle("_c", "N", "CA", "C").alias("phi"), angle("N", "CA", "C", "_n").alias("psi"))
