"""Column expressions of the frame algebra: bins, closeness, free energy, angles, parsing. All stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boltzmann's constant in kJ/(mol K)
KB = 0.00831446


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def grid_index(x, lo, hi, n: int) -> Column:
    """Uniform cell floor((x - lo) / width), clamped to the grid; widths are at least 1e-12."""
    width = F.greatest((lit(hi) - lit(lo)) / n, F.lit(1e-12))
    return F.least(F.greatest(F.floor((col(x) - lit(lo)) / width), F.lit(0)), F.lit(n - 1)).cast("int")


def log_index(x, lo, hi, n: int) -> Column:
    """The run log's cell: floor((x - lo) / (hi - lo) * n), another order of operations than grid_index."""
    return F.least(F.greatest(F.floor((col(x) - lit(lo)) / (lit(hi) - lit(lo)) * n), F.lit(0)), F.lit(n - 1)).cast("int")


def edge_index(x, edges: Sequence[float]) -> Column:
    """Cell between ascending edges, clamped."""
    n = F.lit(0)
    for e in edges:
        n = n + F.when(col(x) >= F.lit(float(e)), 1).otherwise(0)
    return F.least(F.greatest(n - 1, F.lit(0)), F.lit(len(edges) - 2)).cast("int")


def flat_cell(indexes: Sequence, shape: Sequence[int]) -> Column:
    """Row-major cell number."""
    out = F.lit(0).cast("long")
    for i, n in zip(indexes, shape, strict=True):
        out = out * n + col(i)
    return out


def free_energy(p, temperature: float = 300.0) -> Column:
    """-kT ln p in kJ/mol; null where p is not positive."""
    return F.when(col(p) > 0, -KB * temperature * F.ln(col(p)))


def safe_divide(a, b, eps: float = 1e-12) -> Column:
    b = col(b)
    return col(a) / F.when(F.abs(b) >= eps, b).when(b < 0, F.lit(-eps)).otherwise(F.lit(eps))


def min_max(x, lo, hi) -> Column:
    """(x - lo) / (hi - lo), 1 where all are equal."""
    return F.when(col(hi) > col(lo), (col(x) - col(lo)) / (col(hi) - col(lo))).otherwise(F.lit(1.0))


def in_box(columns: Sequence, box: Sequence[tuple[float, float]]) -> Column:
    """Inclusive on both ends, in every dimension."""
    if len(columns) != len(box):
        raise ValueError(f"{len(box)} intervals for {len(columns)} coordinates")
    out = F.lit(True)
    for c, (lo, hi) in zip(columns, box, strict=True):
        out = out & col(c).between(F.lit(float(lo)), F.lit(float(hi)))
    return out


def squared_distance(columns: Sequence, point: Sequence[float], periods: Sequence[float | None] | None = None) -> Column:
    """Euclidean, or with the nearest image along the axes that have a period."""
    out = F.lit(0.0)
    for k, (c, p) in enumerate(zip(columns, point, strict=True)):
        d = col(c) - F.lit(float(p))
        if periods and periods[k]:
            d = d - F.rint(d / float(periods[k])) * float(periods[k])
        out = out + d * d
    return out


def wrap(x, lo: float, hi: float, periodic: bool = True) -> Column:
    """Into [lo, hi): periodic, or cut off at the ends."""
    return F.pmod(col(x) - lit(lo), lit(hi - lo)) + lit(lo) if periodic else F.least(F.greatest(col(x), lit(lo)), lit(hi))


def softmax(values) -> Column:
    """Of an array: exp(v - max), normalised; an empty array stays empty. The array, its maximum, the raised values and their
    sum are each bound once, as the one element of an array, so that the work grows as the array's length."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    raised = lambda a: once(F.array_max(a), lambda top: F.transform(a, lambda v: F.exp(v - top)))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x)
    return once(once(col(values), raised), lambda r: once(total(r), lambda t: F.transform(r, lambda v: v / t)))


def subset(vector, columns: Sequence[int]) -> Column:
    """The chosen places of an array, in the order given; one that isn't there is null."""
    return F.array(*[F.get(col(vector), F.lit(int(k))) for k in columns])


def sin_cos(angles) -> Column:
    """n angles to n sines and then n cosines."""
    return F.concat(F.transform(col(angles), F.sin), F.transform(col(angles), F.cos))


def frame_key(iteration, walker, frame) -> Column:
    return F.concat_ws(":", *(col(c).cast("string") for c in (iteration, walker, frame)))


def walker_seed(base, iteration, walker) -> Column:
    """(base + iteration * 100003 + walker * 1009) mod (2^31 - 1), 0 becoming 1."""
    s = F.pmod(col(base).cast("long") + col(iteration).cast("long") * 100003 + col(walker).cast("long") * 1009, F.lit(2147483647))
    return F.when(s == 0, F.lit(1)).otherwise(s).cast("long")


def walltime_seconds(text) -> Column:
    """D-H:M:S, H:M:S, M:S, or minutes; null for anything else."""
    t = F.trim(col(text))
    days = F.when(t.rlike(r"^\d+-\d+:\d+:\d+$"), F.split_part(t, F.lit("-"), F.lit(1)).cast("long")).otherwise(F.lit(0))
    clock = F.split(F.regexp_replace(t, r"^\d+-", ""), ":")
    part = lambda k: F.get(clock, F.lit(k)).try_cast("long")
    return (
        F.when(t.rlike(r"^(\d+-)?\d+:\d+:\d+$"), days * 86400 + part(0) * 3600 + part(1) * 60 + part(2))
        .when(t.rlike(r"^\d+:\d+$"), part(0) * 60 + part(1))
        .when(t.rlike(r"^\d+$"), part(0) * 60)
    )


def escalated(start: int, steps, growth: float, most: int) -> Column:
    """Bins after a number of steps: each multiplies them, rounded down, by one more at least, up to a limit."""
    grown = lambda n: F.least(F.greatest(F.floor(n * F.lit(growth)).cast("int"), n + 1), F.lit(most))
    return F.aggregate(F.slice(F.sequence(F.lit(0), col(steps).cast("int")), 2, 1 << 30), F.lit(start), lambda n, _: grown(n))


def safe_stem(text) -> Column:
    return F.regexp_replace(col(text), "[^A-Za-z0-9_.-]+", "_")


def stable_key(seed: int, x) -> Column:
    """A pseudo-random integer from a seed and an integer column, the same in any engine and partitioning."""
    return F.pmod(col(x).cast("long") * 1103515245 + F.lit(12345 + 7919 * seed), F.lit(2147483648))


def scaled(x, digits: int = 6) -> Column:
    """floor(x * 10^digits + 0.5) as an integer, for exact comparison across engines."""
    return F.floor(col(x) * F.lit(10.0**digits) + F.lit(0.5)).cast("long")
