"""Named plug-ins: binners, selections, feature models, estimators, criteria, projections. A name is looked up once; what
can't run here says so, and what would make it run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.util import find_spec


@dataclass(frozen=True)
class Entry:
    make: Callable
    summary: str = ""
    needs: tuple[str, ...] = ()
    hint: str = ""

    @property
    def missing(self) -> tuple[str, ...]:
        return tuple(m for m in self.needs if find_spec(m) is None)


class Registry:
    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, name: str, make: Callable, summary: str = "", needs: tuple[str, ...] = (), hint: str = "") -> None:
        """Add or replace an entry; needs are modules that must be importable for it to run."""
        if not name or not callable(make):
            raise ValueError(f"a {self.kind} has a name and something to call")
        self.entries[name.lower()] = Entry(make, summary, tuple(needs), hint)

    def names(self) -> list[str]:
        return sorted(self.entries)

    def available(self) -> list[str]:
        return [n for n in self.names() if not self.entries[n].missing]

    def entry(self, name: str) -> Entry:
        found = self.entries.get(str(name).lower())
        if found is None:
            raise ValueError(f"no {self.kind} is called {name!r}; there are {', '.join(self.names())}")
        return found

    def ensure_available(self, name: str) -> Entry:
        found = self.entry(name)
        if found.missing:
            raise RuntimeError(f"{self.kind} {name!r} needs {', '.join(found.missing)}. {found.hint or 'Install it'}; available here: {', '.join(self.available())}")
        return found

    def make(self, name: str, *args, **options):
        return self.ensure_available(name).make(*args, **options)


BINNERS, SELECTIONS, MODELS, ESTIMATORS, CRITERIA, PROJECTIONS, PROPAGATORS = (Registry(k) for k in ("binner", "selection", "feature model", "estimator", "criterion", "projection", "propagator"))


def project(frames, name: str, *args, **options):
    """frames with the columns that a registered projection adds; it takes and returns a DataFrame, row by row."""
    out = PROJECTIONS.make(name, frames, *args, **options)
    if not set(frames.columns) <= set(out.columns):
        raise ValueError(f"projection {name!r} drops columns of the frames")
    return out


def _not_here(*_, **__):
    raise NotImplementedError("neural feature models are trained outside this library; register a projection of the trained model instead")


def _defaults() -> None:
    from .operators import binning, criteria, msm, posterior, spawning, spectral

    edges = lambda f: lambda points, column, n, lo, hi, **o: f(points, column, n, lo, hi, **o)
    BINNERS.register("uniform", lambda points, column, n, lo, hi: [lo + (hi - lo) * k / n for k in range(n + 1)], "equal cells")
    BINNERS.register("gradient", edges(binning.gradient_edges), "equal steps of cumulative resistance")
    BINNERS.register("mab", lambda points, column, n, lo, hi, slices=100: binning.mab_edges(points, column, n, lo, hi, slices), "brackets around extremes and bottlenecks")
    BINNERS.register("eigenvector", lambda points, column, n, lo, hi: [lo + (hi - lo) * k / n for k in range(n + 1)], "equal cells of the first slow coordinate")
    BINNERS.register("voronoi", binning.lloyd, "k-means centres")
    for name, f in (("density", spawning.density_weights), ("density_hard", spawning.density_hard), ("least_counts", spawning.least_counts), ("lof", spawning.outlier_weights), ("voronoi", spawning.voronoi_weights), ("fps", spawning.farthest_points), ("msm", msm.guided_weights)):
        SELECTIONS.register(name, f)
    MODELS.register("pca", spectral.pca, "principal components of min-max scaled features")
    MODELS.register("tica", spectral.tica, "time-lagged independent components")
    for name, needs in (("tvae", ("torch",)), ("vampnet", ("torch", "deeptime")), ("deep_tica", ("torch", "mlcolvar")), ("spib", ("torch",))):
        MODELS.register(name, _not_here, "neural", needs, "Install it and train outside, or use pca or tica")
    MODELS.register("deep_lda", _not_here, "needs labelled states; not implemented")
    ESTIMATORS.register("mle", spectral.markov_model, "maximum-likelihood reversible")
    ESTIMATORS.register("bayesian", posterior.bayesian_errors, "posterior deviations of the timescales")
    for name, f in (("implied_timescales", criteria.timescales), ("vamp2", criteria.score), ("stationary_distribution", criteria.populations), ("statistical_error", criteria.statistical_error), ("transition_matrix", criteria.transition_error)):
        CRITERIA.register(name, f)


_defaults()
