"""Feature types by their score, scores of fitted models, and the labels of a state-predictive model between its fits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spectral
from .sequence import lagged


def projected_score(frames: DataFrame, projection: Callable[[DataFrame], DataFrame] | None, latent: str, lag: int, segment: list[str], order: str = "frame") -> float | None:
    """VAMP-2 of what a model makes of frames: projection adds the column latent (an array). None without a model, or
    where no segment is longer than the lag."""
    if projection is None:
        return None
    try:
        return spectral.vamp2(spectral.covariances(projection(frames), latent, lag, segment, order))
    except (ValueError, np.linalg.LinAlgError):
        return None


@dataclass
class FeatureChoice:
    """The feature type in use, chosen anew every cadence iterations (0: once). columns, the selected columns of the
    type, belong to it and are dropped when it changes."""

    candidates: list[str]
    default: str
    cadence: int = 0
    selected: str | None = None
    columns: list[int] | None = None

    def due(self, iteration: int) -> bool:
        return bool(self.candidates) and (self.selected is None or (self.cadence > 0 and iteration % self.cadence == 0))

    def step(self, iteration: int, scores: Callable[[], dict[str, float | None]]) -> str:
        """The type of this iteration. scores is called when a choice is due and leaves out what can't be computed; if
        that is all, the type in use, else the default, serves and the choice stays due."""
        if not self.due(iteration):
            return self.selected or self.default
        ranked = spectral.rank_candidates({k: v for k, v in scores().items() if k in self.candidates})
        if not ranked:
            return self.selected or self.default
        if ranked[0][0] != self.selected:
            self.selected, self.columns = ranked[0][0], None
        return self.selected


def type_scores(cov: dict, columns: dict[str, list[int]]) -> dict[str, float]:
    """VAMP-2 of each feature type from the covariances of all types' columns side by side: one pass for all of them.
    Types without columns or whose columns have no score are left out."""
    found = {}
    for name, own in columns.items():
        try:
            if own:
                found[name] = spectral.vamp2(cov, own)
        except (ValueError, np.linalg.LinAlgError):
            pass
    return found


def label_pairs(frames: DataFrame, vector: str, label: str, lag: int, segment: list[str], order: str = "frame") -> DataFrame:
    """What a state predictor learns from: the vector, and the label lag steps later in the same segment."""
    return lagged(frames, [label], lag, segment, order).select(*segment, order, vector, F.col(f"{label}_lag").alias("target"))


def relabel(frames: DataFrame, predicted: str, out: str = "state") -> DataFrame:
    """frames with out: predicted states numbered from 0 in order, so that empty states vanish. Null stays null.

    The numbers come from the table of distinct states, which is as small as the predictor's output layer.
    """
    own = frames.groupBy(F.col(predicted).alias("_p")).agg(F.lit(1)).where("_p IS NOT NULL")
    numbers = own.select("_p", (F.row_number().over(W.orderBy("_p")) - 1).alias(out))
    return frames.drop(out).join(numbers, F.col(predicted) == F.col("_p"), "left").drop("_p")


def churn(frames: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: changed, the part of the frames whose predicted state isn't their label (null for no frames), and states,
    how many are predicted at all."""
    return frames.agg(F.avg((~F.col(label).eqNullSafe(F.col(predicted))).cast("double")).alias("changed"), F.countDistinct(predicted).alias("states"))


def refine(frames: DataFrame, label: str, fit: Callable[[DataFrame, str], Callable[[DataFrame], DataFrame]], write: Callable[[DataFrame], DataFrame], rounds: int = 5, tolerance: float = 0.01) -> tuple[DataFrame, list[float]]:
    """Fit, predict, relabel, until under tolerance of the labels change, one state is left, or rounds are over.

    fit(frames, label) returns what adds a column predicted; write keeps a table between rounds and reads it back, so a
    round reads one table. Returns the frames with their last labels and each round's change.
    """
    changes: list[float] = []
    for _ in range(rounds):
        found = write(fit(frames, label)(frames))
        seen = churn(found, label, "predicted").first()
        if seen["changed"] is None:
            break
        changes.append(seen["changed"])
        frames = relabel(found, "predicted", label).drop("predicted")
        if seen["states"] < 2 or seen["changed"] < tolerance:
            break
    return frames, changes
