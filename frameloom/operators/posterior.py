"""Posterior of reversible Markov models, sampled by chains that are dealt to tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import ship
from . import spectral


def matchings(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Edges (i, j) dealt to groups in which no two share an end: each edge goes to the first group that is free at both."""
    taken: list[set[int]] = [set() for _ in range(int(max(i.max(), j.max())) + 1 if len(i) else 0)]
    groups: list[list[int]] = []
    for e, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        g = next(g for g in range(len(groups) + 1) if g not in taken[a] and g not in taken[b])
        if g == len(groups):
            groups.append([])
        groups[g].append(e)
        taken[a].add(g)
        taken[b].add(g)
    return [np.array(g) for g in groups]


def reversible_samples(counts: np.ndarray, samples: int, burn: int = 100, every: int = 5, seed: int = 0):
    """Transition matrices from the posterior over reversible chains on the pairs that occur in either direction.

    The chain moves the weights x_ij = x_ji of the stationary flow, with prior 1 / x on each: the diagonal is drawn from
    its conditional Beta law, the other weights take a step each in the logarithm, edges without common ends at once. One
    matrix is held at a time. For two states, T_01 has the posterior Beta(c_01, c_00). States have to be connected.
    """
    rng, c = np.random.default_rng(seed), np.asarray(counts, float)
    both, rows, stay = c + c.T, c.sum(axis=1), np.diag(c).copy()
    i, j = np.nonzero(np.triu(both, 1))
    a = both[i, j]
    groups = matchings(i, j)
    flow, loop = a.copy(), np.where(stay > 0, 2 * stay, 0.0)
    step = 2.4 / np.sqrt(a / 2 + 1)
    out = loop.copy()
    np.add.at(out, i, flow)
    np.add.at(out, j, flow)
    held = stay > 0
    for k in range(burn + samples * every):
        rest = out - loop
        share = rng.beta(stay[held], np.maximum(rows[held] - stay[held], 1e-12))
        loop[held] = rest[held] * share / np.maximum(1 - share, 1e-300)
        out = rest + loop
        for g in groups:
            x, u, v = flow[g], out[i[g]], out[j[g]]
            new = x * np.exp(step[g] * rng.standard_normal(len(g)))
            gain = a[g] * np.log(new / x) - rows[i[g]] * np.log((u - x + new) / u) - rows[j[g]] * np.log((v - x + new) / v)
            yes = np.log(rng.random(len(g))) < gain
            moved = np.where(yes, new - x, 0.0)
            flow[g] = x + moved
            out[i[g]] += moved
            out[j[g]] += moved
        # from the weights anew: no drift by rounding, and the scale, which nothing depends on, stays
        scale = flow.sum() * 2 + loop.sum()
        flow, loop = flow / scale, loop / scale
        out = loop.copy()
        np.add.at(out, i, flow)
        np.add.at(out, j, flow)
        if k >= burn and (k - burn) % every == every - 1:
            m = np.zeros_like(c)
            m[i, j], m[j, i] = flow / out[i], flow / out[j]
            m[np.diag_indices(len(c))] = loop / out
            yield m


def posterior(counts: DataFrame, by: str, lag: int | str, samples: int = 100, chains: int = 4, n_timescales: int = 2, seed: int = 0, guard: int = 4000) -> DataFrame:
    """(by, chain, sample, timescales, leaves): samples of each group's posterior; groups and chains are separate tasks.

    counts: (by, i, j, c) of connected states. timescales are descending; leaves is the first state's chance to leave.
    """
    import pandas as pd

    ship(counts.sparkSession)
    kind = counts.schema[by].dataType.simpleString()
    each = -(-samples // chains)

    def one(key, pdf):
        names = np.unique(np.concatenate([pdf.i, pdf.j]))
        if len(names) > guard:
            raise ValueError(f"{len(names)} states don't fit a dense matrix here")
        c = np.zeros((len(names), len(names)))
        np.add.at(c, (np.searchsorted(names, pdf.i), np.searchsorted(names, pdf.j)), pdf.c)
        step = int(key[0]) if lag == by else int(lag)
        rows = []
        for s, m in enumerate(reversible_samples(c, each, seed=seed * 1009 + int(key[1]))):
            rows.append((key[0], key[1], s, spectral.timescales(m, step, n_timescales).tolist(), float(1 - m[0, 0])))
        return pd.DataFrame(rows, columns=[by, "chain", "sample", "timescales", "leaves"])

    dealt = counts.select(by, F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"), "i", "j", F.col("c").cast("double").alias("c"))
    return dealt.groupBy(by, "chain").applyInPandas(one, f"{by} {kind}, chain int, sample int, timescales array<double>, leaves double")


def posterior_errors(samples: DataFrame, by: str) -> DataFrame:
    """(by, errors): the deviation of each timescale over the samples; samples without it (no decay) don't count."""
    t = samples.select(by, F.posexplode("timescales").alias("k", "t")).where("NOT isnan(t)")
    sd = t.groupBy(by, "k").agg(F.stddev_pop("t").alias("sd"))
    return sd.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sd"))), lambda x: x["sd"]).alias("errors"))


def bayesian_errors(counts: np.ndarray, lag: int, n_samples: int = 100, k: int = 5, seed: int = 0) -> np.ndarray:
    """Deviations of the k slowest timescales over samples of one model's posterior, one matrix in memory at a time."""
    found = [spectral.timescales(m, lag, k) for m in reversible_samples(counts, n_samples, seed=seed)]
    return np.nanstd(found, axis=0)
