"""Jump models: states that are dear to leave, found by centroid updates and dynamic programming."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def loss_matrix(y: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Half the squared distance of each row to each centroid."""
    return 0.5 * ((y[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)


def best_path(loss: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, float]:
    """States of least total loss plus penalty[i, j] for each step from i to j; ties go to the lower state."""
    n = len(loss)
    cost, back = loss[0].astype(float), np.zeros((n, loss.shape[1]), dtype=int)
    for t in range(1, n):
        total = cost[:, None] + penalty
        back[t] = total.argmin(axis=0)
        cost = total.min(axis=0) + loss[t]
    path = np.empty(n, dtype=int)
    path[-1] = int(cost.argmin())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(cost.min())


def jump_penalty(k: int, size: float) -> np.ndarray:
    i = np.arange(k)
    return size * np.abs(i[:, None] - i[None, :])


def centroids_of(y: np.ndarray, states: np.ndarray, k: int) -> np.ndarray:
    """Mean of each state's rows; a state without rows stays at the mean of all."""
    return np.array([y[states == s].mean(axis=0) if (states == s).any() else y.mean(axis=0) for s in range(k)])


def spread_start(y: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First centroids far apart: each next one is drawn in proportion to the squared distance to the nearest so far."""
    out = [y[rng.integers(len(y))]]
    while len(out) < k:
        d = ((y[:, None, :] - np.array(out)[None]) ** 2).sum(2).min(1)
        out.append(y[rng.choice(len(y), p=d / d.sum())] if d.sum() > 0 else y[rng.integers(len(y))])
    return np.array(out)


def fit_discrete(y: np.ndarray, k: int, size: float, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    rng = np.random.default_rng(seed)
    theta = spread_start(y, k, rng)
    states, best = np.zeros(len(y), dtype=int), np.inf
    for _ in range(rounds):
        now, loss = best_path(loss_matrix(y, theta), jump_penalty(k, size))
        if loss >= best - 1e-10 and (now == states).all():
            break
        states, best = now, loss
        theta = centroids_of(y, states, k)
    return states, theta, best


def candidates(k: int, n: int = 400) -> np.ndarray:
    """Points of the probability simplex on an even grid."""
    steps = n - 1 if k == 2 else max(1, round(n ** (1 / (k - 1))))
    return np.array([[*c, steps - sum(c)] for c in itertools.product(range(steps + 1), repeat=k - 1) if sum(c) <= steps]) / steps


def fit_continuous(y: np.ndarray, k: int, size: float, seed: int, n: int = 400, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    rng = np.random.default_rng(seed)
    theta, grid = spread_start(y, k, rng), candidates(k, n)
    penalty = size / 4 * np.abs(grid[:, None, :] - grid[None, :, :]).sum(2) ** 2
    best, kept, stale = np.inf, None, 0
    for _ in range(rounds):
        path, loss = best_path(loss_matrix(y, theta) @ grid.T, penalty)
        s = grid[path]
        if loss < best - 1e-9:
            best, kept, stale = loss, (s, theta), 0
        else:
            stale += 1
        if stale >= 3:
            break
        mass = s.sum(0)
        theta = np.where(mass[:, None] > 1e-12, (s.T @ y) / np.maximum(mass[:, None], 1e-12), theta)
    return *kept, best


def jump_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], k: int = 2, penalty: float = 1.0, trials: int = 10, seed: int = 0, continuous: bool = False) -> DataFrame:
    """(keys, order, state[, p_0..]) of the best of several starts. Each (series, trial) is a group of its own; only the
    best trial's seed is fitted again to give the states."""
    cols = list(dict.fromkeys([*keys, *order, *features]))
    slim = df.select(*cols).dropna(subset=list(features))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    fit = fit_continuous if continuous else fit_discrete

    def matrix(f: pd.DataFrame) -> np.ndarray:
        return f.sort_values(list(order))[list(features)].to_numpy(dtype=float)

    def trial(f: pd.DataFrame) -> pd.DataFrame:
        t = int(f["trial"].iloc[0])
        return pd.DataFrame([[*[f[c].iloc[0] for c in keys], t, fit(matrix(f), k, penalty, seed + t)[2]]], columns=[*keys, "trial", "loss"])

    tried = slim.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    losses = tried.groupBy(*keys, "trial").applyInPandas(trial, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "trial int, loss double"]))
    best = losses.groupBy(*keys).agg(F.min_by("trial", F.struct("loss", "trial")).alias("trial"))
    probs = [f"p_{i}" for i in range(k)] if continuous else []
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in cols], "state int", *[f"{p} double" for p in probs]])

    def states(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(list(order))
        s, _, _ = fit(f[list(features)].to_numpy(dtype=float), k, penalty, seed + int(f["trial"].iloc[0]))
        out = f[cols].copy()
        out["state"] = (s.argmax(1) if continuous else s).astype("int32")
        for i, p in enumerate(probs):
            out[p] = s[:, i]
        return out

    return slim.join(best, list(keys)).groupBy(*keys).applyInPandas(states, schema)


def predict_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], centroids: Sequence[Sequence[float]], penalty: float = 1.0, continuous: bool = False, n: int = 400) -> DataFrame:
    """(keys, order, features, state[, p_0..]) of new rows under given centroids: one best path a series, nothing fitted."""
    theta = np.asarray(centroids, dtype=float)
    k = len(theta)
    grid = candidates(k, n) if continuous else np.eye(k)
    move = penalty / 4 * np.abs(grid[:, None, :] - grid[None, :, :]).sum(2) ** 2 if continuous else jump_penalty(k, penalty)
    cols = list(dict.fromkeys([*keys, *order, *features]))
    slim = df.select(*cols).dropna(subset=list(features))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    probs = [f"p_{i}" for i in range(k)] if continuous else []

    def states(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(list(order))
        path, _ = best_path(loss_matrix(f[list(features)].to_numpy(dtype=float), theta) @ grid.T, move)
        out = f[cols].copy()
        out["state"] = grid[path].argmax(1).astype("int32")
        for i, p in enumerate(probs):
            out[p] = grid[path][:, i]
        return out

    return slim.groupBy(*keys).applyInPandas(states, ", ".join([*[f"`{c}` {kinds[c]}" for c in cols], "state int", *[f"{p} double" for p in probs]]))


def stationary(p: np.ndarray) -> np.ndarray:
    """The distribution that a transition matrix leaves unchanged."""
    n = len(p)
    a = np.vstack([p.T - np.eye(n), np.ones(n)])
    return np.linalg.lstsq(a, np.r_[np.zeros(n), 1.0], rcond=None)[0]


def simulate(spark: SparkSession, paths: int, steps: int, p: Sequence[Sequence[float]], parameters: Sequence[tuple[float, float]], seed: int = 0) -> DataFrame:
    """(path, t, state, value): Markov-switching normal draws, each path drawn again until all states appear."""
    m, start = np.asarray(p, float), stationary(np.asarray(p, float))

    def draw(frames):
        for f in frames:
            for path in f["id"]:
                rng = np.random.default_rng([seed, int(path)])
                for _ in range(1000):
                    s = [int(rng.choice(len(m), p=start / start.sum()))]
                    while len(s) < steps:
                        s.append(int(rng.choice(len(m), p=m[s[-1]])))
                    if len(set(s)) == len(m):
                        break
                mu, sd = (np.array([parameters[i][j] for i in s]) for j in (0, 1))
                yield pd.DataFrame({"path": path, "t": range(steps), "state": s, "value": rng.normal(mu, sd)})

    return spark.range(paths).mapInPandas(draw, "path long, t long, state int, value double")
