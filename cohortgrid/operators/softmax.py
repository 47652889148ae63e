"""L2-penalised multinomial logistic regressions, many at once, on rows that stay distributed.

Rows: k, j (set of splits and fold within it), y (class number), x (array of doubles).
A problem (k, j, how, c) is fitted on the rows of k whose fold isn't j, transformed by
`how` and standardised by the moments of those same rows; its loss is the mean log loss
plus the squared weights over 2 c n (intercepts are free), which is what a summed loss
with the penalty 1 / c gives.

All problems take their steps together: a pass over the rows gives the loss and gradient
of every problem that still moves, summed within tasks in NumPy and then per problem
after a shuffle of one row per task and problem; the driver, as Spark's own logistic
regression does, keeps the weights and the L-BFGS memory, whose size is set by problems
x classes x features and not by rows. Passes are as many as the slowest problem needs
(some dozens), whatever the number of folds and candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import fail

#: Scores below this count as this much before their logarithm is taken.
FLOOR = 1e-4
TRANSFORMS = ("raw", "log")
#: Problem (k, j, how, c): j is the fold that is left out, -1 for none.
Problem = tuple[int, int, str, float]


def transformed(x: np.ndarray, how: str) -> np.ndarray:
    if how == "raw":
        return x
    if how == "log":
        return np.log(np.clip(x, FLOOR, 1.0))
    raise ValueError(f"ERROR: unknown transform {how!r} (known: {TRANSFORMS})")


def _sums(name: str, width: int):
    """Adds up arrays per key within a task: rows (key, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for key, sums in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = found.setdefault(key, np.zeros(width))
                own += sums.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))], [name, "sums"])

    return run


def summed(rows: DataFrame, part, width: int) -> dict[int, np.ndarray]:
    """part(k, j, y, x) yields (key, array of that width) for rows of one k and j; the arrays' sums per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            k, j, y = (b.column(c).to_numpy() for c in range(3))
            if not b.num_rows:
                continue
            x = b.column(3).flatten().to_numpy().reshape(b.num_rows, -1)
            for kk, jj in {*zip(k.tolist(), j.tolist(), strict=True)}:
                own = (k == kk) & (j == jj)
                for key, sums in part(kk, jj, y[own], x[own]):
                    found[key] = found[key] + sums if key in found else sums
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["key", "sums"])

    sums = rows.select("k", "j", "y", "x").mapInArrow(run, "key int, sums array<double>")
    return {r["key"]: np.array(r["sums"]) for r in sums.repartition("key").mapInArrow(_sums("key", width), "key int, sums array<double>").collect()}


Side = tuple[int, int, str]
Moments = tuple[int, np.ndarray, np.ndarray]


def moments(rows: DataFrame, keys: list[Side], n_features: int) -> tuple[dict[Side, Moments], dict[Side, np.ndarray]]:
    """For each (k, j, how): rows, means and deviations (n; 1 where nothing varies) over the rows of k outside fold j, and how its standardised features vary together."""
    numbers = {key: n for n, key in enumerate(keys)}
    shifts = dict.fromkeys(TRANSFORMS, 0.0) | {"log": np.log(FLOOR) / 2}  # keeps the squares small

    def part(k, j, y, x):
        for (kk, jj, how), n in numbers.items():
            if kk == k and jj != j:
                z = transformed(x, how) - shifts[how]
                yield n, np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])

    found, out, together = summed(rows, part, 1 + n_features + n_features**2), {}, {}
    for key, n in numbers.items():
        if n not in found:
            fail(f"no rows to fit {key} on")
        count, s, q = found[n][0], found[n][1 : 1 + n_features], found[n][1 + n_features :].reshape(n_features, -1)
        mean, cross = s / count, q / count - np.outer(s, s) / count**2
        var = np.maximum(np.diag(cross), 0)
        sd = np.where(var > 1e-24, np.sqrt(var), 1.0)
        out[key], together[key] = (int(count), mean + shifts[key[2]], sd), cross / np.outer(sd, sd)
    return out, together


def probabilities(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, weights: np.ndarray, how: str) -> np.ndarray:
    """weights: ... x classes x (features + 1), the intercept last. n x ... x classes."""
    z = (transformed(x, how) - mean) / sd
    u = np.tensordot(z, weights[..., :-1], axes=(1, -1)) + weights[..., -1]
    e = np.exp(u - u.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Fits:
    """Fitted problems: weights (classes x (features + 1)), moments, and whether they converged."""

    n_classes: int
    weights: dict[Problem, np.ndarray] = field(default_factory=dict)
    moments: dict[tuple[int, int, str], tuple[int, np.ndarray, np.ndarray]] = field(default_factory=dict)
    converged: dict[Problem, bool] = field(default_factory=dict)
    passes: int = 0

    def table(self, spark) -> DataFrame:
        """As a table that can be saved: k, j, how, c, converged, n, mean, sd, weights (class by class, the intercept last)."""
        rows = [(*p, self.converged[p], self.moments[p[:3]][0], *[m.tolist() for m in self.moments[p[:3]][1:]], w.tolist()) for p, w in self.weights.items()]
        return spark.createDataFrame(rows, "k int, j int, how string, c double, converged boolean, n long, mean array<double>, sd array<double>, weights array<array<double>>")

    @staticmethod
    def read(table: DataFrame) -> Fits:
        """From what table() gave. A row per problem: bounded by folds and candidates."""
        out = Fits(0)
        for r in table.collect():
            p = r["k"], r["j"], r["how"], r["c"]
            out.weights[p], out.converged[p] = np.array(r["weights"]), r["converged"]
            out.moments[p[:3]] = r["n"], np.array(r["mean"]), np.array(r["sd"])
            out.n_classes = len(r["weights"])
        return out


class _Steps:
    """L-BFGS for many problems at once; each goes its own way, all are asked for in the same pass.

    scale: per problem a matrix over the features (and intercept) that bounds the curvature from above, so that features
    which vary together cost no more passes than others; steps begin as its inverse.
    """

    def __init__(self, scale: list[np.ndarray], width: int, memory: int = 10) -> None:
        n, self.inverse = len(scale), [np.linalg.inv(m) for m in scale]
        self.at, self.value, self.slope = np.zeros((n, width)), np.full(n, np.inf), np.zeros((n, width))
        self.trial, self.way, self.step, self.memory = np.zeros((n, width)), np.zeros((n, width)), np.ones(n), memory
        self.pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.done = np.zeros(n, bool)

    def told(self, n: int, value: float, slope: np.ndarray, tolerance: float) -> None:
        """The value and slope at problem n's trial point: takes the step, or halves it."""
        down = float(self.slope[n] @ self.way[n])
        if np.isfinite(self.value[n]) and value > self.value[n] + 1e-4 * self.step[n] * down + 1e-15 * abs(value):
            self.step[n] /= 2
            if self.step[n] < 1e-10:
                self.done[n] = True
            self.trial[n] = self.at[n] + self.step[n] * self.way[n]
            return
        if np.isfinite(self.value[n]):
            s, g = self.trial[n] - self.at[n], slope - self.slope[n]
            if s @ g > 1e-14:
                self.pairs[n] = [*self.pairs[n], (s, g)][-self.memory :]
        self.at[n], self.value[n], self.slope[n] = self.trial[n], value, slope
        if np.abs(slope).max() <= tolerance:
            self.done[n] = True
            return
        q, passed = slope.copy(), []
        for s, g in reversed(self.pairs[n]):
            a = (s @ q) / (s @ g)
            q -= a * g
            passed.append(a)
        scaled = lambda v: (v.reshape(-1, len(self.inverse[n])) @ self.inverse[n]).ravel()
        q = scaled(q)
        if self.pairs[n]:
            s, g = self.pairs[n][-1]
            q *= (s @ g) / (g @ scaled(g))
        for (s, g), a in zip(self.pairs[n], reversed(passed), strict=True):
            q += s * (a - (g @ q) / (s @ g))
        self.way[n] = -q
        self.step[n] = 1.0
        self.trial[n] = self.at[n] + self.step[n] * self.way[n]


def _bound(together: np.ndarray, penalty: float) -> np.ndarray:
    """What bounds the curvature of a class's weights: half of how features (and the intercept) vary together, and the penalty."""
    n = len(together)
    out = np.eye(n + 1) / 2
    out[:n, :n] = together / 2 + np.eye(n) * max(penalty, 1e-9)
    return out


def fit(rows: DataFrame, problems: list[Problem], n_classes: int, n_features: int, tolerance: float = 1e-7, most_passes: int = 500) -> Fits:
    """All problems over the same rows. A class without rows in a problem's fitting rows is an error."""
    spark, width = rows.sparkSession, n_classes * (n_features + 1)
    stats, together = moments(rows, sorted({p[:3] for p in problems}), n_features)

    def classes(k, j, y, x):
        for n, (kk, jj) in enumerate(sides):
            if kk == k and jj != j:
                yield n, np.bincount(y, minlength=n_classes).astype(float)

    sides = sorted({p[:2] for p in problems})
    for n, seen in summed(rows, classes, n_classes).items():
        if (seen == 0).any():
            fail(f"no row of class {int(np.flatnonzero(seen == 0)[0])} to fit (k, j) = {sides[n]} on")
    steps, passes = _Steps([_bound(together[p[:3]], 1 / (p[3] * stats[p[:3]][0])) for p in problems], width), 0
    while not steps.done.all() and passes < most_passes:
        passes += 1
        moving = [n for n in range(len(problems)) if not steps.done[n]]
        # Weights of the problems that move: problems x classes x features, whatever the rows.
        sent = spark.sparkContext.broadcast((moving, steps.trial[moving].reshape(len(moving), n_classes, n_features + 1)))

        def part(k, j, y, x, sent=sent):
            by: dict[tuple[int, str], list[int]] = {}
            numbers, weights = sent.value
            for at, n in enumerate(numbers):
                if problems[n][0] == k and problems[n][1] != j:
                    by.setdefault(problems[n][1:3], []).append(at)
            for (jj, how), ats in by.items():
                _, mean, sd = stats[k, jj, how]
                p = probabilities(x, mean, sd, weights[ats], how)  # n x problems x classes
                loss = -np.log(np.maximum(p[np.arange(len(y)), :, y], 1e-300)).sum(0)
                p[np.arange(len(y)), :, y] -= 1
                z = np.hstack([(transformed(x, how) - mean) / sd, np.ones((len(x), 1))])
                slopes = (p.reshape(len(x), -1).T @ z).reshape(len(ats), -1)
                for at, value, slope in zip(ats, loss, slopes, strict=True):
                    yield numbers[at], np.concatenate([[value], slope])

        found = summed(rows, part, 1 + width)
        sent.destroy()
        for n in moving:
            count, c = stats[problems[n][:3]][0], problems[n][3]
            weights = steps.trial[n].reshape(n_classes, n_features + 1).copy()
            weights[:, -1] = 0
            value = found[n][0] / count + (weights**2).sum() / (2 * c * count)
            steps.told(n, value, found[n][1:] / count + weights.ravel() / (c * count), tolerance)
    out = Fits(n_classes, moments=stats, passes=passes)
    for n, p in enumerate(problems):
        out.weights[p] = steps.at[n].reshape(n_classes, n_features + 1)
        out.converged[p] = bool(np.abs(steps.slope[n]).max() <= 100 * tolerance)
    return out


def grid(ks: list[int], js: list[int], transforms: tuple[str, ...], cs: tuple[float, ...]) -> list[Problem]:
    return list(product(ks, js, transforms, cs))


def held_out_losses(rows: DataFrame, fits: Fits, eps: float = 1e-15) -> dict[Problem, tuple[int, float]]:
    """Rows and mean log loss of each problem on the fold that it left out."""
    problems = list(fits.weights)
    sent = rows.sparkSession.sparkContext.broadcast(fits)

    def part(k, j, y, x):
        for n, p in enumerate(problems):
            if p[:2] == (k, j):
                _, mean, sd = sent.value.moments[p[:3]]
                got = probabilities(x, mean, sd, sent.value.weights[p], p[2])[np.arange(len(y)), y]
                yield n, np.array([len(y), -np.log(np.clip(got, eps, 1 - eps)).sum()])

    found = summed(rows, part, 2)
    return {problems[n]: (int(v[0]), float(v[1] / v[0])) for n, v in found.items()}


def applied(rows: DataFrame, fits: Fits, chosen: dict[int, tuple[str, float]], on: int | None = None) -> DataFrame:
    """rows with x replaced by calibrated scores, by k's chosen (how, c); of the problem that left out the row's fold, or of fold `on` if it is given."""
    sent = rows.sparkSession.sparkContext.broadcast((fits, chosen))
    names = rows.columns
    at = [names.index(c) for c in ("k", "j", "x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, picks = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            k, j = b.column(at[0]).to_numpy(), b.column(at[1]).to_numpy()
            x = b.column(at[2]).flatten().to_numpy().reshape(b.num_rows, -1)
            out = np.empty((len(x), own.n_classes))
            for kk, jj in {*zip(k.tolist(), j.tolist(), strict=True)}:
                rows_, p = (k == kk) & (j == jj), (kk, jj if on is None else on, *picks[kk])
                out[rows_] = probabilities(x[rows_], *own.moments[p[:3]][1:], own.weights[p], p[2])
            columns = list(b.columns)
            columns[at[2]] = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, rows.schema)
