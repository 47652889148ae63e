"""Calibration against a plain solver, ties, poisoned labels, refused inputs."""

import numpy as np
import pytest
from cohortgrid.operators import calibration as K
from cohortgrid.operators import softmax
from cohortgrid.operators.contracts import ContractError
from pyspark.sql import functions as F

N_CLASSES, N_OUTER, N_INNER = 4, 2, 3


def data(seed=0, n=240):
    """Mostly right, underconfident scores: (sample, class, outer fold, inner folds, scores by k)."""
    rng, out = np.random.default_rng(seed), []
    for s in range(n):
        y, outer = s % N_CLASSES, (s // N_CLASSES) % N_OUTER
        inner = [-1 if k == outer else (s // (N_CLASSES * N_OUTER) + k) % N_INNER for k in range(N_OUTER)]
        z = rng.normal(0, 1, (N_OUTER, N_CLASSES))
        z[:, y] += 1.5
        e = np.exp(0.5 * z)
        out.append((s, y, outer, inner, e / e.sum(1, keepdims=True)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = data()
    scores = [(k, r[3][k], r[0], c, float(r[4][k][c])) for r in rows for k in range(N_OUTER) if r[3][k] >= 0 for c in range(N_CLASSES)]
    return (
        spark.createDataFrame(scores, "k int, j int, sample_id long, class int, p double").repartition(3).persist(),
        spark.createDataFrame([(r[0], r[1]) for r in rows], "sample_id long, truth int").persist(),
        spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "sample_id long, outer_fold int, inner array<int>").persist(),
    )


@pytest.fixture(scope="module")
def fitted(tables):
    scores, truth, _ = tables
    rows = K.score_rows(scores, truth, list(range(N_CLASSES))).persist()
    return rows, *K.candidates(rows, N_CLASSES, cs=(0.1, 10.0))


def solve(x, y, c):
    """Newton steps on the whole Hessian, weights over 2 c n and free intercepts."""
    n, d = x.shape
    z, k = np.hstack([x, np.ones((n, 1))]), N_CLASSES
    w, ridge = np.zeros((k, d + 1)), np.tile(np.r_[np.ones(d), 0.0], (k, 1)) / (c * n)
    for _ in range(60):
        u = z @ w.T
        p = np.exp(u - u.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = ((p - np.eye(k)[y]).T @ z / n + ridge * w).ravel()
        h = np.einsum("na,ab,nd,ne->adbe", p, np.eye(k), z, z) / n - np.einsum("na,nb,nd,ne->adbe", p, p, z, z) / n
        h = h.reshape(k * (d + 1), -1) + np.diag(ridge.ravel())
        w = w - (np.linalg.pinv(h) @ slope).reshape(k, d + 1)
    return w


def plain(rows, k, j, how, c):
    """Probabilities of fold j's samples of k, by a fit on the other folds: {sample: probabilities}."""
    t = (lambda x: np.log(np.clip(x, 1e-4, 1))) if how == "log" else (lambda x: x)
    fit = [r for r in rows if r[3][k] not in (-1, j)]
    x, y = t(np.array([r[4][k] for r in fit])), np.array([r[1] for r in fit])
    mean, sd = x.mean(0), x.std(0)
    w, out = solve((x - mean) / sd, y, c), {}
    for r in rows:
        if r[3][k] == j:
            u = w[:, :-1] @ ((t(r[4][k]) - mean) / sd) + w[:, -1]
            e = np.exp(u - u.max())
            out[r[0]] = (r[1], e / e.sum())
    return out


def test_candidates_like_a_plain_solver(fitted):
    _, found, fits = fitted
    assert [f[:3] for f in found] == [(k, how, c) for k in range(N_OUTER) for how in ("raw", "log") for c in (0.1, 10.0)]
    for k, how, c, loss, ok in found:
        want = np.mean([np.mean([-np.log(p[y]) for y, p in plain(data(), k, j, how, c).values()]) for j in range(N_INNER)])
        assert ok and loss == pytest.approx(want, abs=2e-6), (k, how, c)
    assert len(fits.weights) == len(found) * N_INNER


def test_calibrated_scores_of_every_sample(tables, fitted):
    rows, found, fits = fitted
    chosen = K.select(found)
    after = K.as_scores(softmax.applied(rows, fits, chosen), list(range(N_CLASSES))).collect()
    got = {}
    for r in after:
        got.setdefault((r.k, r.j, r.sample_id), {})[r["class"]] = r.p
    assert len(got) == sum(j >= 0 for r in data() for j in r[3])
    for k in range(N_OUTER):
        for j in range(N_INNER):
            for s, (_, p) in plain(data(), k, j, *chosen[k]).items():
                assert [got[k, j, s][c] for c in range(N_CLASSES)] == pytest.approx(list(p), abs=1e-4)
    before = rows.select(F.avg(F.array_max("x"))).first()[0]
    assert np.mean([max(v.values()) for v in got.values()]) > before  # underconfident scores are sharpened


def test_outer_folds_by_all_inner_folds(spark, tables, fitted):
    rows, found, _ = fitted
    chosen = K.select(found)
    final = K.final_fits(rows, chosen, N_CLASSES)
    kept = softmax.Fits.read(final.table(spark))
    outer = spark.createDataFrame([(r[2], -1, r[0], r[1], r[4][r[2]].tolist()) for r in data()], "k int, j int, sample_id long, y int, x array<double>")
    a, b = (sorted(softmax.applied(outer, f, chosen, on=-1).collect()) for f in (final, kept))
    assert a == b and len(a) == len(data()) and all(sum(r.x) == pytest.approx(1) for r in a)
    k, (how, c) = 0, chosen[0]
    fit = [r for r in data() if r[3][0] >= 0]
    t = np.log if how == "log" else np.asarray
    x = t(np.array([r[4][k] for r in fit]))
    w = solve((x - x.mean(0)) / x.std(0), np.array([r[1] for r in fit]), c)
    one = next(r for r in a if r.k == 0)
    u = w[:, :-1] @ ((t(data()[one.sample_id][4][0]) - x.mean(0)) / x.std(0)) + w[:, -1]
    assert one.x == pytest.approx(list(np.exp(u) / np.exp(u).sum()), abs=1e-4)


def test_labels_of_the_held_out_fold_change_nothing_there(tables, fitted):
    rows, *_ = fitted
    poisoned = rows.withColumn("y", F.when(F.col("j") == 2, (F.col("y") + 1) % N_CLASSES).otherwise(F.col("y")))
    problems = softmax.grid([0], [0, 1, 2], ("log",), (1.0,))
    clean, dirty = (softmax.fit(r, problems, N_CLASSES, N_CLASSES) for r in (rows, poisoned))
    left_out, other = (0, 2, "log", 1.0), (0, 0, "log", 1.0)
    assert np.abs(clean.weights[left_out] - dirty.weights[left_out]).max() < 1e-9
    assert np.abs(clean.weights[other] - dirty.weights[other]).max() > 0.1


def test_the_first_of_equal_candidates_is_chosen():
    found = [(0, "raw", 0.1, 0.5, True), (0, "raw", 1.0, 0.4, True), (0, "log", 0.1, 0.4, True), (1, "raw", 0.1, 0.3, True)]
    assert K.select(found) == {0: ("raw", 1.0), 1: ("raw", 0.1)}
    with pytest.raises(ContractError, match="no candidates"):
        K.select([])


def test_wrong_inputs_stop(spark, tables):
    scores, truth, folds = tables
    K.check_inner(scores, folds)
    own = folds.filter("outer_fold = 0").select(F.lit(0).alias("k"), F.lit(1).alias("j"), "sample_id", F.lit(0).alias("class"), F.lit(1.0).alias("p"))
    with pytest.raises(ContractError, match="outer test fold"):
        K.check_inner(scores.unionByName(own), folds)
    with pytest.raises(ContractError, match="another inner fold"):
        K.check_inner(scores.withColumn("j", (F.col("j") + 1) % 3), folds)
    with pytest.raises(ContractError, match="without folds"):
        K.check_inner(scores, folds.filter("sample_id > 5"))
    with pytest.raises(Exception, match="lacks a class"):
        K.score_rows(scores.filter("sample_id > 0 or class > 0"), truth, list(range(N_CLASSES))).collect()
    rows = K.score_rows(scores, truth, list(range(N_CLASSES)))
    with pytest.raises(ContractError, match="no row of class 3"):
        softmax.fit(rows.filter("y < 3"), [(0, 0, "raw", 1.0)], N_CLASSES, N_CLASSES)
