"""Boosting against a plain version; attributions against sums over all subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from cohortgrid.operators import boosting as B
from cohortgrid.operators import trees as T
from cohortgrid.operators.contracts import ContractError
from pyspark.sql import functions as F

N_CLASSES = 3


def planted(n=90, features=5, seed=0, noise=0.15):
    """Class by the first two features; the others tell nothing. Values repeat, so that bins tie."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, features)) / 12
    y = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] > 0.4, 1, 0))
    y = np.where(rng.random(n) < noise, rng.integers(0, N_CLASSES, n), y)
    return x, y, rng.uniform(0.5, 2.0, n).round(2)


def frame(spark, parts, n=3):
    rows = [(k, s, int(y), float(w), x.tolist()) for k, (xs, ys, ws) in parts.items() for s, (x, y, w) in enumerate(zip(xs, ys, ws, strict=True))]
    return spark.createDataFrame(rows, "k int, sample_id long, y int, weight double, x array<double>").repartition(n, "sample_id")


def plain(x, y, w, edges, s):
    """(start, trees): a tree is a nested tuple (feature, threshold, left, right, rows) or (value, rows); gains are tried one split at a time."""
    share = np.array([w[y == c].sum() for c in range(N_CLASSES)])
    start = np.log(share / share.sum())
    raw, rounds = np.tile(start, (len(x), 1)), []

    def grow(own, g, h, depth):
        gs, hs = g[own].sum(), h[own].sum()
        best = None
        for f in range(x.shape[1]) if depth else ():
            for e in edges[f]:
                left = own[x[own, f] <= e]
                if min(len(left), len(own) - len(left)) < s.min_rows:
                    continue
                a, b = g[left].sum(), h[left].sum()
                gain = (a * a / (b + s.ridge) + (gs - a) ** 2 / (hs - b + s.ridge) - gs * gs / (hs + s.ridge)) / 2
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, f, e
        if best is None:
            return -s.rate * gs / (hs + s.ridge), len(own)
        _, f, e = best
        side = x[own, f] <= e
        return f, e, grow(own[side], g, h, depth - 1), grow(own[~side], g, h, depth - 1), len(own)

    for _ in range(s.rounds):
        e = np.exp(raw - raw.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        trees = [grow(np.arange(len(x)), w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c]), s.depth) for c in range(N_CLASSES)]
        raw = raw + np.array([[value(t, row) for t in trees] for row in x])
        rounds.append(trees)
    return raw, rounds


def value(t, row):
    while len(t) == 5:
        t = t[2] if row[t[0]] <= t[1] else t[3]
    return t[0]


def shape(t):
    return (t[0], t[1], shape(t[2]), shape(t[3])) if len(t) == 5 else len(t)


def fitted_shape(model, r, p, c, n=0):
    if n >= model.feature.shape[-1] or not model.split[r, p, c, n]:
        return 2
    f, b = model.feature[r, p, c, n], model.bin[r, p, c, n]
    return int(f), float(model.edges[model.ks[p]][f][b]), fitted_shape(model, r, p, c, 2 * n + 1), fitted_shape(model, r, p, c, 2 * n + 2)


@pytest.fixture(scope="module")
def fitted(spark):
    parts, s = {0: planted(), 3: planted(60, seed=1)}, B.Settings(rounds=4, depth=3, bins=8, min_rows=3)
    rows = frame(spark, parts).persist()
    return parts, s, rows, B.fit(rows, N_CLASSES, s)


def test_like_the_plain_version(fitted):
    parts, s, rows, model = fitted
    got = {(r.k, r.sample_id): r for r in B.predict(rows, model, "sample_id").collect()}
    assert len(got) == sum(len(p[1]) for p in parts.values())
    for p, (k, (x, y, w)) in enumerate(parts.items()):
        raw, rounds = plain(x, y, w, model.edges[k], s)
        for r, trees in enumerate(rounds):
            assert [fitted_shape(model, r, p, c) for c in range(N_CLASSES)] == [shape(t) for t in trees], (k, r)
        for n in range(len(x)):
            assert got[k, n].raw == pytest.approx(list(raw[n]), abs=1e-9)
            assert sum(got[k, n].proba) == pytest.approx(1)


def test_groups_of_trees_give_the_same(spark, fitted, monkeypatch):
    _, s, rows, model = fitted
    monkeypatch.setattr(B, "HISTOGRAM", 5000)  # two trees a pass at the root, one below
    again = B.fit(rows.repartition(5), N_CLASSES, s)
    assert (again.feature == model.feature).all() and (again.bin == model.bin).all()
    assert np.abs(again.value - model.value).max() < 1e-12


def test_a_hundred_rounds_find_planted_classes(spark):
    x, y, w = planted(240, 6, seed=4, noise=0.0)
    train, held = frame(spark, {-1: (x[:160], y[:160], w[:160])}, 2), frame(spark, {-1: (x[160:], y[160:], w[160:])}, 2)
    model = B.fit(train, N_CLASSES, B.Settings(rounds=100, depth=2, rate=0.2, bins=16, features=0.8, rows=0.8, seed=3))
    assert len(model.feature) == 100
    got = B.predict(held, model, "sample_id", "y").collect()
    assert np.mean([int(np.argmax(r.proba)) == r.y for r in got]) > 0.97
    assert np.mean([r.proba[r.y] for r in got]) > 0.9


def test_wrong_inputs_stop(spark):
    x, y, w = planted(30)
    with pytest.raises(ContractError, match="no row of class 2"):
        B.fit(frame(spark, {0: (x[y < 2], y[y < 2], w[y < 2])}), N_CLASSES)
    x[3, 1] = np.nan
    with pytest.raises(ContractError, match="impute"):
        B.fit(frame(spark, {0: (x, y, w)}), N_CLASSES)
    with pytest.raises(ContractError, match="bins"):
        B.fit(frame(spark, {0: (x, y, w)}), N_CLASSES, B.Settings(bins=1000))


def expectation(by, x, known, at=0):
    """The tree's score where features outside `known` are averaged over covers."""
    n = by[at]
    if n.feature < 0:
        return np.array(n.value)
    if n.feature in known:
        return expectation(by, x, known, n.left if x[n.feature] <= n.threshold else n.right)
    return sum(by[c].cover / n.cover * expectation(by, x, known, c) for c in (n.left, n.right))


def by_subsets(trees, x, features):
    out = {}
    for i in features:
        others = [f for f in features if f != i]
        out[i] = sum(
            factorial(k) * factorial(len(others) - k) / factorial(len(features)) * sum(expectation(t, x, {*s, i}) - expectation(t, x, {*s}) for t in trees)
            for k in range(len(others) + 1) for s in combinations(others, k)
        )
    return out


def check_attributions(nodes, rows, xs, n_classes, most=T.MAX_PATHS):
    found = T.paths(nodes).persist()
    by = {}
    for n in nodes.collect():
        by.setdefault(n.tree, {})[n.node] = n
    phi = {(r.sample_id, r.feature): r.phi for r in T.tree_shap(rows, found, n_classes, most=most).collect()}
    features = sorted({f for _, f in phi})
    assert len(phi) == len(xs) * len(features)
    for s, x in xs.items():
        want = by_subsets(list(by.values()), x, features)
        for f in features:
            assert phi[s, f] == pytest.approx(list(want[f]), abs=1e-9)
    base = T.base_values(found, n_classes)
    assert base == pytest.approx(list(sum(expectation(t, None, set()) for t in by.values())), abs=1e-9)
    return found, base


def test_boosted_attributions_are_shapley_values(spark, fitted):
    parts, _, rows, model = fitted
    some = rows.filter("k = 3 and sample_id < 12")
    nodes = B.nodes(spark, model, 3)
    found, base = check_attributions(nodes, some, {s: parts[3][0][s] for s in range(12)}, N_CLASSES)
    scores = B.predict(some, model, "sample_id").select("sample_id", F.col("raw").alias("score"))
    phi = T.tree_shap(some, found, N_CLASSES)
    T.check_additive(phi, base, scores)
    with pytest.raises(ContractError, match="add up"):
        T.check_additive(phi.filter("feature <> 0"), base, scores)
    # Chunks of one tree each, and one class per row.
    again = {(r.sample_id, r.feature): r.phi for r in T.tree_shap(some, found, N_CLASSES, most=1).collect()}
    for r in T.tree_shap(some, found, N_CLASSES, target="y").join(some.select("sample_id", "y"), "sample_id").collect():
        assert r.phi == pytest.approx(again[r.sample_id, r.feature][r.y], abs=1e-12)


def test_forest_attributions_are_shapley_values(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x, y, w = planted(120, 5, seed=2)
    rows = frame(spark, {0: (x, y, w)})
    vectors = rows.withColumn("features", array_to_vector("x")).withColumnRenamed("y", "label")
    model = RandomForestClassifier(numTrees=4, maxDepth=4, seed=1).fit(vectors)
    nodes = T.forest_nodes(model, f"{tmp_path}/forest")
    some = rows.filter("sample_id < 10").persist()
    found, base = check_attributions(nodes, some, {s: x[s] for s in range(10)}, N_CLASSES)
    assert sum(base) == pytest.approx(1)
    scores = model.transform(vectors).select("sample_id", vector_to_array("probability").alias("score"))
    T.check_additive(T.tree_shap(rows, found, N_CLASSES), base, scores)
