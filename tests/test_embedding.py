"""Principal components against NumPy's."""

import numpy as np
import pytest
from cohortgrid.operators import embedding as E
from cohortgrid.operators.contracts import ContractError


def frame(spark, x, parts=3):
    return spark.createDataFrame([(s, r.tolist()) for s, r in enumerate(x)], "sample_id long, x array<double>").repartition(parts)


def plain(x, k):
    c = x - x.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    w = v[:k].T
    w = w * np.sign(w[np.abs(w).argmax(0), range(k)])
    return c @ w, s[:k] ** 2 / (s**2).sum(), s[:k] ** 2 / (len(x) - 1)


@pytest.mark.parametrize("shape,decay,extra", [((150, 40), 0.9, 5), ((60, 25), 1.0, 3), ((30, 80), 0.8, 4)])
def test_like_numpy(spark, shape, decay, extra):
    rng = np.random.default_rng(shape[0])
    x = rng.normal(size=shape) * decay ** np.arange(shape[1]) + 5
    rows = frame(spark, x).persist()
    found = E.principal_components(rows, 4, extra=extra)
    scores, share, variance = plain(x, 4)
    assert found.share == pytest.approx(share, abs=1e-8) and found.variance == pytest.approx(variance, rel=1e-7)
    got = np.zeros_like(scores)
    for r in E.project(rows, found, "sample_id").collect():
        got[r.sample_id, r.component] = r.score
        assert r.share == pytest.approx(share[r.component], abs=1e-8)
    assert np.abs(got - scores).max() < 1e-6
    assert found.passes < 12


def test_few_directions_and_wrong_inputs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 30))  # two directions only
    found = E.principal_components(frame(spark, x), 4)
    assert found.share[:2].sum() == pytest.approx(1) and found.share[2:] == pytest.approx([0, 0], abs=1e-9)
    assert E.principal_components(frame(spark, np.ones((5, 3))), 2).share.tolist() == [0, 0]
    with pytest.raises(ContractError, match="components of"):
        E.principal_components(frame(spark, x[:3]), 4)
    x[2, 3] = np.nan
    with pytest.raises(ContractError, match="impute"):
        E.principal_components(frame(spark, x), 2)
    with pytest.raises(ContractError, match="no rows"):
        E.principal_components(spark.createDataFrame([], "sample_id long, x array<double>"), 2)
