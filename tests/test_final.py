"""The final fit: shared features, saved models that are read again, stops and resumption."""

import numpy as np
import pytest
from cohortgrid.operators import final, trees
from cohortgrid.operators.contracts import ContractError
from cohortgrid.sources import store

FEATURES = {"n_probes": 4, "correct_material": False}
CHOICES = [
    {"name": "f", "model": "forest", **FEATURES, "params": {"trees": 4, "depth": 3}},
    {"name": "b", "model": "boosting", **FEATURES, "params": {"rounds": 2, "depth": 2, "bins": 8}},
    {"name": "l", "model": "logistic", **FEATURES, "params": {"c": 1.0}},
]


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    rows = [(s, "ABC"[s % 3], "FFPE", p, float(rng.normal(0.3 + 0.2 * (p == s % 3), 0.05))) for s in range(60) for p in range(6)]
    return spark.createDataFrame(rows, "sample_id long, class string, material string, probe int, beta double").persist()


def test_models_share_features_and_read_back_alike(spark, cells, tmp_path):
    root = f"file://{tmp_path}"
    found = final.fit_all(cells, CHOICES[:2], root)
    assert [(r["name"], r["n_samples"], r["n_features"]) for r in found] == [("f", 60, 4), ("b", 60, 4)] and all(r["difference"] <= 1e-9 for r in found)
    assert {n for n in store.names(spark, root) if n.startswith("features")} == {"features-4-0", "features-4-0-probes"}
    # The kept feature table serves the model that is still missing; finished ones stay.
    before = store.names(spark, f"{root}/f")
    again = final.fit_all(cells.filter("sample_id >= 0"), CHOICES, root)
    assert [r["name"] for r in again] == ["l"] and store.names(spark, f"{root}/f") == before
    assert not [n for n in store.names(spark, root) if "tmp" in n]
    rows = spark.read.parquet(f"{root}/features-4-0")
    raw = trees.path_scores(rows, trees.paths(spark.read.parquet(f"{root}/b")), 3, most=1)
    top = {r.sample_id: int(np.argmax(r.score)) for r in raw.collect()}
    assert np.mean([top[s] == s % 3 for s in range(60)]) > 0.9


def test_a_model_that_reads_back_otherwise_stops(spark, cells, tmp_path, monkeypatch):
    root, good = f"file://{tmp_path}", final.MODELS["logistic"]

    def broken(rows, *args):
        was, again = good(rows, *args)
        return was, lambda at: again(at).selectExpr("sample_id", "transform(p, x -> x + 0.001) AS p")

    monkeypatch.setitem(final.MODELS, "logistic", broken)
    with pytest.raises(ContractError, match="other scores"):
        final.fit_all(cells, CHOICES[2:], root)
    assert not store.exists(spark, f"{root}/l")
    with pytest.raises(ContractError, match="unknown model"):
        final.fit_all(cells, [{**CHOICES[0], "model": "x"}], root)
    with pytest.raises(ContractError, match="one name"):
        final.fit_all(cells, CHOICES[:1] * 2, root)
