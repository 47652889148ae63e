"""Resumable nested runs and the sequential search over them."""

import copy
import json

import numpy as np
import pytest
from cohortgrid.operators import nested, runs, search
from cohortgrid.operators.contracts import ContractError
from cohortgrid.sources import store
from pyspark.sql import functions as F

N, PROBES, CLASSES, OUTER, INNER = 96, 10, ["A", "B", "C"], 2, 3
CONFIG = {"run_name": "t", "model": "logistic", "seed": 1, "select_by": "macro_f1", "features": {"n_probes": [3, 6], "correct_material": [False]}, "model_params": {"c": [1.0]}}


@pytest.fixture(scope="module")
def tables(spark):
    rng, cells, samples = np.random.default_rng(0), [], []
    for s in range(N):
        c, outer = s % 3, (s // 3) % OUTER
        inner = [-1 if k == outer else (s // (3 * OUTER) + k) % INNER for k in range(OUTER)]
        samples.append((s, CLASSES[c], "FFPE" if rng.random() < 0.5 else "Frozen", outer, inner))
        x = rng.normal(0.5, 0.05, PROBES)
        x[c] += 0.3
        x[3 + c] -= 0.15
        cells += [(s, CLASSES[c], samples[-1][2], p, None if rng.random() < 0.02 else float(x[p])) for p in range(PROBES)]
    return (
        spark.createDataFrame(cells, "sample_id long, class string, material string, probe int, beta double").persist(),
        spark.createDataFrame(samples, "sample_id long, class string, material string, outer_fold int, inner array<int>").persist(),
        samples,
    )


def begin(tables, root, config=CONFIG):
    return runs.Run(tables[0], tables[1], config, f"file://{root}")


@pytest.fixture(scope="module")
def finished(tables, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    run = begin(tables, root)
    assert run.inner() == OUTER * INNER * 2
    return root, run


def probabilities(rows):
    return {(r.sample_id, r["class"]): r.p for r in rows.collect()}


def test_the_grid_and_refused_configurations():
    found = runs.settings_of({**CONFIG, "model_params": {"c": [0.1, 1.0]}})
    assert [(s["setting"], s["n_probes"], s["model_params"]["c"]) for s in found] == [("s000", 3, 0.1), ("s001", 3, 1.0), ("s002", 6, 0.1), ("s003", 6, 1.0)]
    for change, text in (({"select_by": "auc"}, "select_by"), ({"model": "x"}, "unknown model"), ({"features": {"n_probes": [3]}}, "exactly")):
        with pytest.raises(ContractError, match=text):
            runs.settings_of({**CONFIG, **change})
    with pytest.raises(ContractError, match="missing"):
        runs.settings_of({k: v for k, v in CONFIG.items() if k != "seed"})


def test_inner_fits_hold_their_folds_and_never_the_test_fold(spark, tables, finished):
    root, run = finished
    assert not [n for n in store.names(spark, f"{run.dir}/pred") if "test" in n or "tmp" in n]
    proba = run.load([(1, 2, "s001")])
    assert {r.sample_id for r in proba.select("sample_id").distinct().collect()} == {s[0] for s in tables[2] if s[4][1] == 2}
    assert sorted(r["class"] for r in proba.select("class").distinct().collect()) == CLASSES
    assert spark.read.parquet(f"{run.dir}/fits").count() == OUTER * INNER * 2
    # Cells of the left-out outer fold are poison: the fits are the same without them.
    poisoned = tables[0].join(tables[1].filter("outer_fold = 1").select("sample_id", F.lit(True).alias("bad")), "sample_id", "left").withColumn("beta", F.when(F.col("bad"), F.lit(float("nan"))).otherwise(F.col("beta"))).drop("bad")
    other = runs.Run(poisoned, tables[1], {**CONFIG, "run_name": "poison"}, f"file://{root}")
    other.inner([1], run.settings[:1])
    for j in range(INNER):
        assert probabilities(other.load([(1, j, "s000")])) == pytest.approx(probabilities(run.load([(1, j, "s000")])), abs=1e-9)


def test_a_stopped_run_goes_on_with_what_is_missing(spark, tables, finished):
    root, run = finished
    again = begin(tables, root)
    assert again.inner() == 0 and again.loaded == []
    before = probabilities(run.load([(1, 2, "s001")]))
    store.remove(spark, run.path(1, 2, "s001"))
    assert again.missing([0, 1], again.settings) == {1: [(2, again.settings[1])]}
    spark.range(1).write.parquet(run.path(1, 2, "s001") + ".tmp-abc")  # a fit that was cut off
    assert again.inner() == 1 and again.loaded == [(1, [2])]
    assert probabilities(again.load([(1, 2, "s001")])) == pytest.approx(before, abs=1e-9)


def test_changed_configuration_or_folds_are_refused(tables, finished):
    root, _ = finished
    other = copy.deepcopy(CONFIG)
    other["model_params"]["c"] = [5.0]
    with pytest.raises(ContractError, match="different settings"):
        begin(tables, root, other)
    moved = tables[1].withColumn("material", F.when(F.col("sample_id") == 0, "Other").otherwise(F.col("material")))
    with pytest.raises(ContractError, match="different settings"):
        runs.Run(tables[0], moved, CONFIG, f"file://{root}")


def test_choices_then_a_gated_outer_stage(spark, tables, finished, tmp_path):
    root, run = finished
    early = begin(tables, tmp_path)
    early.inner([0], early.settings[:1])
    with pytest.raises(ContractError, match="inner fits are missing"):
        early.select()
    with pytest.raises(ContractError, match="run select first"):
        run.outer(final_scoring=True)
    chosen = run.select()
    scores = {(r.k, r.setting): r.m for r in run.inner_scores([(k, s) for k in range(OUTER) for s in run.settings]).groupBy("k", "setting").agg(F.round(F.avg("macro_f1"), 12).alias("m")).collect()}
    for c in chosen:
        best = max(v for (k, _), v in scores.items() if k == c["outer"])
        assert c["setting"] == min(s for (k, s), v in scores.items() if k == c["outer"] and v == best)
    with pytest.raises(ContractError, match="final_scoring"):
        run.outer()
    assert run.outer(final_scoring=True) == OUTER and run.outer(final_scoring=True) == 0
    pooled = run.pooled()
    assert sorted(r.sample_id for r in pooled.filter("class = 'A'").collect()) == list(range(N))
    top = pooled.groupBy("sample_id").agg(F.max_by("class", "p").alias("c")).join(tables[1], "sample_id")
    assert top.filter("c = class").count() > 0.8 * N


def test_a_bad_prediction_file_stops(spark, finished, tables):
    _, run = finished
    kept = spark.read.parquet(run.path(0, 0, "s000")).collect()
    schema = "sample_id long, proba array<double>"
    for rows, text in (([(999, [1.0, 0.0, 0.0]), *kept], "its fold"), (kept[1:], "its fold"), ([*kept, kept[0]], "repeat"), ([(kept[0].sample_id, [0.5, 0.0, 0.0]), *kept[1:]], "distribution")):
        store.remove(spark, run.path(0, 0, "s000"))
        store.write_table(spark.createDataFrame([tuple(r) for r in rows], schema), run.path(0, 0, "s000"))
        with pytest.raises(ContractError, match=text):
            run.load([(0, 0, "s000")])
    store.remove(spark, run.path(0, 0, "s000"))
    store.write_table(spark.createDataFrame([tuple(r) for r in kept], schema), run.path(0, 0, "s000"))


def test_a_training_side_without_every_class_stops(tables, tmp_path):
    gone = tables[1].withColumn("inner", F.when(F.col("class") == "C", F.array(F.when(F.col("outer_fold") == 0, -1).otherwise(0), F.get("inner", F.lit(1)))).otherwise(F.col("inner")))
    with pytest.raises(ContractError, match="lack a class"):
        runs.Run(tables[0], gone, CONFIG, f"file://{tmp_path}").inner([0])


def test_a_split_without_both_materials_stops(tables, tmp_path):
    config = {**CONFIG, "features": {"n_probes": [6], "correct_material": [True]}}
    alone = tables[0].withColumn("material", F.when(F.col("sample_id") < 60, "FFPE").otherwise("Frozen")).filter("sample_id < 60")
    with pytest.raises(Exception, match="fewer than 50 probes"):
        runs.Run(tables[0], tables[1], {**CONFIG, "run_name": "many", "features": {"n_probes": [50], "correct_material": [False]}}, f"file://{tmp_path}").inner([0])
    with pytest.raises(Exception, match="each material"):
        runs.Run(alone, tables[1].filter("sample_id < 60"), config, f"file://{tmp_path}").inner([0])


@pytest.mark.parametrize("model,params", [("boosting", {"rounds": [3], "depth": [2], "bins": [8], "rate": [0.5]}), ("forest", {"trees": [5], "depth": [4]})])
def test_other_models(tables, tmp_path, model, params):
    config = {**CONFIG, "model": model, "model_params": params, "features": {"n_probes": [6], "correct_material": [True]}}
    run = begin(tables, tmp_path, config)
    assert run.inner([0]) == INNER
    assert run.inner_scores([(0, run.settings[0])]).agg(F.avg("accuracy")).first()[0] > 0.7


SPACE = {"n_probes": {"int": [2, 8]}, "floor": {"float": [1e-5, 1e-1], "log": True}}


def test_a_resumed_search_is_an_unbroken_one(spark, tables, tmp_path):
    cells, folds, _ = tables
    objective, calls = nested.centroid_objective(cells, folds, folds.select("sample_id", F.col("class").alias("truth"))), []
    counted = lambda asked: calls.append(asked) or objective(asked)
    go = lambda n, where, seed=4: search.search(spark, SPACE, [0, 1], n, counted, f"file://{tmp_path}/{where}", seed)
    whole = go(7, "a").collect()
    assert len(calls) == 7 and len(whole) == 14
    go(4, "b")
    resumed = go(7, "b").collect()
    assert len(calls) == 14
    key = lambda r: (r.trial, r.outer, r.setting, r["values"], round(r.score, 9))
    assert sorted(map(key, whole)) == sorted(map(key, resumed))
    best = {r.outer: r for r in search.best_trials(spark.createDataFrame(whole)).collect()}
    for k in (0, 1):
        top = max(r.score for r in whole if r.outer == k)
        assert best[k].trial == min(r.trial for r in whole if r.outer == k and r.score == top)
    with pytest.raises(ContractError, match="different settings"):
        go(7, "b", seed=5)


def test_a_search_over_stored_fits(spark, tables, tmp_path):
    run = begin(tables, tmp_path)
    space = {"n_probes": {"choice": [3]}, "correct_material": {"choice": [False]}, "c": {"float": [0.1, 10.0], "log": True}}
    go = lambda: search.search(spark, space, [0], 1, search.run_objective(run, {}), f"file://{tmp_path}/log").collect()
    first, n = go(), len(run.loaded)
    store.remove(spark, f"file://{tmp_path}/log/trial-00000")  # stopped before the trial was told
    assert go() == first and len(run.loaded) == n == 1 and 0 < first[0].score <= 1


def test_asked_values_lie_in_the_space_and_gather_where_the_loss_is_low():
    space = {"x": {"float": [0.001, 10.0], "log": True}, "n": {"int": [1, 40]}, "c": {"choice": ["a", "b", "c"]}}
    loss = lambda v: (np.log(v["x"]) - np.log(0.1)) ** 2 + ((v["n"] - 30) / 10) ** 2 + (v["c"] != "b")
    late, early = [], []
    for seed in range(8):
        told = []
        for t in range(40):
            v = search.ask(space, told, seed, 0, t)
            assert 0.001 <= v["x"] <= 10 and 1 <= v["n"] <= 40 and isinstance(v["n"], int) and v["c"] in "abc"
            assert v == search.ask(space, told, seed, 0, t)
            told.append((v, loss(v)))
        early += [x for _, x in told[:10]]
        late += [x for _, x in told[-10:]]
    assert np.median(late) < 0.8 * np.median(early)


def test_wrong_spaces_and_scores_stop(spark, tmp_path):
    for spec, text in (({}, "exactly one"), ({"int": [1]}, "low, high"), ({"float": [0, 1], "log": True}, "log scale"), ({"int": [1, 2], "choice": [1]}, "exactly one")):
        with pytest.raises(ContractError, match=text):
            search.check_space({"a": spec})
    with pytest.raises(ContractError, match="finite"):
        search.search(spark, SPACE, [0], 1, lambda asked: {0: float("nan")}, f"file://{tmp_path}/log")
    assert json.loads(store.read_text(spark, f"file://{tmp_path}/log/manifest.json"))["folds"] == [0]
