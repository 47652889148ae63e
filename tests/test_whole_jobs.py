"""Registered queries that fit do the rounds and trials that their methods need."""

import numpy as np
from cohortgrid.operators import boosting, nested, runs, search
from cohortgrid.plans.catalogue import QUERIES
from pyspark.sql import functions as F


def written(spark, path, x, labels):
    rows = [(n, [float(v) for v in row], int(y)) for n, (row, y) in enumerate(zip(x, labels, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"file://{path}/embeddings.parquet")
    return f"file://{path}"


def test_boosting_goes_beyond_what_one_tree_can_tell(spark, tmp_path):
    x = np.random.default_rng(0).random((600, 16))
    found = QUERIES["ovr_boosting"](spark, written(spark, tmp_path, x, x[:, :5].sum(1) > 2.5)).collect()
    assert len(found) == 120 and np.mean([r["class"] == r["predicted"] for r in found]) > 0.8


def test_most_trials_of_the_search_are_asked_after_what_was_told(spark):
    log = QUERIES["sequential_search"](spark, "/root/testdata/sf0.001").groupBy("outer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trial") >= search.STARTUP).alias("asked")).collect()
    assert len(log) == 5 and all(r["n"] == 20 and r["asked"] > r["n"] / 2 for r in log)


def test_scores_of_trials_are_those_of_plain_distances(spark):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(s, s % 3, p, None if rng.random() < 0.1 else float(rng.random() + 0.2 * (s % 3 == p % 3))) for s in range(60) for p in range(8)], "sample_id long, class int, probe int, beta double").persist()
    folds = spark.createDataFrame([(s, s % 3, (o := s // 3 % 2), [-1 if k == o else s // 6 % 3 for k in range(2)]) for s in range(60)], "sample_id long, class int, outer_fold int, inner array<int>").persist()
    truth = folds.select("sample_id", F.col("class").alias("truth"))
    objective = nested.centroid_objective(cells, folds, truth)
    for asked in ({0: {"n_probes": 3, "floor": 1e-3}, 1: {"n_probes": 7, "floor": 0.1}}, {1: {"n_probes": 2, "floor": 0.01}}):
        found = objective(asked)
        assert found.keys() == asked.keys()
        for k, v in asked.items():
            d = nested.held_out_distances(cells, nested.inner_dealt(folds).filter(F.col("k") == k), [v["n_probes"]], v["floor"])
            nearest = d.groupBy("k", "j", "setting", "sample_id").agg(F.min_by("class", F.struct(F.round("distance", 6), "class")).alias("predicted"))
            want = nested.setting_scores(nearest, truth).agg(F.avg("macro_f1")).first()[0]
            assert abs(found[k] - want) < 1e-12


def test_settings_of_a_run_share_bin_edges(spark, tmp_path, monkeypatch):
    rng, made, edges = np.random.default_rng(2), [], boosting.bin_edges
    monkeypatch.setattr(boosting, "bin_edges", lambda rows, bins: made.append(bins) or edges(rows, bins))
    cells = spark.createDataFrame([(s, "ab"[s % 2], "FFPE", p, float(rng.random() + 0.3 * (s % 2 == p % 2))) for s in range(48) for p in range(4)], "sample_id long, class string, material string, probe int, beta double").persist()
    folds = spark.createDataFrame([(s, "ab"[s % 2], "FFPE", (o := s // 2 % 2), [-1 if k == o else s // 4 % 3 for k in range(2)]) for s in range(48)], "sample_id long, class string, material string, outer_fold int, inner array<int>").persist()
    begin = lambda name, rates, bins: runs.Run(cells, folds, {"run_name": name, "model": "boosting", "seed": 1, "select_by": "macro_f1", "features": {"n_probes": [3], "correct_material": [False]}, "model_params": {"rounds": [2], "depth": [1], "bins": bins, "rate": rates}}, f"file://{tmp_path}")
    both = begin("both", [0.1, 0.5], [4, 8])
    assert both.inner([0]) == 12 and sorted(made) == [4, 8]
    alone = begin("alone", [0.5], [8])
    assert alone.inner([0]) == 3
    rows = lambda run, name: sorted((r.j, r.sample_id, r["class"], round(r.p, 12)) for r in run.load([(0, j, name) for j in range(3)]).collect())
    name = next(s["setting"] for s in both.settings if s["model_params"] == alone.settings[0]["model_params"])
    assert rows(both, name) == rows(alone, "s000")
