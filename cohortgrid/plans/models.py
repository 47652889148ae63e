"""Queries over fitted models: boosting over all outer folds, attributions of a forest, a resumable nested run, a sequential search.

Fits can't be said in SQL; they are held against plain versions in tests/test_boosting.py, tests/test_runs.py and tests/test_calibration.py.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, embedding, final, nested, runs, search, trees
from ..operators import features as X
from ..operators import metrics as M
from ..sources import store
from .base import cells, folds, query, rounded, samples, truth

N_CLASSES, N_PROBES = 10, 32


def outer_splits(spark, sf):
    """s, sample_id, held: each outer fold is held out in one of five splits."""
    f = folds(spark, sf)
    return f.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s"), "sample_id", "outer_fold").select("s", "sample_id", (F.col("outer_fold") == F.col("s")).alias("held"))


def outer_rows(spark, sf):
    """Feature rows of all five splits, as the models take them."""
    return runs.weighted(X.by_split(cells(spark, sf), outer_splits(spark, sf), N_PROBES)[0]).persist()


@query()
def boosting_outer(spark, sf):
    """Every sample's class by softmax boosting on the outer folds that it isn't in."""
    rows = outer_rows(spark, sf)
    fitted = boosting.fit(rows.filter("not held").withColumnsRenamed({"s": "k", "class": "y"}), N_CLASSES, boosting.Settings(rounds=8, depth=3, rate=0.3, bins=32))
    out = boosting.predict(rows.filter("held").withColumnRenamed("s", "k"), fitted, "sample_id", "class")
    return out.select("sample_id", F.col("k").alias("outer"), "class", (F.array_position("proba", F.array_max("proba")) - 1).cast("int").alias("predicted"), F.round(F.array_max("proba"), 6).alias("confidence"))


@query()
def tree_attribution(spark, sf):
    """Per class and probe, over the class's samples: mean absolute and signed attribution to the class's score by a forest of all samples, and the probe's rank. Attributions are checked to add up to every class's score."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    splits = samples(spark, sf).select(F.lit(-1).alias("s"), "sample_id", F.lit(False).alias("held"))
    vectors, probes = X.by_split(cells(spark, sf), splits, N_PROBES)
    rows = runs.weighted(vectors).withColumn("features", array_to_vector("x")).persist()
    fitted = RandomForestClassifier(labelCol="class", weightCol="weight", numTrees=20, maxDepth=5, seed=1).fit(rows)
    found = trees.paths(trees.forest_nodes(fitted, store.scratch(spark, "forest"))).persist()
    phi = trees.tree_shap(rows, found, N_CLASSES, keep=("sample_id", "class")).persist()
    trees.check_additive(phi, trees.base_values(found, N_CLASSES), fitted.transform(rows).select("sample_id", vector_to_array("probability").alias("score")))
    own = F.get("phi", F.col("class"))
    per = phi.groupBy("class", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(own)).alias("mean_abs"), F.avg(own).alias("mean"))
    # The order of features is that of probes: a row per feature.
    names = F.array_sort(F.collect_set("probe"))
    named = per.join(F.broadcast(probes.agg(names.alias("probes"))), F.lit(True)).withColumn("probe", F.get("probes", F.col("feature")))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc(F.round("mean_abs", 12)), "probe"))  # a row per probe
    return rounded(named.select("class", "probe", "n", "mean_abs", "mean", rank.alias("rank")), "mean_abs", "mean", places=9)


RUN = {"run_name": "nested_boosting", "model": "boosting", "seed": 42, "select_by": "macro_f1", "features": {"n_probes": [N_PROBES], "correct_material": [True]}, "model_params": {"rounds": [2], "depth": [1], "bins": [16], "rate": [0.1, 0.5]}}


@query()
def nested_run(spark, sf):
    """Inner, select and outer stage of boosting in a store of fits: pooled scores of every sample at class and family level, with the number of fits."""
    table = folds(spark, sf).join(samples(spark, sf).select("sample_id", "material"), "sample_id").persist()
    run = runs.Run(cells(spark, sf).persist(), table, RUN, store.scratch(spark, "run"), at_once=5)
    n = run.inner()
    run.select()
    n += run.outer(final_scoring=True)
    from .calibration import family, two_levels

    scores = run.pooled().withColumn("scope", F.lit("pooled")).select("scope", "sample_id", "class", "p")
    return rounded(two_levels(scores, truth(spark, sf), family(spark, sf), ["scope"]).drop("scope"), *M.METRICS).withColumn("n_fits", F.lit(n))


SPACE, TRIALS = {"n_probes": {"int": [4, 60], "log": True}, "floor": {"float": [1e-5, 1e-1], "log": True}}, 20


@query()
def sequential_search(spark, sf):
    """Twenty trials per outer fold, each asked after the ones before were told, over the nearest centroid's inner scores."""
    objective = nested.centroid_objective(cells(spark, sf), folds(spark, sf), truth(spark, sf))
    log = search.search(spark, SPACE, list(range(5)), TRIALS, objective, store.scratch(spark, "search"), seed=42)
    best = search.best_trials(log).select("outer", "trial", F.lit(True).alias("best"))
    return rounded(log.join(best, ["outer", "trial"], "left").select("outer", "trial", "setting", "values", "score", F.coalesce("best", F.lit(False)).alias("best")), "score")


@query()
def embedding_associations(spark, sf):
    """The ten largest principal components of all samples' probes: share of variance, and how much of each component class, family, material and cohort explain."""
    splits = samples(spark, sf).select(F.lit(-1).alias("s"), "sample_id", F.lit(False).alias("held"))
    rows = X.by_split(cells(spark, sf), splits, 48)[0].persist()
    scores = embedding.project(rows, embedding.principal_components(rows, 10), "sample_id").join(samples(spark, sf).drop("embedding"), "sample_id").persist()
    out = None
    for c in ("class", "family", "material", "cohort"):
        part = X.eta_squared(scores, "score", c, "component").withColumnRenamed("eta_squared", c)
        out = part if out is None else out.join(part, "component")
    return rounded(out.join(scores.select("component", "share").distinct(), "component"), "class", "family", "material", "cohort", "share")


FINAL = [
    {"name": "forest", "model": "forest", "n_probes": N_PROBES, "correct_material": True, "params": {"trees": 20, "depth": 5}},
    {"name": "boosting", "model": "boosting", "n_probes": N_PROBES, "correct_material": True, "params": {"rounds": 3, "depth": 2, "bins": 16}},
    {"name": "logistic", "model": "logistic", "n_probes": N_PROBES, "correct_material": True, "params": {"c": 0.01}},
]


@query()
def final_models(spark, sf):
    """Three models fitted on all samples over one shared feature table, saved, read again and compared."""
    found = final.fit_all(cells(spark, sf).persist(), FINAL, store.scratch(spark, "final"))
    return spark.createDataFrame([(r["name"], r["n_samples"], r["n_features"], r["difference"] <= final.MOST) for r in found], "name string, n_samples long, n_features int, same boolean")
