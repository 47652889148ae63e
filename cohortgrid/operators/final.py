"""The final fit: all chosen models on all samples, over feature tables that models share.

Features are fitted once per feature setting, kept, and saved beside the models (probes and
the rows' values); each model is saved, read again, and must give the same scores from
what was read, or the run stops. Written under another name and renamed: what exists is
whole, and a second run does only what is missing.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store
from . import boosting, softmax, trees
from .contracts import fail, none_of
from .features import by_split
from .runs import FEATURES, weighted

MOST = 1e-5


def _forest(rows: DataFrame, params: dict, n_classes: int, seed: int, path: str):
    v = rows.withColumn("features", array_to_vector("x")).withColumn("label", F.col("class").cast("double"))
    fitted = RandomForestClassifier(weightCol="weight", featureSubsetStrategy="sqrt", seed=seed, numTrees=params.get("trees", 100), maxDepth=params.get("depth", 8)).fit(v)
    fitted.write().save(path)
    of = lambda m: m.transform(v).select("sample_id", vector_to_array("probability").alias("p"))
    return of(fitted), lambda at: of(RandomForestClassificationModel.load(at))


def _boosting(rows: DataFrame, params: dict, n_classes: int, seed: int, path: str):
    """Saved as nodes: what reads them needs no more than a walk down the trees."""
    fitted = boosting.fit(rows.select(F.col("s").alias("k"), "sample_id", F.col("class").alias("y"), "weight", "x"), n_classes, boosting.Settings(seed=seed, **params))
    boosting.nodes(rows.sparkSession, fitted, -1).write.parquet(path)
    was = boosting.predict(rows.withColumnRenamed("s", "k"), fitted, "sample_id").select("sample_id", F.col("raw").alias("p"))
    return was, lambda at: trees.path_scores(rows, trees.paths(rows.sparkSession.read.parquet(at)), n_classes).select("sample_id", F.col("score").alias("p"))


def _logistic(rows: DataFrame, params: dict, n_classes: int, seed: int, path: str):
    pick, n_features = ("raw", float(params["c"])), len(rows.first()["x"])
    x = rows.select(F.col("s").alias("k"), F.lit(0).alias("j"), "sample_id", F.col("class").alias("y"), "x").persist()
    fits = softmax.fit(x, [(-1, -1, *pick)], n_classes, n_features, tolerance=params.get("tolerance", 1e-4))
    fits.table(rows.sparkSession).write.parquet(path)
    of = lambda f: softmax.applied(x, f, {-1: pick}, on=-1).select("sample_id", F.col("x").alias("p"))
    return of(fits), lambda at: of(softmax.Fits.read(rows.sparkSession.read.parquet(at)))


MODELS = {"forest": _forest, "boosting": _boosting, "logistic": _logistic}


def fit_all(cells: DataFrame, choices: list[dict], root: str, seed: int = 42) -> list[dict]:
    """choices: name, model, n_probes, correct_material, params. A row per model that was fitted now: name, n_samples, n_features, largest difference after reading again."""
    spark, out = cells.sparkSession, []
    if len({c["name"] for c in choices}) != len(choices):
        fail("two models of one name")
    if unknown := [c["model"] for c in choices if c["model"] not in MODELS]:
        fail(f"unknown model {unknown[0]!r}")
    classes = [r[0] for r in cells.select("class").distinct().orderBy("class").collect()]
    groups: dict[tuple, list[dict]] = {}
    for c in choices:
        if not store.exists(spark, f"{root}/{c['name']}"):
            groups.setdefault(tuple(c[f] for f in FEATURES), []).append(c)
    for features, own in groups.items():
        options, at = dict(zip(FEATURES, features, strict=True)), f"{root}/features-{features[0]}-{int(features[1])}"
        splits = cells.select(F.lit(-1).alias("s"), "sample_id", F.lit(False).alias("held")).distinct()
        if not store.exists(spark, at):
            vectors, probes = by_split(cells, splits, options["n_probes"], correct_material=options["correct_material"])
            number = F.array_position(F.array(*map(F.lit, classes)), F.col("class")) - 1
            store.write_table(weighted(vectors.withColumn("class", number.cast("int"))), at)
            store.write_table(probes.select("probe"), f"{at}-probes")
        rows = spark.read.parquet(at).persist()
        none_of(rows.filter(F.exists("x", lambda v: v.isNull() | F.isnan(v))).select("sample_id"), "a missing value after the feature pipeline")
        for c in own:
            made = f"{root}/{c['name']}.tmp-{np.random.default_rng().integers(1 << 62):x}"
            was, again = MODELS[c["model"]](rows, c["params"], len(classes), seed, made)
            off = F.array_max(F.transform(F.arrays_zip(F.col("p"), F.col("q")), lambda z: F.abs(z["p"] - z["q"])))
            both = was.join(again(made).withColumnRenamed("p", "q"), "sample_id", "full_outer").select("sample_id", off.alias("off"))
            n, most, missing = both.agg(F.count(F.lit(1)), F.max("off"), F.count(F.when(F.col("off").isNull(), 1))).first()
            if missing or most > MOST:
                fail(f"{c['name']}: what was read again gives other scores (largest difference {most})")
            store.commit(spark, made, f"{root}/{c['name']}")
            out.append({"name": c["name"], "n_samples": n, "n_features": len(rows.first()["x"]), "difference": float(most)})
        rows.unpersist()
    return out
