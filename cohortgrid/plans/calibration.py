"""Queries over calibrated scores: candidates, choices, and metrics before and after, on inner folds and on the outer ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as K
from ..operators import metrics as M
from ..operators import nested as N
from ..operators.models import centroid_scores
from .base import cells, folds, query, rounded, samples, truth
from .nested import SIZES


def chosen_scores(spark, sf):
    """Held-out scores of the nearest centroid with each outer fold's chosen setting: of inner folds (k, j) and of the outer folds themselves (k, j -1)."""
    c, f = cells(spark, sf), folds(spark, sf)
    inner = N.block_distances(c, N.inner_dealt(f), sizes=SIZES).persist()
    found = inner.groupBy("k", "j", "setting", "sample_id").agg(F.min_by("class", F.struct(F.round("distance", 6), "class")).alias("predicted"))
    best = N.select_settings(N.setting_scores(found, truth(spark, sf))).select(F.col("outer").alias("k"), "setting")
    outer = N.block_distances(c, N.outer_dealt(f), sizes=SIZES).select(F.col("j").alias("k"), F.lit(-1).alias("j"), "setting", "sample_id", "class", "distance", "n_obs")
    pick = lambda d: centroid_scores(d.join(best, ["k", "setting"]).drop("setting"), "k", "j")
    return pick(inner), pick(outer), best


def calibrated(spark, sf, transforms=K.softmax.TRANSFORMS, cs=K.CS):
    """Everything that the queries tell: rows of inner and outer scores, candidates, choices and fits."""
    inner, outer, best = chosen_scores(spark, sf)
    t = truth(spark, sf)
    classes = K.class_order(t)
    rows = K.score_rows(inner, t, classes).persist()
    found, fits = K.candidates(rows, len(classes), transforms, cs)
    return rows, K.score_rows(outer, t, classes), classes, best, found, fits


def family(spark, sf):
    return samples(spark, sf).select("class", "family").distinct()


def two_levels(scores, truths, families, by):
    """metrics.summary() at class and at family level. scores: by, sample_id, class, p; truths: sample_id, truth."""
    of_family = scores.join(families, "class").groupBy(*by, "sample_id", F.col("family").alias("class")).agg(F.sum("p").alias("p"))
    up = truths.join(families.withColumnRenamed("class", "truth"), "truth").select("sample_id", F.col("family").alias("truth"))
    one = lambda s, t, level: M.summary(M.scored_rows(s, t, *by), *by).withColumn("level", F.lit(level))
    return one(scores, truths, "class").unionByName(one(of_family, up, "family"))


@query()
def calibration_candidates(spark, sf):
    """Held-out log loss of every candidate of every outer fold."""
    *_, best, found, _ = calibrated(spark, sf)
    table = spark.createDataFrame([(k, n, how, c, loss, ok) for n, (k, how, c, loss, ok) in enumerate(found)], "outer int, candidate int, transform string, c double, log_loss double, converged boolean")
    return rounded(table.join(best.withColumnRenamed("k", "outer"), "outer"), "log_loss")


@query()
def calibration_metrics(spark, sf):
    """Inner folds' metrics before and after calibration, by material and in all, at class and family level."""
    rows, _, classes, _, found, fits = calibrated(spark, sf)
    after = K.softmax.applied(rows, fits, K.select(found))
    stages = K.as_scores(rows, classes).withColumn("stage", F.lit("before")).unionByName(K.as_scores(after, classes).withColumn("stage", F.lit("after")))
    grouped = stages.join(samples(spark, sf).select("sample_id", "material"), "sample_id").withColumn("group", F.explode(F.array(F.lit("all"), F.col("material"))))
    out = two_levels(grouped.select(F.col("k").alias("outer"), "stage", "group", "sample_id", "class", "p"), truth(spark, sf), family(spark, sf), ["outer", "stage", "group"])
    return rounded(out, *M.METRICS)


@query()
def calibrated_outer(spark, sf):
    """Every sample's scores, by the calibrator that all inner folds of its outer fold's training side chose and fitted."""
    rows, outer, classes, _, found, _ = calibrated(spark, sf)
    chosen = K.select(found)
    after = K.softmax.applied(outer, K.final_fits(rows, chosen, len(classes)), chosen, on=-1)
    return rounded(K.as_scores(after, classes).select("sample_id", F.col("k").alias("outer"), "class", "p"), "p")
