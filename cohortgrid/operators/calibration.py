"""Cross-calibration of held-out scores, chosen and checked on inner folds only.

scores: k (outer fold that is left out), j (inner fold that the sample is in), sample_id,
class, p, by models that haven't seen the sample. For each k every candidate (transform,
c) is fitted on two inner folds' scores and judged on the third's; the best by mean
held-out log loss, the first of equals, then calibrates: inner folds by the fits without
them, the outer fold k by a fit on all inner folds. No fit of k sees a row of outer fold k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import softmax
from .contracts import fail, none_of, unique_key

#: Smaller is a stronger penalty.
CS = (0.01, 0.1, 1.0, 10.0, 100.0)


def class_order(truth: DataFrame) -> list:
    """Sorted classes (a value per class; few)."""
    return [r[0] for r in truth.select("truth").distinct().orderBy("truth").collect()]


def score_rows(scores: DataFrame, truth: DataFrame, classes: list) -> DataFrame:
    """k, j, sample_id, y, x: a row per sample and k, its scores in the order of classes. A sample without a score for each class, or with a class that isn't known, is an error."""
    order = F.array(*map(F.lit, classes))
    rows = scores.groupBy("k", "j", "sample_id").agg(F.array_sort(F.collect_list(F.struct((F.array_position(order, F.col("class")) - 1).alias("n"), "p"))).alias("v")).join(truth, "sample_id")
    whole = F.transform("v", lambda s: s["n"].cast("int")) == F.sequence(F.lit(0), F.lit(len(classes) - 1))
    y = F.array_position(order, F.col("truth")) - 1
    bad = F.raise_error(F.format_string("ERROR: sample %s lacks a class, or has one that isn't known", F.col("sample_id").cast("string")))
    return rows.select(F.col("k").cast("int"), F.col("j").cast("int"), "sample_id", F.when(whole & (y >= 0), y.cast("int")).otherwise(bad.cast("int")).alias("y"), F.transform("v", lambda s: s["p"].cast("double")).alias("x"))


def check_inner(scores: DataFrame, folds: DataFrame) -> None:
    """folds: sample_id, outer_fold, inner (array by outer fold). Scores of outer fold k's own samples, or under another inner fold than the sample's, stop the run."""
    met = scores.select("k", "j", "sample_id").distinct().join(folds, "sample_id", "left")
    none_of(met.filter("outer_fold is null"), "scores of a sample without folds")
    none_of(met.filter("outer_fold = k").select("k", "sample_id"), "scores of the outer test fold among the inner ones")
    none_of(met.filter(F.get("inner", F.col("k")) != F.col("j")).select("k", "j", "sample_id"), "scores under another inner fold than the sample's")
    unique_key(met, "k", "sample_id")


def candidates(rows: DataFrame, n_classes: int, transforms: tuple[str, ...] = softmax.TRANSFORMS, cs: tuple[float, ...] = CS) -> tuple[list[tuple], softmax.Fits]:
    """(k, how, c, mean held-out log loss, converged) in the order in which ties are settled, and the fits behind them. rows: score_rows(), best persisted."""
    sides = sorted(map(tuple, rows.select("k", "j").distinct().collect()))  # folds
    ks = sorted({k for k, _ in sides})
    problems = [p for k in ks for p in softmax.grid([k], [j for kk, j in sides if kk == k], transforms, cs)]
    fits = softmax.fit(rows, problems, n_classes, n_classes)
    losses, out = softmax.held_out_losses(rows, fits), []
    for k in ks:
        for how in transforms:
            for c in cs:
                own = [p for p in problems if (p[0], p[2], p[3]) == (k, how, c)]
                out.append((k, how, c, sum(losses[p][1] for p in own) / len(own), all(fits.converged[p] for p in own)))
    return out, fits


def select(found: list[tuple]) -> dict[int, tuple[str, float]]:
    """k -> (how, c): the least held-out loss, the first of equals."""
    best: dict[int, tuple] = {}
    for k, how, c, loss, _ in found:
        if k not in best or loss < best[k][2]:
            best[k] = how, c, loss
    if not best:
        fail("no candidates")
    return {k: v[:2] for k, v in best.items()}


def final_fits(rows: DataFrame, chosen: dict[int, tuple[str, float]], n_classes: int) -> softmax.Fits:
    """For each k its chosen candidate on all inner folds (j is -1)."""
    return softmax.fit(rows, [(k, -1, *pick) for k, pick in sorted(chosen.items())], n_classes, n_classes)


def as_scores(rows: DataFrame, classes: list, *keep: str) -> DataFrame:
    """score_rows() back to k, j, sample_id, class, p."""
    order = F.array(*map(F.lit, classes))
    return rows.select("k", "j", "sample_id", *keep, F.posexplode("x").alias("_n", "p")).select("k", "j", "sample_id", *keep, F.get(order, F.col("_n")).alias("class"), "p")
