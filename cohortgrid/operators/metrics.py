"""Classification metrics. Macro averages run over the classes present in the truth of the set (or resample) that is scored.

scored: sample_id, truth, predicted, confidence, correct, brier. by: further keys, such as a resample or group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bin_index, ratio
from .models import top_class

BINS, SURE = 15, 0.9


def scored_rows(scores: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """scores: by, sample_id, class, p; truth: sample_id, truth."""
    sums = scores.join(truth, "sample_id").groupBy(*by, "sample_id", "truth").agg((F.sum(F.col("p") * F.col("p")) - 2 * F.max(F.when(F.col("class") == F.col("truth"), F.col("p"))) + 1).alias("brier"), F.max(F.when(F.col("class") == F.col("truth"), F.col("p"))).alias("p_true"))
    return sums.join(top_class(scores, *by), [*by, "sample_id"]).withColumn("correct", (F.col("truth") == F.col("predicted")).cast("int"))


def confusion(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def dense_confusion(scored: DataFrame, classes: DataFrame) -> DataFrame:
    """With a row of 0 for each pair that doesn't occur. classes: one small column, class."""
    names = F.broadcast(classes.agg(F.array_sort(F.collect_set("class")).alias("all")))
    grid = names.select(F.explode("all").alias("truth"), "all").select("truth", F.explode("all").alias("predicted"))
    return grid.join(confusion(scored), ["truth", "predicted"], "left").fillna(0, ["n"])


def per_class(scored: DataFrame, *by: str) -> DataFrame:
    """n, n_predicted, hits, recall, precision (null if never predicted), f1: for classes in truth or prediction."""
    sides = scored.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("q"), F.col("correct").alias("hit")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("q"), F.lit(0).alias("hit")))).alias("s")).select(*by, "s.*")
    sums = sides.groupBy(*by, "class").agg(F.sum("t").alias("n"), F.sum("q").alias("n_predicted"), F.sum("hit").alias("hits"))
    return sums.select("*", ratio("hits", "n").alias("recall"), ratio("hits", "n_predicted").alias("precision"), ratio(2 * F.col("hits"), F.col("n") + F.col("n_predicted")).alias("f1"))


def ece(scored: DataFrame, *by: str) -> DataFrame:
    per = scored.groupBy(*by, bin_index("confidence", BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.sum("correct") - F.sum("confidence")).alias("off"))
    return per.groupBy(*by).agg((F.sum("off") / F.sum("n")).alias("ece"))


def reliability(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """A row per bin, empty ones with n 0 and nulls."""
    found = scored.groupBy(bin_index("confidence", bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy"))
    return scored.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left").fillna(0, ["n"])


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """macro_f1, balanced_accuracy, accuracy, brier, ece, confident_share, confident_accuracy: one row per by.

    Rows are read once, into sums per (truth, predicted, bin, sure); all seven metrics come from that small table.
    """
    by = by or ("_one",)
    rows = scored if by != ("_one",) else scored.withColumn("_one", F.lit(1))
    cells = rows.groupBy(*by, "truth", "predicted", bin_index("confidence", BINS).alias("bin"), (F.col("confidence") >= SURE).cast("int").alias("sure")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("correct"), F.sum("confidence").alias("confidence"), F.sum("brier").alias("brier")
    )
    side = lambda kind, c, n, q, hit: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key"), n.alias("n"), q.alias("q"), hit.alias("hit"), F.col("confidence"), F.col("brier"), F.col("sure"))
    n, zero, hit = F.col("n"), F.lit(0).cast("long"), F.col("correct").cast("long")
    each = cells.select(*by, F.explode(F.array(side("class", F.col("truth"), n, zero, hit), side("class", F.col("predicted"), zero, n, zero), side("bin", F.col("bin"), n, zero, hit))).alias("s")).select(*by, "s.*")
    is_sure = F.col("sure") == 1
    sums = each.groupBy(*by, "kind", "key").agg(
        *[F.sum(c).alias(c) for c in ("n", "q", "hit", "confidence", "brier")], F.coalesce(F.sum(F.when(is_sure, F.col("n"))), F.lit(0)).alias("n_sure"), F.coalesce(F.sum(F.when(is_sure, F.col("hit"))), F.lit(0)).alias("hit_sure")
    )
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    present, total = F.col("n") > 0, F.sum(of("bin", F.col("n")))
    out = sums.groupBy(*by).agg(
        total.alias("n"),
        (F.sum(of("bin", F.col("hit"))) / total).alias("accuracy"),
        (F.sum(of("bin", F.col("brier"))) / total).alias("brier"),
        (F.sum(of("bin", F.col("n_sure"))) / total).alias("confident_share"),
        ratio(F.sum(of("bin", F.col("hit_sure"))), F.sum(of("bin", F.col("n_sure")))).alias("confident_accuracy"),
        F.avg(of("class", F.when(present, 2 * F.col("hit") / (F.col("n") + F.col("q"))))).alias("macro_f1"),
        F.avg(of("class", F.when(present, F.col("hit") / F.col("n")))).alias("balanced_accuracy"),
        (F.sum(of("bin", F.abs(F.col("hit") - F.col("confidence")))) / total).alias("ece"),
    )
    return out.drop("_one")


#: Scores of which less is better.
SCORES_BETTER_LOW = ("log_loss",)


def fold_scores(scores: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """scores: by, sample_id, class, p. by, n, accuracy, macro_f1, balanced_accuracy and log_loss (of scores over their sum)."""
    rows = scored_rows(scores, truth, *by)
    total = scores.groupBy(*by, "sample_id").agg(F.sum("p").alias("total"))
    p = F.least(F.greatest(F.col("p_true") / F.col("total"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = rows.join(total, [*by, "sample_id"]).groupBy(*by).agg(F.avg(-F.log(p)).alias("log_loss"))
    return summary(rows, *by).select(*by, "n", "accuracy", "macro_f1", "balanced_accuracy").join(loss, list(by))


METRICS = ("macro_f1", "balanced_accuracy", "accuracy", "brier", "ece", "confident_share", "confident_accuracy")


def counted(cells: DataFrame, *by: str) -> DataFrame:
    """cells: by, truth, predicted, k (so many rows). by, accuracy, balanced_accuracy, macro_f1, from a confusion table instead of rows."""
    side = lambda c, n, q, hit: F.struct(F.col(c).alias("class"), n.alias("n"), q.alias("q"), hit.alias("hit"))
    k, none = F.col("k"), F.lit(0).cast("long")
    each = cells.select(*by, F.explode(F.array(side("truth", k, none, F.when(F.col("truth") == F.col("predicted"), k).otherwise(none)), side("predicted", none, k, none))).alias("s")).select(*by, "s.*")
    per = each.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("n", "q", "hit")])
    present = F.col("n") > 0
    return per.groupBy(*by).agg(
        (F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.when(present, F.col("hit") / F.col("n"))).alias("balanced_accuracy"), F.avg(F.when(present, 2 * F.col("hit") / (F.col("n") + F.col("q")))).alias("macro_f1")
    )


def by_group(scored: DataFrame, group: str) -> DataFrame:
    """summary() of all rows (group "all") and of each group."""
    both = scored.withColumn("group", F.explode(F.array(F.lit("all"), F.col(group).cast("string"))))
    return summary(both, "group")


def long_metrics(table: DataFrame, *by: str) -> DataFrame:
    return table.unpivot(list(by), [m for m in METRICS if m in table.columns], "metric", "value")


def intervals(draws: DataFrame, *by: str, ci: float = 0.95) -> DataFrame:
    """draws: b and metrics per resample. Percentile intervals by linear interpolation; missing draws are left out."""
    low, high = (1 - ci) / 2, (1 + ci) / 2
    return long_metrics(draws, *by, "b").groupBy(*by, "metric").agg(F.percentile("value", low).alias("ci_low"), F.percentile("value", high).alias("ci_high"))


def family_scores(scores: DataFrame, families: DataFrame) -> DataFrame:
    """Scores summed within families. families: class, family."""
    return scores.join(families, "class").groupBy("sample_id", F.col("family").alias("class")).agg(F.sum("p").alias("p"))


def log_loss(scored: DataFrame, scores: DataFrame, eps: float = 1e-15) -> DataFrame:
    totals = scores.groupBy("sample_id").agg(F.sum("p").alias("total"))
    p = F.least(F.greatest(F.col("p_true") / F.col("total"), F.lit(eps)), F.lit(1 - eps))
    return scored.join(totals, "sample_id").agg(F.avg(-F.log(p)).alias("log_loss"))


def auc(df: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """Area under the ROC curve by ranks, ties shared."""
    # Rows with a lower score, from counts per score: no window over all rows.
    per = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(positive).cast("long")).alias("pos"))
    upto = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("pos")).over(upto), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2.0))
    return ranked.groupBy(*by).agg(ratio(wins, F.sum("pos") * F.sum(F.col("n") - F.col("pos"))).alias("auc"), F.sum("n").alias("n"), F.sum("pos").alias("n_positive"))


def paired_difference(first: DataFrame, second: DataFrame, *by: str) -> DataFrame:
    """first, second: by, b and metrics of two models on the same draws. Mean difference, interval, share of draws above 0."""
    a, c = long_metrics(first, *by, "b"), long_metrics(second, *by, "b").withColumnRenamed("value", "other")
    d = a.join(c, [*by, "b", "metric"]).withColumn("d", F.col("value") - F.col("other")).filter("d is not null")
    return d.groupBy(*by, "metric").agg(F.avg("d").alias("mean_difference"), F.percentile("d", 0.025).alias("ci_low"), F.percentile("d", 0.975).alias("ci_high"), F.avg((F.col("d") > 0).cast("int")).alias("share_above"))
