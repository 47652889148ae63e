"""Queries over nested cross-validation: inner scores, selection, outer predictions, calibration, rules and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import metrics as M
from ..operators import nested as N
from ..operators import relational as R
from ..operators import splits
from ..operators.models import centroid_scores, top_class
from .base import CELLS, DRAWN, DRAWS, INNER, SCORED, SCORES, TOP, cells, folds, query, rounded, samples, scored, test_scores, truth

SIZES = [8, 16, 32, 64]
POWERS = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0]


def cross_sql(p: str, dealt: str) -> str:
    """SQL of held_out_classes(): the relation {p}p. dealt: SQL with sample_id, k, j."""
    at = lambda a, b: f"{a}.k = {b}.k AND {a}.j = {b}.j"
    return f""", {p}d AS ({dealt}), {p}f AS (SELECT DISTINCT k, j FROM {p}d),
 {p}t AS (SELECT f.k, f.j, c.sample_id, c.class, c.probe, c.beta FROM cells c JOIN {p}d d USING (sample_id) JOIN {p}f f ON d.k = f.k AND d.j <> f.j WHERE c.beta IS NOT NULL),
 {p}m AS (SELECT k, j, class, probe, avg(beta) AS mean FROM {p}t GROUP BY ALL), {p}g AS (SELECT k, j, greatest(count(DISTINCT sample_id) - count(DISTINCT class), 1) AS df FROM {p}t GROUP BY ALL),
 {p}v AS (SELECT k, j, probe, sum((beta - mean) * (beta - mean)) / any_value(df) + 1e-4 AS var FROM {p}t JOIN {p}m USING (k, j, class, probe) JOIN {p}g USING (k, j) GROUP BY k, j, probe),
 {p}r AS (SELECT k, j, probe, row_number() OVER (PARTITION BY k, j ORDER BY round(var_samp(beta), 9) DESC, probe) AS r FROM {p}t GROUP BY k, j, probe),
 {p}x AS (SELECT d.k, d.j, n.setting, c.sample_id, m.class, round(sum(-2 * c.beta * mean / var + mean * mean / var), 6) AS distance FROM cells c JOIN {p}d d USING (sample_id) JOIN {p}m m ON {at('m', 'd')} AND m.probe = c.probe JOIN {p}v v ON {at('v', 'd')} AND v.probe = c.probe
  JOIN {p}r r ON {at('r', 'd')} AND r.probe = c.probe JOIN (SELECT unnest({SIZES}) AS setting) n ON r.r <= n.setting WHERE c.beta IS NOT NULL GROUP BY ALL),
 {p}p AS (SELECT k, j, setting, sample_id, class AS predicted FROM {p}x QUALIFY row_number() OVER (PARTITION BY k, j, setting, sample_id ORDER BY distance, class) = 1)"""


INNER_CV = CELLS + INNER + cross_sql("i", "SELECT sample_id, CAST(k AS INT) AS k, CAST(inner_folds[k + 1] AS INT) AS j FROM folds, (SELECT unnest(range(5)) AS k) WHERE inner_folds[k + 1] >= 0") + """,
 q AS (SELECT k, j, setting, s.class AS truth, predicted, CAST(s.class = predicted AS INT) AS ok FROM ip JOIN samples s USING (sample_id)),
 f1 AS (SELECT k, j, setting, avg(2.0 * hits / (n_t + coalesce(n_q, 0))) AS macro_f1 FROM (SELECT k, j, setting, truth AS class, count(*) AS n_t, sum(ok) AS hits FROM q GROUP BY ALL) LEFT JOIN (SELECT k, j, setting, predicted AS class, count(*) AS n_q FROM q GROUP BY ALL) USING (k, j, setting, class) GROUP BY k, j, setting),
 mean AS (SELECT k AS "outer", setting, round(avg(macro_f1), 9) AS mean_f1 FROM f1 GROUP BY ALL), best AS (SELECT * FROM mean QUALIFY row_number() OVER (PARTITION BY "outer" ORDER BY mean_f1 DESC, setting) = 1)"""
OUTER_CV = INNER_CV + cross_sql("out_", "SELECT sample_id, -1 AS k, CAST(outer_fold AS INT) AS j FROM folds") + """,
 pooled AS (SELECT o.sample_id, o.j AS outer_fold, o.setting, o.predicted, s.class AS truth FROM out_p o JOIN best ON best."outer" = o.j AND best.setting = o.setting JOIN samples s USING (sample_id))"""


def inner_scores(spark, sf):
    return N.setting_scores(N.held_out_classes(cells(spark, sf), N.inner_dealt(folds(spark, sf)), SIZES), truth(spark, sf))


def outer_predictions(spark, sf):
    """Each sample once: by the setting that the inner folds of its outer fold's training side chose."""
    best = N.select_settings(inner_scores(spark, sf)).select(F.col("outer").alias("j"), "setting")
    found = N.held_out_classes(cells(spark, sf), N.outer_dealt(folds(spark, sf)), SIZES).join(best, ["j", "setting"])
    return found.join(truth(spark, sf), "sample_id").select("sample_id", F.col("j").alias("outer_fold"), "setting", "predicted", "truth")


@query(SCORES + TOP + " SELECT sample_id, CAST(predicted AS INT) AS predicted, round(confidence, 6) + 0.0 AS confidence FROM top")
def centroid_blocks(spark, sf):
    """Every sample's nearest class by the outer folds that it isn't in, by products with blocks of centroids: no row per sample, probe and class."""
    d = N.block_distances(cells(spark, sf), N.outer_dealt(folds(spark, sf)))
    return rounded(top_class(centroid_scores(d)), "confidence")


@query(INNER_CV + ' SELECT k AS "outer", j AS "inner", setting, round(macro_f1, 6) + 0.0 AS macro_f1 FROM f1')
def nested_inner(spark, sf):
    return rounded(inner_scores(spark, sf).withColumnsRenamed({"k": "outer", "j": "inner"}), "macro_f1")


@query(INNER_CV + ' SELECT "outer", setting, round(mean_f1, 6) + 0.0 AS mean_f1 FROM best')
def nested_select(spark, sf):
    return rounded(N.select_settings(inner_scores(spark, sf)), "mean_f1")


@query(OUTER_CV + " SELECT sample_id, outer_fold, setting, predicted, truth FROM pooled")
def nested_outer(spark, sf):
    return outer_predictions(spark, sf)


@query(OUTER_CV + " SELECT count(*) AS n, round(avg(CAST(predicted = truth AS INT)), 6) + 0.0 AS accuracy, round(avg(CAST(floor(predicted / 3) = floor(truth / 3) AS INT)), 6) + 0.0 AS family_accuracy FROM pooled")
def nested_report(spark, sf):
    """Pooled outer predictions, each sample exactly once (a contract), at class and family level."""
    p = outer_predictions(spark, sf).persist()  # a row per sample, read by the contract and the sums
    C.exact_coverage(p.select("sample_id"), samples(spark, sf).select("sample_id"), "sample_id")
    right = lambda f: F.avg((f("predicted") == f("truth")).cast("int"))
    return rounded(p.agg(F.count(F.lit(1)).alias("n"), right(F.col).alias("accuracy"), right(lambda c: F.floor(F.col(c) / 3)).alias("family_accuracy")), "accuracy", "family_accuracy")


@query(INNER_CV + ", n AS (SELECT setting, count(*) AS n FROM best GROUP BY 1) SELECT 'probes' AS rule, min(setting) AS setting, max(n) || ' of 5' AS support, count(*) > 1 AS tie FROM n WHERE n = (SELECT max(n) FROM n)")
def config_rules(spark, sf):
    """The setting that most outer folds chose, with its support; a caller refuses a tie."""
    best = N.select_settings(inner_scores(spark, sf)).withColumn("rule", F.lit("probes"))
    return R.mode_per(best, ["rule"], "setting").select("rule", "setting", F.format_string("%d of %d", "n", "size").alias("support"), "tie")


@query(INNER_CV + ', c AS (SELECT unnest([0, 1, 2, 3, 4]) AS "outer", unnest([64, 64, 32, 64, 64]) AS configured) SELECT "outer", setting AS found, configured, setting = configured AS ok FROM best JOIN c USING ("outer")')
def rule_audit(spark, sf):
    """Choices derived again from the scores, against a configuration."""
    configured = F.get(F.array(*map(F.lit, (64, 64, 32, 64, 64))), F.col("outer"))
    return N.select_settings(inner_scores(spark, sf)).select("outer", F.col("setting").alias("found"), configured.alias("configured"), (F.col("setting") == configured).alias("ok"))


@query(INNER_CV + " SELECT setting, round(avg(mean_f1), 6) + 0.0 AS mean_score, CAST(dense_rank() OVER (ORDER BY round(avg(mean_f1), 6) DESC) AS INT) AS rank FROM mean GROUP BY setting")
def tie_rules(spark, sf):
    """Mean over outer folds of the means over inner ones, ranked; equal means share a rank."""
    from pyspark.sql import Window

    means = inner_scores(spark, sf).groupBy("k", "setting").agg(F.round(F.avg("macro_f1"), 9).alias("m")).groupBy("setting").agg(F.avg("m").alias("mean_score"))
    return rounded(means, "mean_score").withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("mean_score"))))  # a row per setting


@query(INNER_CV + ' SELECT "outer", setting, round(mean_f1, 6) + 0.0 AS score FROM best')
def select_best_setting(spark, sf):
    return rounded(N.select_settings(inner_scores(spark, sf)).withColumnRenamed("mean_f1", "score"), "score")


@query(SCORES + f""", folded AS (SELECT scores.*, outer_fold AS fold FROM scores JOIN outers USING (sample_id)), e AS (SELECT f.fold, f.sample_id, f.class, power, pow(greatest(p, 1e-9), power) AS e FROM folded f, (SELECT unnest({POWERS}::DOUBLE[]) AS power)),
 n AS (SELECT fold, sample_id, class, power, e / sum(e) OVER (PARTITION BY sample_id, power) AS p FROM e), o AS (SELECT fold, power, sum(-ln(p)) AS loss, count(*) AS n FROM n JOIN samples s USING (sample_id) WHERE n.class = s.class GROUP BY 1, 2),
 r AS (SELECT *, round((sum(loss) OVER (PARTITION BY power) - loss) / (sum(n) OVER (PARTITION BY power) - n), 9) AS rest, loss / n AS log_loss FROM o), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY fold ORDER BY rest, power) = 1)
 SELECT CAST(b.fold AS INT) AS fold, b.power, round(b.log_loss, 6) + 0.0 AS log_loss, round(raw.log_loss, 6) + 0.0 AS raw_log_loss FROM b JOIN r raw ON raw.fold = b.fold AND raw.power = 1.0""")
def cross_calibration(spark, sf):
    s = test_scores(spark, sf).join(folds(spark, sf).select("sample_id", F.col("outer_fold").cast("int").alias("fold")), "sample_id")
    return rounded(N.cross_calibration(s, truth(spark, sf), POWERS), "log_loss", "raw_log_loss")


PAIRED = """, two AS (SELECT a.sample_id, s.class AS truth, a.predicted AS first, b.predicted AS second FROM out_p a JOIN out_p b USING (sample_id) JOIN samples s USING (sample_id) WHERE a.setting = 64 AND b.setting = 8)""" + DRAWS.format(src="two") + """,
 each AS (SELECT 'class' AS level, 1 AS m, b, truth, first AS q FROM boot UNION ALL SELECT 'class', 2, b, truth, second FROM boot UNION ALL SELECT 'family', 1, b, CAST(floor(truth / 3) AS INT), CAST(floor(first / 3) AS INT) FROM boot UNION ALL SELECT 'family', 2, b, CAST(floor(truth / 3) AS INT), CAST(floor(second / 3) AS INT) FROM boot),
 t AS (SELECT level, m, b, truth AS class, count(*) AS n, count(*) FILTER (WHERE q = truth) AS hits FROM each GROUP BY ALL), g AS (SELECT level, m, b, q AS class, count(*) AS n_q FROM each GROUP BY ALL),
 v AS (SELECT level, m, b, sum(hits) / sum(n) AS accuracy, avg(hits / n) AS balanced_accuracy, avg(2.0 * hits / (n + coalesce(n_q, 0))) AS macro_f1 FROM t LEFT JOIN g USING (level, m, b, class) GROUP BY level, m, b),
 w AS (UNPIVOT v ON accuracy, balanced_accuracy, macro_f1 INTO NAME metric VALUE value), d AS (SELECT level, metric, x.value - y.value AS d FROM w x JOIN w y USING (level, metric, b) WHERE x.m = 1 AND y.m = 2)
 SELECT level, metric, round(avg(d), 6) + 0.0 AS mean_difference, round(quantile_cont(d, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(d, 0.975), 6) + 0.0 AS ci_high, round(avg(CAST(d > 0 AS INT)), 6) + 0.0 AS share_above FROM d GROUP BY level, metric"""


@query(CELLS + INNER + cross_sql("out_", "SELECT sample_id, -1 AS k, CAST(outer_fold AS INT) AS j FROM folds") + PAIRED)
def paired_bootstrap(spark, sf):
    """Centroids on the 64 probes of largest variance against those on 8, on the same resamples, at class and family level."""
    found = N.held_out_classes(cells(spark, sf), N.outer_dealt(folds(spark, sf)), [8, 64]).groupBy("sample_id").pivot("setting", [64, 8]).agg(F.first("predicted"))
    rows = found.join(truth(spark, sf), "sample_id").select("sample_id", "truth", F.col("64").alias("first"), F.col("8").alias("second"))
    # Counted once per draw and cell of the two confusion tables, so that a draw's rows are met once for both models and levels.
    drawn = splits.bootstrap_draws(rows, DRAWN).groupBy("b", "truth", "first", "second").agg(F.count(F.lit(1)).alias("k"))
    level = lambda name, f: F.struct(F.lit(name).alias("level"), *[f(F.col(c)).cast("int").alias(c) for c in ("truth", "first", "second")])
    each = drawn.select("b", "k", F.explode(F.array(level("class", lambda c: c), level("family", lambda c: F.floor(c / 3)))).alias("s")).select("b", "k", "s.*").persist()
    model = lambda c: M.counted(each.select("level", "b", "truth", F.col(c).alias("predicted"), "k"), "level", "b")
    return rounded(M.paired_difference(model("first"), model("second"), "level"), "mean_difference", "ci_low", "ci_high", "share_above")


COHORTS = SCORED + """, sc AS (SELECT s.*, m.cohort FROM scored s JOIN samples m USING (sample_id)), f AS (SELECT cohort, avg(2.0 * hits / (n_t + coalesce(n_q, 0))) AS macro_f1 FROM (SELECT cohort, truth AS class, count(*) AS n_t, sum(correct) AS hits FROM sc GROUP BY 1, 2) LEFT JOIN (SELECT cohort, predicted AS class, count(*) AS n_q FROM sc GROUP BY 1, 2) USING (cohort, class) GROUP BY cohort)"""


@query(COHORTS + " SELECT round(x.macro_f1, 6) + 0.0 AS value, round(r.macro_f1, 6) + 0.0 AS reference, x.macro_f1 >= r.macro_f1 - 0.05 AS met FROM f x, f r WHERE x.cohort = 'external' AND r.cohort = 'reference'")
def target_row(spark, sf):
    """The external cohort's macro F1 against the reference cohort's less 0.05."""
    s = scored(spark, sf).join(samples(spark, sf).select("sample_id", "cohort"), "sample_id")
    f = M.per_class(s, "cohort").filter("n > 0").groupBy("cohort").agg(F.avg("f1").alias("macro_f1"))
    row = f.agg(F.max(F.when(F.col("cohort") == "external", F.col("macro_f1"))).alias("value"), F.max(F.when(F.col("cohort") == "reference", F.col("macro_f1"))).alias("reference"))
    return rounded(row.withColumn("met", F.col("value") >= F.col("reference") - 0.05), "value", "reference")
