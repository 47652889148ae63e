"""Queries over the matrix: statistics, fitted features, splits, models, metrics, resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X
from ..operators import metrics as M
from ..operators import models, relational, splits
from ..sources.tables import in_request_order
from .base import CELLS, CENTROIDS, DRAWN, DRAWS, FOLDS, INNER, SAMPLES, SCORED, SCORES, SPLIT, TOP, U, cells, cells_of, folded, folds, query, rounded, rsql, samples, scored, split_cells, summary_sql, test_scores, truth, with_betas

KEPT = ", kept AS (SELECT probe FROM train GROUP BY probe HAVING avg(CAST(beta IS NULL AS INT)) <= 0.05)"
MEDIANS = SPLIT + KEPT + ", med AS (SELECT probe, CAST(median(beta) AS FLOAT) AS median FROM train JOIN kept USING (probe) GROUP BY probe), filled AS (SELECT s.* EXCLUDE (beta), coalesce(beta, CAST(median AS DOUBLE)) AS beta FROM split s JOIN med USING (probe)), ftrain AS (SELECT * FROM filled WHERE outer_fold <> 0)"
DIFFS = MEDIANS + """, diffs AS (SELECT class, probe, n1, n2, m1 - m2 AS diff, n1 * n2 / CAST(n1 + n2 AS DOUBLE) AS weight FROM (SELECT class, probe, avg(beta) FILTER (WHERE material = 'FFPE') AS m1, avg(beta) FILTER (WHERE material <> 'FFPE') AS m2,
 count(*) FILTER (WHERE material = 'FFPE') AS n1, count(*) FILTER (WHERE material <> 'FFPE') AS n2 FROM ftrain GROUP BY 1, 2) WHERE n1 >= 2 AND n2 >= 2)"""
SHIFT = DIFFS + ", shift AS (SELECT probe, CAST(sum(weight * diff) / sum(weight) AS FLOAT) AS shift FROM diffs GROUP BY probe)"
CORRECTED = SHIFT + ", corrected AS (SELECT f.* EXCLUDE (beta), CASE WHEN material = 'FFPE' THEN greatest(least(beta - shift, 1.0), 0.0) ELSE beta END AS beta FROM filled f JOIN shift USING (probe))"


def filled(spark, sf):
    """All cells, filled by medians of the training side of fold 0, and those of the training side."""
    both = cells_of(folded(spark, sf))
    train = both.filter("outer_fold <> 0")
    med = X.fit_medians(X.keep_probes(train, X.fit_missingness(train)))
    every = X.impute(both, med)
    return every, every.filter("outer_fold <> 0")


@query(CELLS + f" SELECT probe, n_obs, {rsql('frac_missing', 'mean', 'var')} FROM (SELECT probe, count(beta) AS n_obs, avg(CAST(beta IS NULL AS INT)) AS frac_missing, avg(beta) AS mean, var_samp(beta) AS var FROM cells GROUP BY probe)")
def probe_stats(spark, sf):
    return rounded(X.probe_stats(cells(spark, sf)), "frac_missing", "mean", "var")


@query(SPLIT + f" SELECT probe, {rsql('frac_missing')} FROM (SELECT probe, avg(CAST(beta IS NULL AS INT)) AS frac_missing FROM train GROUP BY probe) WHERE frac_missing <= 0.05")
def missingness_filter(spark, sf):
    return rounded(X.fit_missingness(split_cells(spark, sf)[0]), "frac_missing")


@query(MEDIANS + " SELECT probe, round(CAST(median AS DOUBLE), 6) + 0.0 AS median FROM med")
def refined_medians(spark, sf):
    """Exact medians by repeated histograms, where no probe's values are gathered."""
    train, _ = split_cells(spark, sf)
    found = X.refined_medians(X.keep_probes(train, X.fit_missingness(train)).persist())
    return rounded(found.withColumn("median", F.col("median").cast("double")), "median")


@query(MEDIANS + f" SELECT sample_id, probe, {rsql('beta')} FROM filled")
def median_impute(spark, sf):
    return rounded(filled(spark, sf)[0].select("sample_id", "probe", "beta"), "beta")


@query(MEDIANS + f" SELECT probe, {rsql('var')} FROM (SELECT probe, var_samp(beta) AS var FROM ftrain GROUP BY probe ORDER BY var DESC, probe LIMIT 20)")
def top_variance_select(spark, sf):
    return rounded(X.fit_top_variance(filled(spark, sf)[1], 20), "var")


@query(SHIFT + " SELECT probe, round(CAST(shift AS DOUBLE), 5) + 0.0 AS shift FROM shift")
def material_shift(spark, sf):
    return rounded(X.fit_shift(filled(spark, sf)[1]).withColumn("shift", F.col("shift").cast("double")), "shift", places=5)


@query(CORRECTED + " SELECT sample_id, probe, round(beta, 5) + 0.0 AS beta FROM corrected")
def material_correct(spark, sf):
    every, train = filled(spark, sf)
    return rounded(X.correct(every, X.fit_shift(train)).select("sample_id", "probe", "beta"), "beta", places=5)


@query(DIFFS + """, loo AS (SELECT *, (sum(weight * diff) OVER (PARTITION BY probe) - weight * diff) / nullif(CASE WHEN round(sum(weight) OVER (PARTITION BY probe) - weight, 9) > 0 THEN sum(weight) OVER (PARTITION BY probe) - weight END, 0) AS others FROM diffs)
 SELECT class, count(*) AS n_probes, round(corr(diff, others), 6) + 0.0 AS corr_others, round(median(abs(diff)), 6) + 0.0 AS median_abs, count(*) FILTER (WHERE abs(diff) BETWEEN 0.05 AND 0.30) AS n_between FROM loo WHERE others IS NOT NULL GROUP BY class""")
def class_shift_table(spark, sf):
    d = X.leave_one_out(X.class_differences(filled(spark, sf)[1])).filter("others is not null")
    return rounded(d.groupBy("class").agg(F.count(F.lit(1)).alias("n_probes"), F.corr("diff", "others").alias("corr_others"), F.median(F.abs("diff")).alias("median_abs"), F.count_if(F.abs("diff").between(0.05, 0.30)).alias("n_between")), "corr_others", "median_abs")


@query(CORRECTED + ", picked AS (SELECT probe FROM corrected WHERE outer_fold <> 0 GROUP BY probe ORDER BY var_samp(beta) DESC, probe LIMIT 20) SELECT sample_id, probe, round(beta, 5) + 0.0 AS beta FROM corrected JOIN picked USING (probe) WHERE outer_fold = 0")
def feature_pipeline_fold(spark, sf):
    train, test = split_cells(spark, sf)
    return rounded(X.FeaturePipeline(20, correct_material=True).fit(train).transform(test).select("sample_id", "probe", "beta"), "beta", places=5)


@query(SAMPLES + INNER + " SELECT sample_id, class, CAST(outer_fold AS INT) AS outer_fold, array_to_string(inner_folds, ',') AS inner_folds FROM folds")
def stratified_folds(spark, sf):
    return folds(spark, sf).select("sample_id", "class", F.col("outer_fold").cast("int").alias("outer_fold"), F.array_join("inner", ",").alias("inner_folds"))


@query(SAMPLES + INNER + """, per AS (SELECT outer_fold, class, count(*) AS n FROM folds GROUP BY 1, 2), long AS (SELECT class, CAST(unnest(range(5)) AS INT) AS o, unnest(inner_folds) AS i FROM folds),
 c AS (SELECT o, class, i, count(*) AS n FROM long WHERE i >= 0 GROUP BY 1, 2, 3), r AS (SELECT o, sum(n) OVER (PARTITION BY o, class) - n AS tr FROM c), m AS (SELECT o AS outer_fold, min(tr) AS min_inner_train FROM r GROUP BY o)
 SELECT CAST(outer_fold AS INT) AS outer_fold, CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_classes, min(n) AS min_class, CAST(max(min_inner_train) AS BIGINT) AS min_inner_train, max(share) AS first_material FROM per JOIN m USING (outer_fold) JOIN (SELECT outer_fold, round(avg(CAST(material = 'FFPE' AS INT)), 6) + 0.0 AS share FROM folds JOIN samples USING (sample_id) GROUP BY 1) USING (outer_fold) GROUP BY outer_fold""")
def fold_balance(spark, sf):
    """Sizes, smallest classes, and the share of one material in each outer fold."""
    share = splits.fold_share(folds(spark, sf), samples(spark, sf).select("sample_id", (F.col("material") == "FFPE").alias("is_first")), "is_first").withColumnRenamed("share", "first_material")
    return rounded(splits.fold_balance(folds(spark, sf)).join(share, "outer_fold").withColumn("outer_fold", F.col("outer_fold").cast("int")), "first_material")




@query(CELLS + f", u AS (SELECT sample_id, probe, {U.format(7, 'sample_id, probe')} AS u FROM cells WHERE beta IS NOT NULL), l AS (SELECT unnest([1.0, 0.5, 0.1, 0.02]) AS level) SELECT CAST(level AS DOUBLE) AS level, count(*) AS n_cells, count(DISTINCT sample_id) AS n_samples FROM u JOIN l ON level = 1.0 OR u < level GROUP BY level")
def observed_mask_levels(spark, sf):
    return splits.observed(cells(spark, sf).filter("beta is not null"), [1.0, 0.5, 0.1, 0.02]).groupBy("level").agg(F.count(F.lit(1)).alias("n_cells"), F.countDistinct("sample_id").alias("n_samples"))


@query(CENTROIDS + f" SELECT class, probe, {rsql('mean', 'var')} FROM centroids")
def centroid_fit(spark, sf):
    return rounded(models.fit_centroids(split_cells(spark, sf)[0]).select("class", "probe", "mean", "var"), "mean", "var")


@query(SCORED + f" SELECT sample_id, truth, predicted, {rsql('confidence')} FROM scored")
def centroid_predict(spark, sf):
    return rounded(scored(spark, sf).select("sample_id", "truth", "predicted", "confidence"), "confidence")


SPARSE = CENTROIDS + f""", u AS (SELECT *, {U.format(7, 'sample_id, probe')} AS u FROM test WHERE beta IS NOT NULL), l AS (SELECT CAST(unnest([1.0, 0.5, 0.1]) AS DOUBLE) AS level), seen AS (SELECT * FROM u JOIN l ON level = 1.0 OR u < level),
 dist AS (SELECT level, s.sample_id, c.class, sum(-2 * s.beta * c.a + c.b) AS distance, count(*) AS n_obs FROM seen s JOIN centroids c USING (probe) GROUP BY 1, 2, 3), ex AS (SELECT *, exp(-0.5 * (distance - min(distance) OVER (PARTITION BY level, sample_id)) / greatest(n_obs, 1)) AS e FROM dist),
 scores AS (SELECT level, sample_id, class, round(e / sum(e) OVER (PARTITION BY level, sample_id), 9) AS p FROM ex), top AS (SELECT level, sample_id, class AS predicted FROM scores QUALIFY row_number() OVER (PARTITION BY level, sample_id ORDER BY p DESC, class) = 1)"""


def sparse_top(spark, sf):
    train, test = split_cells(spark, sf)
    seen = splits.observed(test.filter("beta is not null"), [1.0, 0.5, 0.1])
    return models.top_class(models.centroid_scores(models.centroid_distances(seen, models.fit_centroids(train), "level"), "level"), "level")


@query(SPARSE + " SELECT level, sample_id, predicted FROM top")
def centroid_sparse(spark, sf):
    return sparse_top(spark, sf).select("level", "sample_id", "predicted")


@query(SPARSE + """, m AS (SELECT level, material AS subset, class = predicted AS c, family = CAST(floor(predicted / 3) AS INT) AS f FROM top JOIN samples USING (sample_id)), b AS (SELECT * FROM m UNION ALL SELECT level, 'all', c, f FROM m)
 SELECT level, subset, label_level, count(*) AS n, round(avg(CAST(ok AS INT)), 6) + 0.0 AS agreement FROM (SELECT level, subset, unnest(['class', 'family']) AS label_level, unnest([c, f]) AS ok FROM b) GROUP BY 1, 2, 3""")
def agreement_matrix(spark, sf):
    t = sparse_top(spark, sf).join(samples(spark, sf).select("sample_id", "class", "family", "material"), "sample_id")
    level = lambda name, ok: F.named_struct(F.lit("label_level"), F.lit(name), F.lit("ok"), ok)
    hit = F.array(level("class", F.col("class") == F.col("predicted")), level("family", F.col("family") == F.floor(F.col("predicted") / 3)))
    each = t.select("level", F.explode(F.array(F.lit("all"), F.col("material"))).alias("subset"), hit.alias("h")).select("level", "subset", F.inline("h"))
    return rounded(each.groupBy("level", "subset", "label_level").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("int")).alias("agreement")), "agreement")


@query(SCORED + " SELECT t.class AS truth, q.class AS predicted, count(s.sample_id) AS n FROM (SELECT DISTINCT class FROM samples) t CROSS JOIN (SELECT DISTINCT class FROM samples) q LEFT JOIN scored s ON s.truth = t.class AND s.predicted = q.class GROUP BY 1, 2")
def confusion_dense(spark, sf):
    return M.dense_confusion(scored(spark, sf), samples(spark, sf).select("class"))


ALL = ", one AS (SELECT *, 1 AS k FROM scored)"


@query(SCORED + ALL + f" SELECT n, {rsql(*M.METRICS)} FROM ({summary_sql('one', 'k')})")
def class_metrics(spark, sf):
    return rounded(M.summary(scored(spark, sf)), *M.METRICS)


@query(SCORED + f""" SELECT class, n, n_predicted, hits, {rsql('recall', 'precision', 'f1')} FROM (SELECT class, CAST(sum(t) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS n_predicted, CAST(sum(h) AS BIGINT) AS hits, sum(h) / nullif(sum(t), 0) AS recall, sum(h) / nullif(sum(q), 0) AS precision, 2 * sum(h) / nullif(sum(t) + sum(q), 0) AS f1
 FROM (SELECT truth AS class, 1 AS t, 0 AS q, correct AS h FROM scored UNION ALL SELECT predicted, 0, 1, 0 FROM scored) GROUP BY class)""")
def per_class_table(spark, sf):
    return rounded(M.per_class(scored(spark, sf)), "recall", "precision", "f1")


@query(SCORED + ALL + f" SELECT {rsql('brier', 'ece')} FROM ({summary_sql('one', 'k')})")
def brier_ece(spark, sf):
    return rounded(M.summary(scored(spark, sf)).select("brier", "ece"), "brier", "ece")


@query(SCORED + " SELECT b.bin, count(s.sample_id) AS n, round(avg(confidence), 6) + 0.0 AS confidence, round(avg(correct), 6) + 0.0 AS accuracy FROM (SELECT CAST(unnest(range(15)) AS BIGINT) AS bin) b LEFT JOIN scored s ON b.bin = least(floor(confidence * 15), 14) GROUP BY b.bin")
def reliability(spark, sf):
    return rounded(M.reliability(scored(spark, sf)), "confidence", "accuracy")


@query(SCORED + " SELECT round(avg(CAST(confidence >= 0.2 AS INT)), 6) + 0.0 AS share, round(avg(correct) FILTER (WHERE confidence >= 0.2), 6) + 0.0 AS accuracy FROM scored")
def confident_share(spark, sf):
    sure = F.col("confidence") >= 0.2
    return rounded(scored(spark, sf).agg(F.avg(sure.cast("int")).alias("share"), F.avg(F.when(sure, F.col("correct"))).alias("accuracy")), "share", "accuracy")


@query(SCORED + ", tot AS (SELECT sample_id, sum(p) AS total FROM scores GROUP BY 1) SELECT round(avg(-ln(least(greatest(p_true / total, 1e-15), 1 - 1e-15))), 6) + 0.0 AS log_loss FROM scored JOIN tot USING (sample_id)")
def log_loss(spark, sf):
    return rounded(M.log_loss(scored(spark, sf), test_scores(spark, sf)), "log_loss")


@query(SCORES + " SELECT sample_id, CAST(floor(class / 3) AS INT) AS class, round(sum(p), 6) + 0.0 AS p FROM scores GROUP BY 1, 2")
def family_scores(spark, sf):
    fam = samples(spark, sf).select("class", "family").distinct()
    return rounded(M.family_scores(test_scores(spark, sf), fam), "p")


GROUPED = SCORED + ', grouped AS (SELECT s.*, m.material AS "group" FROM scored s JOIN samples m USING (sample_id) UNION ALL SELECT *, \'all\' FROM scored)'


@query(GROUPED + f' SELECT "group", n, {rsql(*M.METRICS)} FROM ({summary_sql("grouped", chr(34) + "group" + chr(34))})')
def metrics_by_group(spark, sf):
    both = scored(spark, sf).join(samples(spark, sf).select("sample_id", "material"), "sample_id")
    return rounded(M.by_group(both, "material"), *M.METRICS)


@query(SCORED + DRAWS.format(src="scored") + f", per AS ({summary_sql('boot', 'b')}), long AS (UNPIVOT (SELECT b, {', '.join(M.METRICS)} FROM per) ON {', '.join(M.METRICS)} INTO NAME metric VALUE value) SELECT metric, round(quantile_cont(value, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(value, 0.975), 6) + 0.0 AS ci_high FROM long GROUP BY metric")
def bootstrap_ci(spark, sf):
    per = M.summary(splits.bootstrap_draws(scored(spark, sf), DRAWN), "b")
    return rounded(M.intervals(per).filter("ci_low is not null"), "ci_low", "ci_high")


@query(SCORED + DRAWS.format(src="scored") + ", d AS (SELECT b, avg(correct) AS d FROM boot GROUP BY b) SELECT (SELECT round(avg(correct), 6) + 0.0 FROM scored) AS share, round(quantile_cont(d, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(d, 0.975), 6) + 0.0 AS ci_high FROM d")
def boot_share(spark, sf):
    s = scored(spark, sf)
    d = splits.bootstrap_draws(s, DRAWN).groupBy("b").agg(F.avg("correct").alias("d"))
    r = d.agg(F.percentile("d", 0.025).alias("ci_low"), F.percentile("d", 0.975).alias("ci_high")).withColumn("one", F.lit(1)).join(s.agg(F.avg("correct").alias("share")).withColumn("one", F.lit(1)), "one")
    return rounded(r.select("share", "ci_low", "ci_high"), "share", "ci_low", "ci_high")


F_STAT = ", per AS (SELECT probe, class, count(beta) AS n, sum(beta) AS s, sum(beta * beta) AS q FROM ftrain GROUP BY 1, 2), f AS (SELECT probe, sum(n) AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM per GROUP BY probe), fs AS (SELECT probe, CASE WHEN q - b <= 1e-12 THEN 0.0 ELSE ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) END AS f FROM f)"


@query(MEDIANS + F_STAT + f" SELECT probe, {rsql('f')} FROM fs")
def anova_f(spark, sf):
    return rounded(X.f_statistic(filled(spark, sf)[1]), "f")


@query(CELLS + ", g AS (SELECT probe, class, count(*) AS n, sum(beta) AS s, sum(beta * beta) AS q FROM cells WHERE beta IS NOT NULL GROUP BY 1, 2) SELECT probe, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) + 0.0 AS eta_squared FROM g GROUP BY probe")
def eta_squared(spark, sf):
    return rounded(X.eta_squared(cells(spark, sf), "beta", "class", "probe"), "eta_squared")


@query(CELLS + " SELECT sample_id, probe, class, round(beta - avg(beta) OVER (PARTITION BY probe, class), 6) + 0.0 AS residual FROM cells")
def within_class_residual(spark, sf):
    """Means per class and probe are joined back, so no group of cells stands in one task."""
    c = cells(spark, sf)
    means = c.groupBy("probe", "class").agg(F.avg("beta").alias("m"))
    r = c.join(means, ["probe", "class"]).withColumn("residual", F.col("beta") - F.col("m"))
    return rounded(r.select("sample_id", "probe", "class", "residual"), "residual")


@query(MEDIANS + F_STAT + """, leaky AS (SELECT probe FROM (SELECT probe, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f FROM (SELECT probe, class, count(beta) AS n, sum(beta) AS s, sum(beta * beta) AS q FROM filled GROUP BY 1, 2) GROUP BY probe) ORDER BY f DESC, probe LIMIT 10),
 clean AS (SELECT probe FROM fs ORDER BY f DESC, probe LIMIT 10) SELECT (SELECT count(*) FROM leaky) AS n_selected, count(*) AS n_shared FROM leaky JOIN clean USING (probe)""")
def leakage_gap(spark, sf):
    """Selection on all rows against selection inside the training side."""
    every, train = filled(spark, sf)
    top = lambda c: X.f_statistic(c).orderBy(F.desc("f"), "probe").limit(10).select("probe")
    leaky = top(every).withColumn("one", F.lit(1))
    return leaky.join(top(train).withColumn("shared", F.lit(1)), "probe", "left").agg(F.count(F.lit(1)).alias("n_selected"), F.count("shared").alias("n_shared"))


@query(SAMPLES + FOLDS + ", r AS (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY sample_id) AS i, row_number() OVER (PARTITION BY outer_fold ORDER BY md5('1|' || sample_id), sample_id) AS j FROM outers) SELECT a.sample_id, CAST(a.outer_fold AS INT) AS outer_fold, b.class AS shuffled FROM r a JOIN r b ON a.outer_fold = b.outer_fold AND a.i = b.j")
def shuffle_within_folds(spark, sf):
    return splits.shuffle_within(folds(spark, sf).withColumn("outer_fold", F.col("outer_fold").cast("int")), "class", "outer_fold")


@query(SAMPLES + ", s AS (SELECT sample_id, row_number() OVER (ORDER BY md5('3|' || sample_id), sample_id) - 1 AS i FROM samples) SELECT sample_id, CAST(i % 3 AS INT) AS fake_class, CAST(floor(i / 3) % 5 AS INT) AS fold FROM s WHERE i < 150")
def random_subset(spark, sf):
    """150 samples with balanced made-up labels and folds."""
    r = splits.random_subset(samples(spark, sf).select("sample_id"), 150).withColumn("i", F.row_number().over(Window.orderBy(splits.keyed(3, "sample_id"), "sample_id")) - 1)
    return r.select("sample_id", (F.col("i") % 3).cast("int").alias("fake_class"), (F.floor(F.col("i") / 3) % 5).cast("int").alias("fold"))


@query(SAMPLES + ", g AS (SELECT class, count(*) AS n FROM samples GROUP BY 1) SELECT class, n, CAST((row_number() OVER (ORDER BY n DESC, class) - 1) % 3 AS INT) AS fold FROM g")
def group_folds(spark, sf):
    return splits.group_folds(samples(spark, sf), "class", 3).withColumn("fold", F.col("fold").cast("int"))


@query(MEDIANS + f" SELECT sample_id, probe, {rsql('z')} FROM (SELECT sample_id, probe, (beta - m) / sd AS z FROM filled JOIN (SELECT probe, avg(beta) AS m, greatest(stddev_pop(beta), 1e-3) AS sd FROM ftrain GROUP BY probe) USING (probe))")
def standardize(spark, sf):
    every, train = filled(spark, sf)
    return rounded(X.standardise(every, train).select("sample_id", "probe", "z"), "z")


@query(SAMPLES + ", c AS (SELECT class, count(*) AS n_c FROM samples GROUP BY 1) SELECT class, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) + 0.0 AS weight FROM c")
def class_weights(spark, sf):
    return rounded(models.class_weights(samples(spark, sf)), "weight")


ARR = "SELECT sample_id, list(p ORDER BY class) AS p FROM scores GROUP BY 1"


def arrays(spark, sf):
    return test_scores(spark, sf).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "p"))), lambda s: s["p"]).alias("p"))


@query(SCORES + f", a AS ({ARR}) SELECT sample_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS best, round(list_max(p) / list_sum(p), 6) + 0.0 AS share FROM a")
def argmax_normalise(spark, sf):
    return rounded(arrays(spark, sf).select("sample_id", S.argmax("p").alias("best"), F.array_max(S.normalised("p")).alias("share")), "share")


@query(SCORES + f", a AS ({ARR}) SELECT count(*) AS n, count(*) FILTER (WHERE list_min(p) < -1e-9) AS n_negative, count(*) FILTER (WHERE abs(list_sum(p) - 1) > 1e-6) AS n_bad_sum, count(*) FILTER (WHERE len(p) <> 10) AS n_bad_width FROM a")
def score_checks(spark, sf):
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return arrays(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.exists("p", lambda x: x < -1e-9)).alias("n_negative"), F.count_if(F.abs(total - 1) > 1e-6).alias("n_bad_sum"), F.count_if(F.size("p") != 10).alias("n_bad_width"))


@query(SPARSE + " SELECT level, count(*) AS n, count(*) FILTER (WHERE t.predicted <> o.predicted) AS n_changed FROM top t JOIN (SELECT sample_id, predicted FROM top WHERE level = 1.0) o USING (sample_id) GROUP BY level")
def compare_runs(spark, sf):
    t = sparse_top(spark, sf)
    full = t.filter("level = 1.0").select("sample_id", F.col("predicted").alias("was"))
    return t.join(full, "sample_id").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") != F.col("was")).alias("n_changed"))


@query(SAMPLES + ", q AS (SELECT unnest([17, 3, 250, 99, 4]) AS sample_id, unnest([0, 1, 2, 3, 4]) AS pos) SELECT CAST(pos AS INT) AS pos, q.sample_id, class, round(CAST(embedding[8] AS DOUBLE), 6) + 0.0 AS probe7 FROM q JOIN samples USING (sample_id)")
def request_order_load(spark, sf):
    got = in_request_order(samples(spark, sf), [17, 3, 250, 99, 4])
    return rounded(got.select("pos", F.col("sample_id").cast("int").alias("sample_id"), "class", F.col("embedding")[7].cast("double").alias("probe7")), "probe7")


ATTR = CENTROIDS + """, sh AS (SELECT t.sample_id, t.class, probe, sum(CASE WHEN c.class = 0 THEN beta * a - b / 2 END) - avg(beta * a - b / 2) AS share FROM test t JOIN centroids c USING (probe) WHERE beta IS NOT NULL GROUP BY 1, 2, 3)"""


def shares(spark, sf):
    train, test = split_cells(spark, sf)
    return models.linear_attribution(test, models.fit_centroids(train), 0)


@query(ATTR + " SELECT sample_id, round(sum(share), 5) + 0.0 AS total, count(*) AS n_probes FROM sh GROUP BY 1")
def linear_attribution(spark, sf):
    return rounded(shares(spark, sf).groupBy("sample_id").agg(F.sum("share").alias("total"), F.count(F.lit(1)).alias("n_probes")), "total", places=5)


@query(ATTR + """, m AS (SELECT probe, avg(abs(share)) AS mean_abs, avg(share) AS mean_signed, avg(share) FILTER (WHERE class = 0) - avg(share) FILTER (WHERE class <> 0) AS delta FROM sh GROUP BY 1)
 SELECT probe, CAST(row_number() OVER (ORDER BY mean_abs DESC, probe) AS INT) AS rank, round(mean_abs, 5) + 0.0 AS mean_abs, round(mean_signed, 5) + 0.0 AS mean_signed, round(delta, 5) + 0.0 AS delta FROM m ORDER BY mean_abs DESC, probe LIMIT 10""")
def attribution_topk(spark, sf):
    s = shares(spark, sf).join(samples(spark, sf).select("sample_id", "class"), "sample_id")
    m = s.groupBy("probe").agg(F.avg(F.abs("share")).alias("mean_abs"), F.avg("share").alias("mean_signed"), (F.avg(F.when(F.col("class") == 0, F.col("share"))) - F.avg(F.when(F.col("class") != 0, F.col("share")))).alias("delta"))
    top = m.orderBy(F.desc("mean_abs"), "probe").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "probe")))
    return rounded(top.select("probe", "rank", "mean_abs", "mean_signed", "delta"), "mean_abs", "mean_signed", "delta", places=5)


@query(ATTR + """, ids AS (SELECT DISTINCT sample_id FROM sh), each AS (SELECT sample_id, unnest(range(20)) AS split FROM ids), h AS (SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY md5('11|' || split || '|' || sample_id), sample_id) > floor(count(*) OVER (PARTITION BY split) / 2) AS INT) AS half FROM each),
 r AS (SELECT split, half, probe, row_number() OVER (PARTITION BY split, half ORDER BY avg(abs(share)) DESC, probe) AS r FROM h JOIN sh USING (sample_id) GROUP BY 1, 2, 3), o AS (SELECT a.split, count(b.probe) AS shared FROM r a LEFT JOIN r b ON a.split = b.split AND a.probe = b.probe AND b.half = 1 AND b.r <= 10 WHERE a.half = 0 AND a.r <= 10 GROUP BY 1)
 SELECT round(avg(shared), 6) + 0.0 AS shared_mean, min(shared) AS shared_min, max(shared) AS shared_max, 10 * 10 / 64.0e0 AS shared_by_chance FROM o""")
def stability_halves(spark, sf):
    s = shares(spark, sf)
    h = splits.halves(s.select("sample_id").distinct(), 20).join(s, "sample_id").groupBy("split", "half", "probe").agg(F.avg(F.abs("share")).alias("m"))
    top = h.withColumn("r", F.row_number().over(Window.partitionBy("split", "half").orderBy(F.desc("m"), "probe"))).filter("r <= 10")
    o = top.groupBy("split", "probe").agg(F.count(F.lit(1)).alias("k")).groupBy("split").agg(F.count_if(F.col("k") == 2).alias("shared"))
    return rounded(o.agg(F.avg("shared").alias("shared_mean"), F.min("shared").alias("shared_min"), F.max("shared").alias("shared_max")).withColumn("shared_by_chance", F.lit(100 / 64.0)), "shared_mean")


ANNOT = ", ann AS (SELECT probe, 'g' || (probe % 7) || ';g' || (probe % 5) || ';g' || (probe % 7) AS genes, CASE WHEN probe % 4 = 0 THEN 'Island' WHEN probe % 4 = 1 THEN 'Shore' ELSE 'OpenSea' END AS relation FROM (SELECT CAST(unnest(range(64)) AS INT) AS probe))"


def annotation(spark):
    p = F.col("probe")
    g = lambda k: F.concat(F.lit("g"), (p % k).cast("string"))
    return spark.range(64).select(F.col("id").cast("int").alias("probe")).select("probe", F.concat_ws(";", g(7), g(5), g(7)).alias("genes"), F.when(p % 4 == 0, "Island").when(p % 4 == 1, "Shore").otherwise("OpenSea").alias("relation"))


@query(ATTR + ANNOT + """, m AS (SELECT probe, avg(share) AS d FROM sh GROUP BY 1), g AS (SELECT DISTINCT probe, unnest(string_split(genes, ';')) AS gene FROM ann)
 SELECT gene, count(*) AS n_probes, round(sum(d), 5) + 0.0 AS total, round(avg(d), 5) + 0.0 AS mean, CASE WHEN bool_and(d > 0) THEN 'hyper' WHEN bool_and(d < 0) THEN 'hypo' ELSE 'mixed' END AS direction FROM m JOIN g USING (probe) GROUP BY gene HAVING count(*) >= 10""")
def gene_like_groups(spark, sf):
    m = shares(spark, sf).groupBy("probe").agg(F.avg("share").alias("d"))
    g = annotation(spark).select("probe", F.explode(S.distinct_parts("genes")).alias("gene"))
    r = m.join(g, "probe").groupBy("gene").agg(F.count(F.lit(1)).alias("n_probes"), F.sum("d").alias("total"), F.avg("d").alias("mean"), F.when(F.bool_and(F.col("d") > 0), "hyper").when(F.bool_and(F.col("d") < 0), "hypo").otherwise("mixed").alias("direction"))
    return rounded(r.filter("n_probes >= 10"), "total", "mean", places=5)


@query(MEDIANS + ANNOT + """, picked AS (SELECT probe FROM ftrain GROUP BY probe ORDER BY var_samp(beta) DESC, probe LIMIT 20), j AS (SELECT relation, p.probe IS NOT NULL AS sel FROM ann LEFT JOIN picked p USING (probe))
 SELECT relation, count(*) FILTER (WHERE sel) AS n_selected, count(*) AS n_all, round(count(*) FILTER (WHERE sel) / 20.0, 6) + 0.0 AS share, round(count(*) / 64.0, 6) + 0.0 AS background FROM j GROUP BY relation""")
def context_share(spark, sf):
    sel = X.fit_top_variance(filled(spark, sf)[1], 20).select("probe").withColumn("sel", F.lit(1))
    r = annotation(spark).join(sel, "probe", "left").groupBy("relation").agg(F.count("sel").alias("n_selected"), F.count(F.lit(1)).alias("n_all"))
    return rounded(r.select("relation", "n_selected", "n_all", (F.col("n_selected") / 20).alias("share"), (F.col("n_all") / 64).alias("background")), "share", "background")


@query(ANNOT.replace(", ann", "WITH ann", 1) + " SELECT probe, genes FROM ann WHERE list_has_any(string_split(genes, ';'), ['g6', 'g4'])")
def alias_membership(spark, sf):
    return annotation(spark).filter(F.arrays_overlap(F.split("genes", ";"), F.array(F.lit("g6"), F.lit("g4")))).select("probe", "genes")


@query(SCORED + f", one AS (SELECT *, 1 AS k FROM scored WHERE truth < 7) SELECT n, {rsql('macro_f1', 'accuracy')} FROM ({summary_sql('one', 'k')})")
def shared_class_reference(spark, sf):
    """Metrics on the classes that another cohort has; predictions of other classes still count as errors."""
    shared = samples(spark, sf).filter("class < 7").select(F.col("class").alias("truth")).distinct()
    return rounded(M.summary(scored(spark, sf).join(shared, "truth", "left_semi")).select("n", "macro_f1", "accuracy"), "macro_f1", "accuracy")


@query(SCORED + " SELECT truth AS class, round((sum(rk) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) + 0.0 AS auc, n1 + n0 AS n, n1 AS n_positive FROM (SELECT truth, correct, (rank() OVER w + (count(*) OVER (PARTITION BY truth, confidence) - 1) / 2.0) * correct AS rk, sum(correct) OVER (PARTITION BY truth) AS n1, sum(1 - correct) OVER (PARTITION BY truth) AS n0 FROM scored WINDOW w AS (PARTITION BY truth ORDER BY confidence)) GROUP BY truth, n1, n0 HAVING n1 * n0 > 0".replace("n1 + n0 AS n, n1 AS n_positive", "CAST(n1 + n0 AS BIGINT) AS n, CAST(n1 AS BIGINT) AS n_positive"))
def auc_by_class(spark, sf):
    return rounded(M.auc(scored(spark, sf).withColumnRenamed("truth", "class"), "confidence", "correct", "class").filter("auc is not null"), "auc")


@query(SAMPLES + ", a AS (SELECT class, count(*) AS n_a FROM samples WHERE cohort = 'reference' GROUP BY 1), b AS (SELECT class, count(*) AS n_b FROM samples WHERE cohort = 'external' AND class <> 3 GROUP BY 1) SELECT class, coalesce(n_a, 0) AS n_reference, coalesce(n_b, 0) AS n_external, CASE WHEN n_b IS NULL THEN 'reference only' WHEN n_a IS NULL THEN 'external only' ELSE 'both' END AS status FROM a FULL JOIN b USING (class)")
def class_overlap(spark, sf):
    s = samples(spark, sf)
    n = lambda c, a: s.filter(c).groupBy("class").agg(F.count(F.lit(1)).alias(a))
    both = n("cohort = 'reference'", "a").join(n("cohort = 'external' and class <> 3", "b"), "class", "full_outer")
    return both.select("class", F.coalesce("a", F.lit(0)).alias("n_reference"), F.coalesce("b", F.lit(0)).alias("n_external"), F.when(F.col("b").isNull(), "reference only").when(F.col("a").isNull(), "external only").otherwise("both").alias("status"))


@query(SAMPLES + " SELECT class FROM samples GROUP BY class ORDER BY class")
def vocabulary(spark, sf):
    return samples(spark, sf).select("class").distinct().orderBy("class")


LEVELS = [1.0, 0.5, 0.1]
FLAGS = f""", flags AS (SELECT s.*, level, s.beta IS NOT NULL AND (level = 1.0 OR {U.format(7, 'sample_id, probe')} < level) AS seen FROM split s, (SELECT CAST(unnest([1.0, 0.5, 0.1]) AS DOUBLE) AS level))"""


def level_flags(spark, sf):
    """Cells of all samples at every coverage level, and medians of the training side of fold 0."""
    both = cells_of(folded(spark, sf))
    train = both.filter("outer_fold <> 0")
    return splits.observed_flags(both, LEVELS), train, X.fit_medians(X.keep_probes(train, X.fit_missingness(train)))


@query(MEDIANS + FLAGS + f" SELECT level, sample_id, probe, {rsql('beta')} FROM (SELECT level, sample_id, probe, CASE WHEN seen THEN beta ELSE CAST(median AS DOUBLE) END AS beta FROM flags JOIN med USING (probe) WHERE outer_fold = 0)")
def sparse_tree_inputs(spark, sf):
    """What trees get at each coverage level: the training median where a cell isn't seen."""
    flags, _, med = level_flags(spark, sf)
    return rounded(X.fill_unseen(flags.filter("outer_fold = 0"), med).select("level", "sample_id", "probe", "beta"), "beta")


@query(MEDIANS + FLAGS + """, st AS (SELECT probe, avg(beta) AS m, greatest(stddev_pop(beta), 1e-3) AS sd FROM train GROUP BY probe)
 SELECT level, sample_id, probe, round(CASE WHEN seen THEN (beta - m) / sd ELSE 0.0 END, 6) + 0.0 AS value, CAST(seen AS DOUBLE) AS flag FROM flags JOIN st USING (probe) WHERE outer_fold = 0""")
def sparse_net_inputs(spark, sf):
    """What nets get at each coverage level: the standardised value or 0, and a flag."""
    flags, train, _ = level_flags(spark, sf)
    return rounded(X.flag_unseen(flags.filter("outer_fold = 0"), train).select("level", "sample_id", "probe", "value", "flag"), "value")


@query(CELLS + f""", e AS (SELECT c.*, epoch, exp({U.format('9s', 'epoch, sample_id')} * ln(0.001)) AS share, {U.format(9, 'epoch, sample_id, probe')} AS u FROM cells c, (SELECT CAST(unnest(range(3)) AS INT) AS epoch))
 SELECT epoch, sample_id, round(any_value(share), 6) + 0.0 AS share, count(*) FILTER (WHERE beta IS NOT NULL AND u < share) AS n_seen FROM e GROUP BY epoch, sample_id""")
def masked_shares(spark, sf):
    """The share of cells that masked training shows of each sample in each epoch, and the number that it shows."""
    m = splits.masked_flags(cells(spark, sf), 3).groupBy("epoch", "sample_id").agg(F.first("share").alias("share"), F.count_if("seen").alias("n_seen"))
    return rounded(m, "share")


@query(MEDIANS + """, r AS (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY sample_id) AS i, row_number() OVER (PARTITION BY outer_fold ORDER BY md5('1|' || sample_id), sample_id) AS j FROM outers),
 lab AS (SELECT a.sample_id, b.class AS y FROM r a JOIN r b ON a.outer_fold = b.outer_fold AND a.i = b.j), fc AS (SELECT f.sample_id, f.outer_fold, y, probe, beta FROM filled f JOIN lab USING (sample_id)), tr AS (SELECT * FROM fc WHERE outer_fold <> 0),
 each AS (SELECT 'all' AS scope, * FROM fc UNION ALL SELECT 'train', * FROM tr), per AS (SELECT scope, probe, y, count(*) AS n, sum(beta) AS s, sum(beta * beta) AS q FROM each GROUP BY ALL),
 f AS (SELECT scope, probe, ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f FROM per GROUP BY scope, probe),
 pick AS (SELECT scope, probe FROM f QUALIFY row_number() OVER (PARTITION BY scope ORDER BY round(f, 9) DESC, probe) <= 10),
 cent AS (SELECT y, probe, avg(beta) AS mean FROM tr GROUP BY 1, 2), df AS (SELECT greatest(count(DISTINCT sample_id) - count(DISTINCT y), 1) AS df FROM tr),
 vars AS (SELECT probe, sum((beta - mean) * (beta - mean)) / max(df) + 1e-4 AS var FROM tr JOIN cent USING (y, probe), df GROUP BY probe),
 dist AS (SELECT scope, t.sample_id, t.y AS truth, c.y, sum(-2 * beta * mean / var + mean * mean / var) AS d, count(*) AS n FROM fc t JOIN pick USING (probe) JOIN cent c USING (probe) JOIN vars USING (probe) WHERE outer_fold = 0 GROUP BY 1, 2, 3, 4),
 ex AS (SELECT *, exp(-0.5 * (d - min(d) OVER (PARTITION BY scope, sample_id)) / n) AS e FROM dist), sc AS (SELECT scope, sample_id, truth, y, round(e / sum(e) OVER (PARTITION BY scope, sample_id), 9) AS p FROM ex), top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY scope, sample_id ORDER BY p DESC, y) = 1)
 SELECT scope, count(*) AS n, count(*) FILTER (WHERE y = truth) AS n_correct FROM top GROUP BY scope""")
def leakage_models(spark, sf):
    """Centroids fitted on shuffled labels of the training side, on probes selected by all rows or by the training side only: what the first adds on held-out rows is leakage."""
    every, _ = filled(spark, sf)
    shuffled = splits.shuffle_within(folds(spark, sf), "class", "outer_fold").select("sample_id", F.col("shuffled").alias("class"))
    every = every.drop("class").join(shuffled, "sample_id")
    train, held = every.filter("outer_fold <> 0"), every.filter("outer_fold = 0")
    top = lambda c: X.f_statistic(c).orderBy(F.desc(F.round("f", 9)), "probe").limit(10).select("probe")
    # Twenty rows at most.
    picked = top(every).withColumn("scope", F.lit("all")).unionByName(top(train).withColumn("scope", F.lit("train")))
    distances = models.centroid_distances(held.join(F.broadcast(picked), "probe"), models.fit_centroids(train), "scope")
    predicted = models.top_class(models.centroid_scores(distances, "scope"), "scope").join(shuffled, "sample_id")
    return predicted.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("class")).alias("n_correct"))


# Without SQL: models fitted by Spark ML, checked in tests on planted signals.


def _rows(spark, sf):
    """A row per sample with its array of cells, medians of the training side of fold 0, and the training side's cells. Rows and medians are made once for all passes."""
    rows = with_betas(folded(spark, sf)).persist()
    train = rows.filter("outer_fold <> 0").select("sample_id", "class", "material", F.posexplode("betas").alias("probe", "beta"))
    return rows, X.fit_medians(X.keep_probes(train, X.fit_missingness(train))).persist(), train


def _vectors(spark, sf):
    rows, med, _ = _rows(spark, sf)
    v = models.as_vectors(X.filled_arrays(rows, med), "class", "outer_fold")
    return v.filter("outer_fold <> 0"), v.filter("outer_fold = 0")


def _model(kind, **more):
    def run(spark, sf):
        train, test = _vectors(spark, sf)
        return models.fit_predict(kind, train, test, **more).select("sample_id", "class", "predicted")

    return run


@query()
def pca_embedding(spark, sf):
    every, _ = filled(spark, sf)
    return models.pca(models.vectors(every), 5)[0]


@query()
def rf_single_split(spark, sf):
    return _model("forest", trees=10)(spark, sf)


@query()
def lr_calibrated(spark, sf):
    """A forest's scores on the training side, then a multinomial calibrator fitted on their logarithms."""
    from pyspark.ml.functions import array_to_vector

    train, test = _vectors(spark, sf)
    log = lambda df: df.select("sample_id", "class", "outer_fold", array_to_vector(F.transform("proba", lambda x: F.log(F.greatest(x, F.lit(1e-4))))).alias("features"))
    inner, held = train.filter("pmod(hash(sample_id), 3) <> 0"), train.filter("pmod(hash(sample_id), 3) = 0")
    oof = log(models.fit_predict("forest", inner, held.union(test), by=("outer_fold",), trees=10))
    return models.fit_predict("logistic", oof.filter("outer_fold <> 0"), oof.filter("outer_fold = 0"), iterations=20).select("sample_id", "class", "predicted")


@query()
def mlp_plain(spark, sf):
    return _model("net", iterations=10)(spark, sf)


@query()
def ovr_boosting(spark, sf):
    """A hundred rounds, the fewest of the grid that this stands for (100 to 300)."""
    return _model("boosting", iterations=100)(spark, sf)


@query()
def oof_stack(spark, sf):
    """Out-of-fold centroid predictions: every sample is scored once, by the other folds."""
    from functools import reduce

    both = cells(spark, sf).join(folds(spark, sf).select("sample_id", "outer_fold"), "sample_id")
    part = lambda k: models.top_class(models.centroid_scores(models.centroid_distances(both.filter(F.col("outer_fold") == k), models.fit_centroids(both.filter(F.col("outer_fold") != k))))).withColumn("outer_fold", F.lit(k))
    return reduce(lambda a, b: a.unionByName(b), map(part, range(5)))


@query()
def final_fit_all(spark, sf):
    c = cells(spark, sf)
    pipe = X.FeaturePipeline(32).fit(c)
    return models.fit_centroids(pipe.transform(c)).select("class", "probe", "mean", "var")


@query()
def random_search(spark, sf):
    found = relational.random_search({"n_features": ("int", 10, 60, True), "floor": ("float", 1e-5, 1e-2, True), "kind": ("choice", ["raw", "log"])}, 8, 5)
    return spark.createDataFrame([(k, r["n_features"], float(r["floor"]), r["kind"]) for k, r in enumerate(found)], "trial int, n_features int, floor double, kind string")


def _levels(rows):
    """Rows of outer fold 0 at every coverage level."""
    return rows.filter("outer_fold = 0").withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))


@query()
def sparse_forest(spark, sf):
    """A forest fitted on fully covered samples, asked at every coverage level."""
    rows, med, _ = _rows(spark, sf)
    seen = X.filled_arrays(_levels(rows), med, splits.drawn_at_level)
    fitted_on = models.as_vectors(X.filled_arrays(rows.filter("outer_fold <> 0"), med), "class")
    return models.fit_predict("forest", fitted_on, models.as_vectors(seen, "class", "level"), by=("level",), trees=10).select("level", "sample_id", "class", "predicted")


@query()
def masked_net(spark, sf):
    """A perceptron fitted on copies of the training samples under masked_flags(), one an epoch, asked at every coverage level."""
    rows, _, train = _rows(spark, sf)
    scales = X.probe_scales(train).persist()  # a row per probe
    copies = X.flagged_arrays(splits.masked_epochs(rows.filter("outer_fold <> 0"), 3), scales, splits.drawn_in_epoch)
    held = X.flagged_arrays(_levels(rows), scales, splits.drawn_at_level)
    return models.fit_predict("net", models.as_vectors(copies, "class", "epoch"), models.as_vectors(held, "class", "level"), by=("level",), iterations=10).select("level", "sample_id", "class", "predicted")


@query()
def material_detector(spark, sf):
    """Material predicted for held-out classes, before and after correction: AUC per class."""
    rows, med, _ = _rows(spark, sf)
    # The shift is fitted on the detector's own training classes, so that nothing of the held-out ones enters it.
    own = rows.filter("class % 3 <> 0").select("sample_id", "class", "material", F.posexplode("betas").alias("probe", "beta"))
    shift = X.fit_shift(X.impute(own, med)).persist()

    def auc(of, corrected):
        v = models.as_vectors(of.withColumn("kind", (F.col("material") == "FFPE").cast("int")), "class", "kind").withColumnsRenamed({"class": "group", "kind": "class"}).persist()
        train, test = v.filter("group % 3 <> 0"), v.filter("group % 3 = 0")
        out = models.fit_predict("logistic", train, test, by=("group",), c=0.1, n=train.count(), iterations=20)
        got = M.auc(out.withColumn("s", F.col("proba")[1]), "s", "class", "group")
        return got.withColumn("corrected", F.lit(corrected))

    return auc(X.filled_arrays(rows, med), False).unionByName(auc(X.corrected_arrays(rows, med, shift), True))
