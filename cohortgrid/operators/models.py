"""Models: the nearest centroid (all DataFrame operations), and Spark ML ones on assembled vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import classes_present, none_of

VAR_FLOOR = 1e-4
#: One-against-the-rest fits that run at once; each keeps its own binned copy of the rows while it lasts.
CLASSES_AT_ONCE = 10
#: Rows of a task in boosting's fits: hundreds of short jobs a class, of which tasks with fewer rows are all start-up.
BOOSTED_ROWS = 8192
def beta() -> Column:
    return F.col("beta").cast("double")


def fit_centroids(cells: DataFrame) -> DataFrame:
    """class, probe, a = mean / variance, b = mean^2 / variance; the variance is pooled within classes, n - K degrees (1 at least), plus a floor."""
    seen = cells.filter("beta is not null")
    per = seen.groupBy("class", "probe").agg(F.avg(beta()).alias("mean"), (F.var_pop(beta()) * F.count(beta())).alias("ss"))
    size = seen.agg(F.greatest(F.countDistinct("sample_id") - F.countDistinct("class"), F.lit(1)).alias("df"))
    # One row.
    pooled = per.groupBy("probe").agg(F.sum("ss").alias("ss")).withColumn("one", F.lit(1)).join(F.broadcast(size.withColumn("one", F.lit(1))), "one")
    var = pooled.select("probe", (F.col("ss") / F.col("df") + VAR_FLOOR).alias("var"))
    return per.join(var, "probe").select("class", "probe", "mean", "var", (F.col("mean") / F.col("var")).alias("a"), (F.col("mean") * F.col("mean") / F.col("var")).alias("b"))


def centroid_distances(cells: DataFrame, centroids: DataFrame, *by: str) -> DataFrame:
    """Per sample and class: the distance over observed probes, without the term that is equal for all classes, and the probes observed."""
    met = cells.filter("beta is not null").select(*by, "sample_id", "probe", beta().alias("x")).join(centroids.select("class", "probe", "a", "b"), "probe")
    return met.groupBy(*by, "sample_id", "class").agg(F.sum(-2 * F.col("x") * F.col("a") + F.col("b")).alias("distance"), F.count(F.lit(1)).alias("n_obs"))


def centroid_scores(distances: DataFrame, *by: str) -> DataFrame:
    """p: softmax of minus half the distance per observed probe; its order is what counts."""
    w = Window.partitionBy(*by, "sample_id")
    e = distances.withColumn("e", F.exp(-0.5 * (F.col("distance") - F.min("distance").over(w)) / F.greatest("n_obs", F.lit(1))))
    return e.select(*by, "sample_id", "class", F.round(F.col("e") / F.sum("e").over(w), 9).alias("p"))


def top_class(scores: DataFrame, *by: str) -> DataFrame:
    """The class of the largest score, ties to the lower class: one row a sample."""
    w = Window.partitionBy(*by, "sample_id").orderBy(F.desc("p"), "class")
    return scores.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*by, "sample_id", F.col("class").alias("predicted"), F.col("p").alias("confidence"))


def linear_attribution(cells: DataFrame, centroids: DataFrame, target: int) -> DataFrame:
    """Each probe's exact share in minus half the distance to one class relative to the mean of all: shares add up to the score."""
    n = F.col("x") * F.col("a") - F.col("b") / 2
    met = cells.filter("beta is not null").select("sample_id", "probe", beta().alias("x")).join(centroids.select("class", "probe", "a", "b"), "probe")
    return met.groupBy("sample_id", "probe").agg((F.sum(F.when(F.col("class") == target, n)) - F.avg(n)).alias("share"))


def vectors(cells: DataFrame, *keep: str) -> DataFrame:
    """A row per sample with its betas in the order of probes, as a vector; missing cells are not allowed."""
    none_of(cells.filter("beta is null").select("sample_id", "probe"), "a missing cell; impute first")
    rows = cells.groupBy("sample_id", *keep).agg(F.array_sort(F.collect_list(F.struct("probe", beta().alias("x")))).alias("v"))
    return rows.select("sample_id", *keep, array_to_vector(F.transform("v", lambda s: s["x"])).alias("features"))


def flagged_vectors(flags: DataFrame, *keep: str) -> DataFrame:
    """A row per sample (and keep): all values in the order of probes, then all flags, as one vector."""
    rows = flags.groupBy("sample_id", *keep).agg(F.array_sort(F.collect_list(F.struct("probe", "value", "flag"))).alias("v"))
    return rows.select("sample_id", *keep, array_to_vector(F.concat(F.transform("v", lambda s: s["value"]), F.transform("v", lambda s: s["flag"]))).alias("features"))


def as_vectors(rows: DataFrame, *keep: str) -> DataFrame:
    """vectors() of rows that have their values as one array, x."""
    none_of(rows.filter(F.exists("x", lambda v: v.isNull())).select("sample_id"), "a missing cell; impute first")
    return rows.select("sample_id", *keep, array_to_vector("x").alias("features"))


def class_weights(rows: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """n / (K n_c) for each class. With classes (class): a class that no row has is an error."""
    if classes is not None:
        classes_present(rows, classes, "class")
    per = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(F.lit(1))
    return per.select("class", "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def estimator(kind: str, n_features: int, n_classes: int, seed: int = 1, **more):
    """forest: balanced by class weight (a substitute for balancing each tree's sample); boosting: one against the rest (a substitute for multiclass boosting);
    logistic: multinomial, c as in a summed loss; net: a perceptron without dropout."""
    common = {"featuresCol": "features", "labelCol": "class"}
    if kind == "forest":
        return RandomForestClassifier(numTrees=more.get("trees", 50), featureSubsetStrategy="sqrt", weightCol="weight", seed=seed, **common)
    if kind == "boosting":
        return OneVsRest(classifier=GBTClassifier(maxIter=more.get("iterations", 3), maxDepth=3, seed=seed, **common), parallelism=CLASSES_AT_ONCE, **common)
    if kind == "logistic":
        scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
        fit = LogisticRegression(featuresCol="scaled", labelCol="class", family="multinomial", standardization=False, elasticNetParam=0.0, regParam=1 / (more.get("c", 1.0) * max(more.get("n", 1), 1)), maxIter=more.get("iterations", 50))
        return Pipeline(stages=[scaled, fit])
    if kind == "net":
        return MultilayerPerceptronClassifier(layers=[n_features, more.get("hidden", 32), n_classes], maxIter=more.get("iterations", 30), seed=seed, **common)
    raise ValueError(f"ERROR: unknown model {kind!r}")


def fit_predict(kind: str, train: DataFrame, test: DataFrame, seed: int = 1, by: tuple[str, ...] = (), **more) -> DataFrame:
    """by (columns of the test rows), sample_id, class, predicted, proba of the test rows. The training rows are kept while the fit passes over them: what they are made of is done once."""
    weighted = train.join(F.broadcast(class_weights(train).select("class", "weight")), "class").persist()
    n_features, (most, n) = len(weighted.first()["features"]), weighted.agg(F.max("class"), F.count(F.lit(1))).first()
    dealt = weighted.coalesce(-(-n // BOOSTED_ROWS)) if kind == "boosting" else weighted
    out = estimator(kind, n_features, int(most) + 1, seed, **more).fit(dealt).transform(test)
    weighted.unpersist()
    proba = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
    return out.select(*by, "sample_id", "class", F.col("prediction").cast("int").alias("predicted"), proba.alias("proba"))


def pca(rows: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """sample_id, component (from 0), score, share (of the variance); and the shares. A component's largest weight is positive, so signs are fixed."""
    import numpy as np

    fitted = PCA(k=k, inputCol="features", outputCol="pc").fit(rows)
    # k weights a feature: small.
    weights = np.array(fitted.pc.toArray())
    signs = np.sign(weights[np.abs(weights).argmax(0), range(k)])
    shares = [float(x) for x in fitted.explainedVariance]
    each = fitted.transform(rows).select("sample_id", F.posexplode(vector_to_array("pc")).alias("component", "score"))
    fixed = [F.get(F.array(*[F.lit(float(x)) for x in v]), F.col("component")) for v in (signs, shares)]
    return each.select("sample_id", "component", (F.col("score") * fixed[0]).alias("score"), fixed[1].alias("share")), shares
