"""Rows with arrays of cells: what they give is what long cells give, without a shuffle of cells, and training rows are made once."""

import numpy as np
from cohortgrid.operators import features as X
from cohortgrid.operators import models, splits
from pyspark.sql import functions as F


def table(spark, n=60, probes=7):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, "Frozen" if i % 2 else "FFPE", [None if (i * 5 + p) % 11 == 0 else float(rng.random()) for p in range(probes)]) for i in range(n)]
    rows = spark.createDataFrame(rows, "sample_id long, class int, material string, betas array<double>")
    return rows, rows.select("sample_id", "class", "material", F.posexplode("betas").alias("probe", "beta"))


def values(df, *keep):
    return {tuple(r[k] for k in keep): [float(x) for x in r["features"].toArray()] for r in df.collect()}


def test_arrays_give_what_cells_give(spark):
    rows, cells = table(spark)
    med = X.fit_medians(cells.filter("probe <> 4"))
    assert values(models.as_vectors(X.filled_arrays(rows, med)), "sample_id") == values(models.vectors(X.impute(cells, med)), "sample_id")
    shift = X.fit_shift(X.impute(cells, med)).filter("probe <> 2")
    assert values(models.as_vectors(X.corrected_arrays(rows, med, shift)), "sample_id") == values(models.vectors(X.correct(X.impute(cells, med), shift)), "sample_id")


def test_coverage_levels_and_epochs_on_arrays(spark):
    rows, cells = table(spark)
    med, levels = X.fit_medians(cells), [1.0, 0.5, 0.1]
    flags, at = splits.observed_flags(cells, levels), rows.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    assert values(models.as_vectors(X.filled_arrays(at, med, splits.drawn_at_level), "level"), "sample_id", "level") == values(models.vectors(X.fill_unseen(flags, med), "level"), "sample_id", "level")
    scales = X.probe_scales(cells)
    for wide, long, by in (
        (X.flagged_arrays(at, scales, splits.drawn_at_level), X.flag_unseen(flags, cells), "level"),
        (X.flagged_arrays(splits.masked_epochs(rows, 3), scales, splits.drawn_in_epoch), X.flag_unseen(splits.masked_flags(cells, 3), cells), "epoch"),
    ):
        a, b = values(models.as_vectors(wide, by), "sample_id", by), values(models.flagged_vectors(long, by), "sample_id", by)
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_no_cell_is_shuffled_to_be_filled(spark):
    rows, cells = table(spark)
    med = spark.createDataFrame([(p, 0.5) for p in range(7)], "probe int, median float").repartition(3)
    assert shuffles(models.as_vectors(X.filled_arrays(rows, med))) == 0
    assert shuffles(X.impute(cells, med)) == 0


def test_training_rows_are_made_once(spark):
    rows, _ = table(spark)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    train = models.as_vectors(X.filled_arrays(rows, spark.createDataFrame([(p, 0.5) for p in range(7)], "probe int, median float")), "class")
    n = train.count()
    counted = train.select("sample_id", "class", F.lit(0).alias("z")).mapInArrow(count, "sample_id long, class int, z int").join(F.broadcast(train.drop("class")), "sample_id").drop("z")
    models.fit_predict("forest", counted, train, trees=2)
    # Once for the weights of classes and once for the fit; it was a pass more for each look at the rows and each of the fit's own.
    assert made.value <= 2 * n


def test_classes_fitted_at_once_are_those_fitted_one_by_one(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(k, k % 3, Vectors.dense([(k % 3) * 0.5 + (k * 7 % 11) / 10, k * 5 % 13 / 10])) for k in range(90)], ["sample_id", "class", "features"])
    at_once = models.estimator("boosting", 2, 3, iterations=1)
    assert at_once.getParallelism() > 1
    got, want = ([(r.sample_id, r.prediction) for r in e.fit(rows).transform(rows).orderBy("sample_id").collect()] for e in (at_once, at_once.copy().setParallelism(1)))
    assert got == want and len({p for _, p in got}) == 3
