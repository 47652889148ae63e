"""Order statistics by counting are those of sorting; the features of many splits at once are those of the pipeline, split by split, without a shuffle of cells."""

import numpy as np
import pytest
from cohortgrid.operators import boosting, passes
from cohortgrid.operators import features as X
from pyspark.sql import functions as F


def test_order_statistics_are_those_of_sorting(spark, monkeypatch):
    monkeypatch.setattr(passes, "GATHERED", 3)
    monkeypatch.setattr(passes, "HELD", 8 * passes.PARTS * 2)  # two ranges a pass

    def by_key(b):
        k, x = b.column(0).to_numpy(), np.array([[np.nan if v is None else v for v in r] for r in b.column(1).to_pylist()], float)
        for kk in set(k.tolist()):
            yield kk, x[k == kk]

    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=900), rng.integers(0, 3, 900) - 1.0, rng.random(900) * 10.0 ** rng.integers(-300, 300, 900), np.zeros(900), np.full(900, np.nan)], 1)
    x[::7, 0] = np.nan
    x[::2, 3] = -0.0
    rows = spark.createDataFrame([(i % 2, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "k int, x array<double>").repartition(5)
    ranks = lambda n: sorted({1, (n + 1) // 3 + 1, n // 2, n})
    got = passes.order_statistics(rows, by_key, ranks)
    for k in (0, 1):
        for f in range(5):
            v = np.sort(x[k::2, f][~np.isnan(x[k::2, f])])
            assert got[k][f].tolist() == ([float(v[r - 1]) for r in ranks(len(v))] if len(v) else [])


def test_bin_edges_are_the_values_at_their_ranks(spark):
    x = np.random.default_rng(1).random((500, 2)).round(2)
    rows = spark.createDataFrame([(0, r.tolist()) for r in x], "k int, x array<double>")
    got = boosting.bin_edges(rows, 16)[0]
    for f in range(2):
        v = np.sort(x[:, f])
        want = {v[int(np.ceil(q / 16 * 500)) - 1] for q in range(1, 16)}
        assert got[f].tolist() == sorted(w for w in want if w < v[-1])


def cells(spark, n=80, probes=9):
    rng = np.random.default_rng(2)
    rows = [(i, i % 4, "Frozen" if i % 3 == 0 else "FFPE", p, None if (i * 5 + p) % 31 == 0 or (p == 3 and i % 2) else float(np.float32(rng.random() * (1 + p % 5) / 5))) for i in range(n) for p in range(probes)]
    return spark.createDataFrame(rows, "sample_id long, class int, material string, probe int, beta double")


@pytest.mark.parametrize("correct", [False, True])
def test_splits_at_once_are_the_pipeline_split_by_split(spark, correct):
    c = cells(spark)
    splits = c.select("sample_id").distinct().withColumn("s", F.explode(F.array(*map(F.lit, (2, 5, 7))))).filter("s <> 7 or sample_id < 60").withColumn("held", F.pmod("sample_id", "s") == 0).select("s", "sample_id", "held")
    rows, probes = X.by_split(c, splits, 5, correct_material=correct)
    rows, probes = rows.collect(), probes.collect()
    for s in (2, 5, 7):
        own = c.join(splits.filter(F.col("s") == s), "sample_id")
        pipe = X.FeaturePipeline(5, correct_material=correct).fit(own.filter("not held"))
        want = {}
        for r in pipe.transform(own).collect():
            want.setdefault((r["sample_id"], r["class"], r["held"]), {})[r["probe"]] = r["beta"]
        assert sorted(p["probe"] for p in probes if p["s"] == s) == sorted(r["probe"] for r in pipe.probes.collect())
        got = {(r["sample_id"], r["class"], r["held"]): r["x"] for r in rows if r["s"] == s}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], [v for _, v in sorted(want[k].items())], atol=1e-7, rtol=0) for k in got)


def test_cells_are_not_shuffled_by_split(spark):
    c = cells(spark)
    splits = c.select("sample_id").distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("held", F.col("sample_id") % 20 == F.col("s"))
    rows, _ = X.by_split(c, splits.select("s", "sample_id", "held"), 5)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow") or "Join" not in plan.split("InMemoryRelation")[0]


def test_a_cell_that_is_nan_or_twice_stops_the_run(spark):
    c = cells(spark)
    splits = c.select("sample_id").distinct().select(F.lit(0).alias("s"), "sample_id", (F.col("sample_id") % 5 == 0).alias("held"))
    with pytest.raises(Exception, match="a cell is NaN"):
        X.by_split(c.withColumn("beta", F.when((F.col("sample_id") == 7) & (F.col("probe") == 1), F.lit(float("nan"))).otherwise(F.col("beta"))), splits, 5)
    with pytest.raises(Exception, match="a probe twice"):
        X.by_split(c.union(c.filter("sample_id = 7 and probe = 1")), splits, 5)
