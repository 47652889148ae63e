"""Fitted operators on small matrices with known answers, and poison tests: what is held out changes nothing that is fitted."""

import pytest
from cohortgrid.operators import contracts as C
from cohortgrid.operators import features as X
from cohortgrid.operators import metrics as M
from cohortgrid.operators import models, relational, splits
from pyspark.sql import functions as F

CELL = "sample_id int, class int, material string, probe int, beta double"


def cells(spark, rows):
    return spark.createDataFrame(rows, CELL)


def test_missingness_boundary_is_kept(spark):
    rows = [(s, 0, "FFPE", p, None if (p == 0 and s < 1) or (p == 1 and s < 2) else 0.5) for s in range(20) for p in range(3)]
    assert {r.probe for r in X.fit_missingness(cells(spark, rows), 0.05).collect()} == {0, 2}


def test_median_of_even_count_is_the_middle(spark):
    rows = [(s, 0, "FFPE", 0, v) for s, v in enumerate([0.1, 0.2, 0.4, 0.9, None])]
    c = cells(spark, rows)
    assert X.fit_medians(c).first()["median"] == pytest.approx(0.3)
    assert X.impute(c, X.fit_medians(c)).filter("sample_id = 4").first()["beta"] == pytest.approx(0.3)


def test_all_missing_probe_fails(spark):
    with pytest.raises(C.ContractError, match="^ERROR:"):
        X.check_medians(X.fit_medians(cells(spark, [(0, 0, "FFPE", 0, None)])))


def hand_made(spark):
    rows = [(k, 0, m, 0, 0.2 + (0.2 if m == "FFPE" else 0)) for k, m in enumerate(["FFPE"] * 2 + ["Frozen"] * 2)]
    rows += [(k + 10, 1, m, 0, 0.3 + (0.4 if m == "FFPE" else 0)) for k, m in enumerate(["FFPE"] * 2 + ["Frozen"] * 6)]
    return cells(spark, rows)


def test_shift_is_weighted_over_classes(spark):
    assert X.fit_shift(hand_made(spark)).first()["shift"] == pytest.approx(0.32, abs=1e-6)


def test_correction_moves_and_clips_one_material_only(spark):
    c = hand_made(spark)
    got = {r.sample_id: r.beta for r in X.correct(c, X.fit_shift(c)).collect()}
    assert got[2] == pytest.approx(0.2) and got[0] == pytest.approx(0.08, abs=1e-6)


def test_unknown_material_fails(spark):
    c = hand_made(spark)
    with pytest.raises(C.ContractError):
        X.check_materials(c, c.withColumn("material", F.lit("paper")))


def test_top_variance_ties_to_the_lower_probe(spark):
    rows = [(s, 0, "FFPE", p, float(s % 2)) for s in range(4) for p in (3, 1, 2)]
    assert {r.probe for r in X.fit_top_variance(cells(spark, rows), 2).collect()} == {1, 2}


def test_poison_in_test_rows_changes_no_fit(spark):
    rows = [(s, s % 3, "FFPE" if s % 2 else "Frozen", p, ((s * 7 + p * 3) % 11) / 11) for s in range(24) for p in range(6)]
    c = cells(spark, rows)
    poisoned = c.withColumn("beta", F.when(F.col("sample_id") >= 18, F.lit(1e6)).otherwise(F.col("beta")))
    fits = [X.FeaturePipeline(3, correct_material=True).fit(d.filter("sample_id < 18")) for d in (c, poisoned)]
    for what in ("medians", "shift", "probes"):
        a, b = (sorted(map(tuple, getattr(f, what).collect())) for f in fits)
        # Sums may be added in another order; a trace of 1e6 would be far above this.
        assert [x[0] for x in a] == [x[0] for x in b]
        assert [x[1:] for x in a] == [pytest.approx(x[1:], abs=1e-9) for x in b]
    # The converse: poison in a training row does show.
    assert sorted(map(tuple, X.fit_medians(c).collect())) != sorted(map(tuple, X.fit_medians(poisoned).collect()))


def test_planted_classes_are_found(spark):
    import random

    rng = random.Random(1)
    rows = [(s, s % 4, "FFPE", p, 0.2 + 0.15 * ((s % 4) == p % 4) + rng.gauss(0, 0.05)) for s in range(80) for p in range(20)]
    c = cells(spark, rows)
    train, test = c.filter("sample_id < 60"), c.filter("sample_id >= 60")
    top = models.top_class(models.centroid_scores(models.centroid_distances(test, models.fit_centroids(train))))
    assert all(r.predicted == r.sample_id % 4 for r in top.collect())
    v = models.vectors(c, "class")
    out = models.fit_predict("forest", v.filter("sample_id < 60"), v.filter("sample_id >= 60"), trees=20)
    assert out.filter("predicted = class").count() >= 18


def test_attribution_adds_up(spark):
    rows = [(s, s % 2, "FFPE", p, ((s * 5 + p * 3) % 7) / 7) for s in range(12) for p in range(5)]
    c = cells(spark, rows)
    cent = models.fit_centroids(c)
    total = {r[0]: r[1] for r in models.linear_attribution(c, cent, 0).groupBy("sample_id").agg(F.sum("share")).collect()}
    dist = {(r.sample_id, r["class"]): r.distance for r in models.centroid_distances(c, cent).collect()}
    for s, t in total.items():
        assert t == pytest.approx(-dist[s, 0] / 2 + (dist[s, 0] + dist[s, 1]) / 4, abs=1e-6)


def test_macro_averages_run_over_classes_in_the_truth(spark):
    s = spark.createDataFrame([(0, 0, 0, 0.95, 1, 0.0), (1, 0, 2, 0.5, 0, 0.0), (2, 1, 1, 1.0, 1, 0.0)], "sample_id int, truth int, predicted int, confidence double, correct int, brier double")
    r = M.summary(s).first()
    assert r.macro_f1 == pytest.approx((2 / 3 + 1) / 2) and r.balanced_accuracy == pytest.approx(0.75)
    assert r.confident_share == pytest.approx(2 / 3) and r.confident_accuracy == 1
    assert r.ece == pytest.approx((abs(2 - 1.95) + 0.5) / 3)


def test_precision_is_null_without_predictions(spark):
    s = spark.createDataFrame([(0, 0, 1, 0)], "sample_id int, truth int, predicted int, correct int")
    got = {r["class"]: r for r in M.per_class(s).collect()}
    assert got[0].precision is None and got[1].recall is None


def test_masks_are_nested_and_independent_of_other_rows(spark):
    c = cells(spark, [(s, 0, "FFPE", p, 0.5) for s in range(10) for p in range(200)])
    seen = lambda d: {(r.sample_id, r.probe, r.level) for r in splits.observed(d, [1.0, 0.5, 0.1]).collect()}
    full, part = seen(c), seen(c.filter("sample_id = 3"))
    assert {x for x in full if x[0] == 3} == part
    assert {x[:2] for x in full if x[2] == 0.1} <= {x[:2] for x in full if x[2] == 0.5}
    assert len([x for x in full if x[2] == 1.0]) == 2000 and abs(len([x for x in full if x[2] == 0.5]) - 1000) < 150


def test_folds_hold_every_class_and_a_sentinel(spark):
    s = spark.createDataFrame([(k, k % 3) for k in range(45)], "sample_id int, class int")
    f = splits.stratified_folds(s)
    assert f.groupBy("outer_fold", "class").count().count() == 15
    for k in range(5):
        C.sentinel(f.select("outer_fold", F.col("inner")[k].alias("inner")), "inner", "outer_fold", k)


def test_cascade_counts_only_rows_still_alive(spark):
    d = spark.range(10)
    kept, steps = relational.filter_cascade(d, [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 5)])
    assert [tuple(r) for r in steps.orderBy("step").collect()] == [(1, "even", 5, 5), (2, "small", 2, 3)]
    assert {r.id for r in kept.collect()} == {0, 2, 4}


def test_random_search_is_a_prefix_of_a_longer_one():
    space = {"a": ("int", 1, 9), "b": ("float", 1e-3, 1.0, True)}
    assert relational.random_search(space, 3, 1) == relational.random_search(space, 6, 1)[:3]


def test_contracts_fail_loudly(spark):
    d = spark.createDataFrame([(0, "a"), (0, "b"), (2, None)], "k int, v string")
    for check in (lambda: C.unique_key(d, "k"), lambda: C.dense_index(d, "k"), lambda: C.no_missing(d, "v"), lambda: C.closed_domain(d, "v", ["a"]), lambda: C.required_columns(d, {"w": None}), lambda: C.required_columns(d, {"k": "string"}), lambda: C.same_keys(d, d.filter("k = 2"), "k"), lambda: C.disjoint(d, d, "k"), lambda: C.single_row(d, F.col("k") == 0), lambda: C.gate(False, "closed"), lambda: relational.largest_groups(d.union(spark.createDataFrame([(2, "z")], d.schema)), "k", 1)):
        with pytest.raises(C.ContractError, match="^ERROR:"):
            check()


def test_inverse_rank_against_sorting(spark):
    values = [None, 1.0, 1.0, -3.5, 7.25, 1e300, 2.0, 2.0, None, 0.0]
    rows = [(g, k, v) for g in ("a", None) for k, v in enumerate(values)] + [("same", k, 4.0) for k in range(5)] + [("wide", k, v) for k, v in enumerate((float("inf"), 1.0, -float("inf"), 2.0, float("nan")))]
    got = {(r.g, r.k): r["rank"] for r in relational.inverse_rank(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], "v", "k", cuts=4).collect()}
    want = {}
    for g in ("a", None, "same", "wide"):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, r[2] == r[2], -(r[2] or 0.0), r[1]))
        want |= {(g, r[1]): n for n, r in enumerate(order, 1)}
    assert got == want


def test_unseen_cells_take_the_training_median_or_a_flag(spark):
    train = cells(spark, [(s, 0, "FFPE", p, v) for s, v in enumerate([0.2, 0.4, 0.6]) for p in (0, 1)])
    held = cells(spark, [(9, 0, "FFPE", 0, 0.9), (9, 0, "FFPE", 1, None)])
    flags = splits.observed_flags(held, [1.0, 0.0])
    tree = {(r.level, r.probe): r.beta for r in X.fill_unseen(flags, X.fit_medians(train)).collect()}
    assert tree == pytest.approx({(1.0, 0): 0.9, (1.0, 1): 0.4, (0.0, 0): 0.4, (0.0, 1): 0.4}, abs=1e-6)
    net = {(r.level, r.probe): (r.value, r.flag) for r in X.flag_unseen(flags, train).collect()}
    assert net[1.0, 0] == pytest.approx((0.5 / (0.08 / 3) ** 0.5, 1.0)) and net[1.0, 1] == net[0.0, 0] == net[0.0, 1] == (0.0, 0.0)
    v = models.flagged_vectors(X.flag_unseen(flags, train), "level").filter("level = 1.0").first()["features"]
    assert list(v[1:]) == [0.0, 1.0, 0.0]


def test_masked_training_shares_are_log_uniform_and_redrawn_each_epoch(spark):
    many = cells(spark, [(s, 0, "FFPE", p, 0.5) for s in range(300) for p in range(20)])
    shown = splits.masked_flags(many, 2).groupBy("epoch", "sample_id").agg(F.first("share").alias("share"), F.avg(F.col("seen").cast("int")).alias("got")).collect()
    shares = [r.share for r in shown]
    assert 0.001 <= min(shares) and max(shares) <= 1.0
    assert 0.4 < sum(x < 0.001**0.5 for x in shares) / len(shares) < 0.6
    assert sum(r.got for r in shown) / len(shown) == pytest.approx(sum(shares) / len(shares), abs=0.02)
    by = {(r.epoch, r.sample_id): r.share for r in shown}
    assert all(by[0, s] != by[1, s] for s in range(300))


@pytest.mark.parametrize("parts", [7, 256])
def test_refined_medians_are_medians(spark, parts):
    import random
    import statistics
    import struct

    rng, values = random.Random(parts), {}
    for probe in range(12):
        n = rng.randrange(1, 60)
        draw = [lambda: rng.random(), lambda: rng.choice([0.1, 0.2, 0.2]), lambda: rng.gauss(0, 1e-12), lambda: rng.choice([-1e9, 1e-9, 3.0])][probe % 4]
        values[probe] = [draw() for _ in range(n)]
    rows = [(k, p, x) for p, v in values.items() for k, x in enumerate([*v, None])] + [(0, 99, None)]
    found = {r.probe: r["median"] for r in X.refined_medians(spark.createDataFrame(rows, "sample_id long, probe int, beta double").repartition(3), parts=parts).collect()}
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    assert found.pop(99) is None and found == {p: pytest.approx(single(statistics.median(v)), rel=1e-6, abs=1e-18) for p, v in values.items()}
    both = spark.createDataFrame([(s, s, p, x + s) for s in (0, 5) for _, p, x in rows if x is not None], "s int, sample_id long, probe int, beta double")
    by = {(r.s, r.probe): r["median"] for r in X.refined_medians(both, "s", parts=parts).collect()}
    assert len(by) == 24 and by == {(r.s, r.probe): pytest.approx(r["median"], rel=1e-6) for r in X.fit_medians(both, "s").collect()}
