"""Small files, stores, nested cross-validation."""

import io
import random
import tarfile
import zipfile

import numpy as np
import pytest
from cohortgrid.operators import contracts as C
from cohortgrid.operators import metrics as M
from cohortgrid.operators import nested as N
from cohortgrid.operators import splits
from cohortgrid.sources import files
from pyspark.sql import functions as F


def test_saved_scores(spark, tmp_path):
    np.savez(tmp_path / "a.npz", sample_ids=np.array(["s1", "s2"]), classes=np.array(["A", "B", "C"]), proba=np.arange(6, dtype=np.float32).reshape(2, 3) / 10)
    got = {(r.sample_id, r["class"]): round(r.p, 6) for r in files.read_scores(spark, f"{tmp_path}/*.npz").collect()}
    assert got == {("s1", "A"): 0, ("s1", "B"): 0.1, ("s1", "C"): 0.2, ("s2", "A"): 0.3, ("s2", "B"): 0.4, ("s2", "C"): 0.5}


def test_config(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# a run\nmodel: forest\nparams:\n  trees: 500  # many\n  space:\n    kind: [sqrt, log2]\n    name: 'a: b'\nlist:\n  - one\n  - key: two\n    more: 3\nlast: 0.1\n")
    got = {r.key: r.value for r in files.read_config(spark, f"{tmp_path}/c.yaml").collect()}
    assert got == {"model": "forest", "params.trees": "500", "params.space.kind": "[sqrt, log2]", "params.space.name": "a: b", "list.0": "one", "list.1.key": "two", "list.1.more": "3", "last": "0.1"}


def test_sheet_by_position(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><r><t>wo</t></r><r><t>rd</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2.5</v></c><c r="AA2" t="inlineStr"><is><t>far</t></is></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in files.read_sheet(spark, f"{tmp_path}/s.xlsx", {0: "word", 2: "number", 26: "far"}).collect()] == [(2, "word", "2.5", "far")]


def test_tar_entries(spark, tmp_path):
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        for name in ("GSM1_Grn.idat.gz", "../evil", "other.txt"):
            t.addfile(tarfile.TarInfo(name), io.BytesIO(b""))
    e = files.tar_entries(spark, f"{tmp_path}/t.tar", r"GSM\d+_(Grn|Red)\.idat\.gz")
    assert {r.name: r.ok for r in e.collect()} == {"GSM1_Grn.idat.gz": True, "../evil": False, "other.txt": False}
    with pytest.raises(C.ContractError):
        files.refuse_entries(e)


def test_store_reads_only_its_blocks_and_columns(spark, tmp_path):
    cells = spark.createDataFrame([(s, p, s + p / 1000) for s in range(6) for p in range(40)], "sample_id long, probe int, beta double")
    files.write_store(cells, f"{tmp_path}/store", block=8)
    got = files.read_store(spark, f"{tmp_path}/store", 10, 17, block=8, columns=["probe", "beta"])
    assert got.count() == 6 * 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan and "sample_id" not in plan.split("ReadSchema")[1]
    # Poison outside the blocks that are asked for is never read.
    for part in (tmp_path / "store" / "block=4").iterdir():
        part.write_bytes(b"poison")
    assert files.read_store(spark, f"{tmp_path}/store", 10, 17, block=8).count() == 48


def test_lookups_and_export(spark):
    cells = spark.createDataFrame([(s, p, 0.5) for s in (7, 8) for p in (1, 2)], "sample_id long, probe int, beta double")
    rows, cols = spark.createDataFrame([(0, 8), (1, 7)], "row int, sample_id long"), spark.createDataFrame([(0, 1), (1, 2)], "col int, probe int")
    files.open_lookups(rows, cols, cells)
    with pytest.raises(C.ContractError):
        files.open_lookups(rows, cols.withColumn("col", F.col("col") * 2), cells)
    with pytest.raises(C.ContractError):
        files.export_by_key(cols, spark.createDataFrame([(3,)], "probe int"), "probe")
    assert files.export_by_key(cols, spark.createDataFrame([(2,)], "probe int"), "probe").first().col == 1


def test_model_reload_is_checked(spark, tmp_path):
    model = spark.createDataFrame([(1, 0.25), (2, 0.5)], "sample_id long, w double")
    again = files.save_checked(model, f"{tmp_path}/m", lambda m: m.select("sample_id", (F.col("w") * 2).alias("p")), "sample_id", "p")
    assert again.count() == 2
    with pytest.raises(Exception, match="exists"):
        files.save_checked(model, f"{tmp_path}/m", lambda m: m, "sample_id", "w")


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(4)
    rows = [(s, s % 6, p, (0.3 + 0.3 * (s % 6 == p % 6) if p < 24 else 0.5) + rng.gauss(0, 0.08)) for s in range(180) for p in range(60)]
    return spark.createDataFrame(rows, "sample_id long, class int, probe int, beta double").withColumn("beta", F.when(F.hash("sample_id", "probe") % 100 != 0, F.col("beta"))).persist()


def test_nested_search_finds_planted_classes_and_reads_no_held_out_label(spark, cohort):
    folds = splits.stratified_folds(cohort.select("sample_id", "class").distinct())
    truth = cohort.select("sample_id", F.col("class").alias("truth")).distinct()
    best = N.select_settings(N.setting_scores(N.held_out_classes(cohort, N.inner_dealt(folds), [4, 24, 60]), truth))
    chosen = {r.outer: (r.setting, r.mean_f1) for r in best.collect()}
    assert set(chosen) == set(range(5)) and all(s >= 24 and f > 0.95 for s, f in chosen.values())
    found = N.held_out_classes(cohort, N.outer_dealt(folds), [24])
    right = found.join(truth, "sample_id").agg(F.avg((F.col("predicted") == F.col("truth")).cast("int"))).first()[0]
    assert right > 0.95
    # Poison in outer fold 2 changes nothing that is fitted for it, and each of its samples is scored once.
    held = folds.filter("outer_fold = 2").select("sample_id").withColumn("bad", F.lit(True))
    poisoned = cohort.join(held, "sample_id", "left").withColumn("beta", F.when(F.col("bad"), F.lit(1e6)).otherwise(F.col("beta"))).drop("bad")
    fits = [{(r["class"], r.probe): (r.mean, r["var"]) for r in N.fold_centroids(c, N.outer_dealt(folds)).filter("j = 2").collect()} for c in (cohort, poisoned)]
    assert fits[0].keys() == fits[1].keys()
    assert all(a == pytest.approx(fits[1][k], abs=1e-9) for k, a in fits[0].items())
    C.exact_coverage(found.select("sample_id"), truth.select("sample_id"), "sample_id")


def test_calibration_sharpens_timid_scores(spark):
    rng = random.Random(2)
    rows = []
    for s in range(200):
        right, p = rng.random() < 0.95, 0.55
        rows += [(s % 5, s, c, p if (c == s % 2) == right else 1 - p) for c in (0, 1)]
    scores = spark.createDataFrame(rows, "fold int, sample_id long, class int, p double")
    truth = spark.createDataFrame([(s, s % 2) for s in range(200)], "sample_id long, truth int")
    for r in N.cross_calibration(scores, truth, [0.5, 1.0, 4.0, 16.0]).collect():
        assert r.power == 16.0 and r.log_loss < r.raw_log_loss


def test_rows_are_numbered_without_gaps(spark):
    d = spark.range(1000).withColumnRenamed("id", "sample_id").withColumn("g", F.col("sample_id") % 3)
    assert sorted(r["_i"] for r in splits.numbered(d).collect()) == list(range(1000))
    for g in range(3):
        rows = splits.numbered(d, "g", buckets=7).filter(F.col("g") == g).collect()
        assert sorted(r["_i"] for r in rows) == list(range(len(rows))) and {r["_n"] for r in rows} == {len(rows)}


def test_summary_is_the_plain_metrics(spark):
    rng = random.Random(3)
    rows = [(s, rng.randrange(4), rng.randrange(5), rng.choice((0.1, 0.5, 0.92, 1.0)), rng.random()) for s in range(300)]
    d = spark.createDataFrame(rows, "sample_id long, truth int, predicted int, confidence double, brier double").withColumn("correct", (F.col("truth") == F.col("predicted")).cast("int"))
    r = M.summary(d).first()
    per = M.per_class(d).filter("n > 0").agg(F.avg("f1"), F.avg("recall")).first()
    sure = [x for x in rows if x[3] >= 0.9]
    assert (r.macro_f1, r.balanced_accuracy) == pytest.approx(tuple(per))
    assert r.accuracy == pytest.approx(np.mean([x[1] == x[2] for x in rows])) and r.brier == pytest.approx(np.mean([x[4] for x in rows]))
    assert r.confident_share == pytest.approx(len(sure) / 300) and r.confident_accuracy == pytest.approx(np.mean([x[1] == x[2] for x in sure]))
    assert r.ece == pytest.approx(M.ece(d.withColumn("one", F.lit(1)), "one").first().ece)


def test_tar_headers_are_walked_and_members_are_not_read(spark, tmp_path):
    from cohortgrid.sources import files

    names = ["GSM1_a_Grn.idat.gz", "d/" + "n" * 150 + ".gz", "../out.gz", "/abs.gz", "é.gz", "empty.gz"]
    for kind in (tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
        path = tmp_path / f"{kind}.tar"
        with tarfile.open(path, "w", format=kind) as t:
            for k, n in enumerate(names):
                m = tarfile.TarInfo(n)
                m.size = 0 if n == "empty.gz" else 700 * k + 1
                t.addfile(m, io.BytesIO(b"x" * m.size))
            d = tarfile.TarInfo("folder.gz")
            d.type = tarfile.DIRTYPE
            t.addfile(d)
            link = tarfile.TarInfo("link.gz")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            t.addfile(link)
        key = lambda r: (r.name.rstrip("/"), r.size, r.ok)
        walked = sorted(map(key, files.tar_index(spark, f"file://{path}", r".*\.gz").collect()))
        assert walked == sorted(map(key, files.tar_entries(spark, f"file://{path}", r".*\.gz").collect()))
        assert {n for n, _, ok in walked if ok} == {names[0], names[1], "é.gz", "empty.gz"}
    # A tar of over 2 GB whose first member is a hole.
    big = tmp_path / "big.tar"
    with open(big, "wb") as f:
        first, second = tarfile.TarInfo("a.gz"), tarfile.TarInfo("b.gz")
        first.size, second.size = 3 << 30, 5
        f.write(first.tobuf())
        f.seek(512 + first.size)
        f.write(second.tobuf() + b"hello".ljust(512, b"\0") + b"\0" * 1024)
    assert [tuple(r)[1:] for r in files.tar_index(spark, f"file://{big}", r".*\.gz").collect()] == [("a.gz", 3 << 30, True), ("b.gz", 5, True)]
    big.write_bytes(open(big, "rb").read(700))
    with pytest.raises(ValueError, match="ends inside"):
        files.tar_index(spark, f"file://{big}", ".*")
