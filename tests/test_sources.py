"""Readers and sinks on temporary files."""

import gzip
import os

import pytest
from cohortgrid.operators.contracts import ContractError
from cohortgrid.sources import tables as T
from cohortgrid.streaming import incremental


def test_tsv_keeps_text_as_text(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write('id\tv\n1\tNA\n2\t\n03\t"q"\n')
    d = T.read_tsv(spark, str(tmp_path / "a.tsv.gz"), ["id"])
    assert [tuple(r) for r in d.collect()] == [("1", "NA"), ("2", ""), ("03", '"q"')]
    with pytest.raises(ContractError):
        T.read_tsv(spark, str(tmp_path / "a.tsv.gz"), ["missing"])


def test_series_header(spark, tmp_path):
    with open(tmp_path / "s.txt", "w", newline="") as f:
        f.write('!Series_x\t"no"\r\n!Sample_geo_accession\t"GSM1"\t"GSM2"\r\n!Sample_characteristics_ch1\t"type: a:b"\t"plain"\r\n"cg1"\t0.1\t0.2\r\n')
    got = [(r.key, r.position, r.cell) for r in T.read_series_header(spark, str(tmp_path / "s.txt")).orderBy("line", "position").collect()]
    assert got == [("geo_accession", 0, "GSM1"), ("geo_accession", 1, "GSM2"), ("characteristics_ch1", 0, "type: a:b"), ("characteristics_ch1", 1, "plain")]


def test_unpivot_turns_nan_to_null(spark):
    d = spark.createDataFrame([("cg1", 0.1, float("nan"))], "Probe_ID string, GSM1 double, GSM2 double")
    assert {(r.sample_id, r.beta) for r in T.unpivot_wide(d, "Probe_ID").collect()} == {("GSM1", 0.1), ("GSM2", None)}


def test_request_order(spark):
    d = spark.createDataFrame([(k,) for k in range(5)], "sample_id int")
    assert [r.sample_id for r in T.in_request_order(d, [3, 0, 4]).collect()] == [3, 0, 4]
    for ids in ([1, 1], [9]):
        with pytest.raises(ContractError):
            T.in_request_order(d, ids)


def test_write_once_audit_and_manifest(spark, tmp_path):
    d = spark.createDataFrame([(1, 0)], "sample_id int, fold int")
    T.append_once(d, str(tmp_path / "once"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        T.append_once(d, str(tmp_path / "once"))
    for _ in range(2):
        T.audit(d, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    for _ in range(2):
        T.check_manifest(str(tmp_path / "m.json"), {"a": 1}, d)
    with pytest.raises(ContractError):
        T.check_manifest(str(tmp_path / "m.json"), {"a": 2}, d)
    T.write_tsv(d.selectExpr("sample_id", "0.123456D as v"), str(tmp_path / "t"), {"v": "%.4f"})
    assert T.read_tsv(spark, str(tmp_path / "t")).first()["v"] == "0.1235"


def test_pairs(spark):
    d = spark.createDataFrame([("x/GSM1_1_R01C01_Grn.idat.gz",), ("x/GSM1_1_R01C01_Red.idat.gz",), ("x/GSM2_1_R01C01_Red.idat.gz",), ("readme",)], "path string")
    assert {r.gsm: r.complete for r in T.file_pairs(d).collect()} == {"GSM1": True, "GSM2": False}


def test_new_files_are_processed_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    d = spark.range(3)
    for n in (3, 6):
        d.write.mode("append").parquet(src)
        incremental.process_new(spark, src, d.schema, out, chk)
        assert spark.read.parquet(out).count() == n
    assert os.path.isdir(chk)
