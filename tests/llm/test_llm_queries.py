"""The registered queries against their SQL, and the pipeline against what its stages are to do."""

import corpus_pipeline
import pytest
from cohortgrid.llm.queries import oracle_sql, queries
from compare import connect, differences
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, connect(SF), SF, queries()[name], oracle_sql()[name]) == ""


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pipeline_keeps_what_its_stages_keep(spark):
    docs, before = corpus_pipeline.table(spark, SF, "documents"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        found = [tuple(r) for r in out.collect()]
        rows = set(found)
        assert out.columns == docs.columns
        assert before is None or rows <= before, name
        if name in ("exact", "near"):
            texts = [r[1].translate(FOLD) for r in found]
            assert len(texts) == len(set(texts)) > 50
        before = rows
        docs = spark.createDataFrame(found, docs.schema).coalesce(1)
    final = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in final.collect()) == sorted(r[0] for r in found)


def test_stages_take_any_documents(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good, other = (" ".join(f"{w}{k}" for k in range(70)) for w in ("word", "term"))
    long = " ".join(f"long{k}" for k in range(30_000))
    texts = [(1, good), (1, good), (None, good.upper()), (2, other), (3, other + " end"), (4, None), (5, ""), (None, None), (6, long), (7, "a b c " * 60), (8, "few words")]
    schema = "doc_id long, text string, _row string, _ROW_ string, kept int, _metadata string, copies int"
    rows = spark.createDataFrame([(*t, "r", "R", 0, "m", 3) for t in texts], schema)
    # By hand: what quality leaves, then one of equal texts (the largest id, nulls last), then one of near ones.
    want = {"quality": [1, 1, None, 2, 3, 6], "exact": [1, 2, 3, 6], "near": [1, 3, 6]}
    docs = rows.withColumn("source", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        found = out.collect()
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name in want:
            assert sorted((r.doc_id for r in found), key=str) == sorted(want[name], key=str), name
        docs = spark.createDataFrame(found, docs.schema)
    assert {r.doc_id for r in found} <= {1, 3, 6}
    assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == len(texts)


def test_copies_take_effect(spark):
    docs = corpus_pipeline.stable(spark.createDataFrame([(k, f"t{k}") for k in range(5)], "doc_id long, text string").coalesce(1))
    rows = spark.createDataFrame([(0, 2), (3, 1)], "_row long, copies long")
    assert sorted(r.doc_id for r in corpus_pipeline.only(docs, rows, copies=True).collect()) == [0, 0, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.only(docs, rows).collect()) == [0, 3]
