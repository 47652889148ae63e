"""Contracts that queries call only on good tables: here on bad ones too."""

import pytest
from cohortgrid.functions import scalars as S
from cohortgrid.operators import contracts as C
from cohortgrid.operators import models
from cohortgrid.operators.contracts import ContractError


def test_unquote(spark):
    rows = spark.createDataFrame([('"a b"',), ("a",), ('"',), ('""',), ('"a" b',), (None,)], "t string")
    assert [r.x for r in rows.select(S.unquote("t").alias("x")).collect()][:2] == ["a b", "a"]


def test_same_vocabulary(spark):
    good = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a")], "file int, class string")
    C.same_vocabulary(good, "file", "class")
    with pytest.raises(ContractError, match="differ between"):
        C.same_vocabulary(good.union(spark.createDataFrame([(2, "c")], good.schema)), "file", "class")


def test_exclusive_flags(spark):
    C.exclusive_flags(spark.createDataFrame([(True, False), (False, True)], "a boolean, b boolean"), "a", "b")
    for both in (True, False):
        with pytest.raises(ContractError, match="agree"):
            C.exclusive_flags(spark.createDataFrame([(both, both)], "a boolean, b boolean"), "a", "b")


def test_classes_present_and_weights(spark):
    train = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "sample_id int, class int")
    every = spark.createDataFrame([(0,), (1,), (2,)], "class int")
    C.classes_present(train, every.filter("class < 2"), "class")
    assert {r["class"]: r.weight for r in models.class_weights(train, every.filter("class < 2")).collect()} == {0: 0.75, 1: 1.5}
    with pytest.raises(ContractError, match="no training row"):
        C.classes_present(train, every, "class")
    with pytest.raises(ContractError, match="no training row"):
        models.class_weights(train, every)


def test_dense_index_and_disjoint(spark):
    C.dense_index(spark.range(5), "id")
    for bad in (spark.range(1, 5), spark.range(0, 10, 2), spark.range(3).union(spark.range(3))):
        with pytest.raises(ContractError, match="isn't 0"):
            C.dense_index(bad, "id")
    C.disjoint(spark.range(3), spark.range(3, 5), "id")
    with pytest.raises(ContractError, match="both tables"):
        C.disjoint(spark.range(4), spark.range(3, 5), "id")
