"""Labels matched by aliases, and reports as tables of text."""

import pytest
from cohortgrid.operators import relational as R
from cohortgrid.operators.contracts import ContractError


def test_labels_and_aliases(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "b")], "id int, l string")
    known = lambda *r: spark.createDataFrame(r, "label string, key string")
    found = sorted((r.id, r.matched, r.how) for r in R.match_labels(rows, "l", known(("a", "A")), known(("b", "A"))).collect())
    assert found == [(1, "A", "exact"), (2, "A", "alias"), (3, None, "none"), (4, None, "none"), (5, "A", "alias")]
    with pytest.raises(ContractError, match="never used"):
        R.match_labels(rows, "l", known(("a", "A")), known(("x", "A")))
    with pytest.raises(ContractError, match="as it is"):
        R.match_labels(rows, "l", known(("a", "A")), known(("a", "A")))


def test_a_report_has_one_text_for_each_place(spark):
    rows = spark.createDataFrame([("m", "x", "1"), ("m", "y", "2"), ("n", "x", None)], "m string, c string, t string")
    assert sorted(map(tuple, R.report_pivot(rows, "m", "c", ["x", "y"], "t").collect())) == [("m", "1", "2"), ("n", "", "")]
    with pytest.raises(Exception, match="two texts"):
        R.report_pivot(rows.union(rows), "m", "c", ["x", "y"], "t").collect()
