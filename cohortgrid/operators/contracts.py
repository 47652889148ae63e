"""Data contracts. A check that fails raises ContractError, whose text begins "ERROR:" and names one offender.

Each needs one aggregate or one row; none brings data to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def fail(text: str) -> None:
    raise ContractError(f"ERROR: {text}")


def none_of(bad: DataFrame, text: str) -> None:
    """Fails if bad has a row, which is told."""
    if row := bad.first():
        fail(f"{text}, first: {row.asDict()}")


def required_columns(df: DataFrame, kinds: dict[str, str | None]) -> DataFrame:
    found = dict(df.dtypes)
    for name, kind in kinds.items():
        if name not in found:
            fail(f"column {name!r} is missing")
        if kind and found[name] != kind:
            fail(f"column {name!r} is {found[name]}, not {kind}")
    return df


def unique_key(df: DataFrame, *keys: str) -> DataFrame:
    none_of(repeated_keys(df, *keys), f"{', '.join(keys)} repeat")
    return df


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are only in a, only in b, in both."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full_outer")
    return both.agg(F.count(F.when(F.col("in_b").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("only_right"), F.count(F.when(F.col("in_a") & F.col("in_b"), 1)).alias("in_both"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    found = key_difference(a, b, key).first()
    if found["only_left"] or found["only_right"]:
        fail(f"{key}: {found['only_left']} only in the first table, {found['only_right']} only in the second")


def dense_index(df: DataFrame, index: str) -> DataFrame:
    """0 .. n-1, each once."""
    r = df.agg(F.min(index).alias("lo"), F.max(index).alias("hi"), F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("d")).first()
    if r["n"] and (r["lo"] != 0 or r["hi"] != r["n"] - 1 or r["d"] != r["n"]):
        fail(f"{index} isn't 0..{r['n'] - 1}")
    return df


def closed_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    none_of(df.filter(~F.col(column).isin(allowed) | F.col(column).isNull()).select(column), f"{column} is outside its domain")
    return df


def no_missing(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        none_of(df.filter(F.col(c).isNull()).select(*columns), f"{c} is missing")
    return df


def all_finite(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        x = F.col(c).cast("double")
        none_of(df.filter(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).select(c), f"{c} isn't finite")
    return df


def exclusive_flags(df: DataFrame, a: str, b: str) -> DataFrame:
    none_of(df.filter(F.col(a) == F.col(b)), f"{a} and {b} agree")
    return df


def exact_coverage(parts: DataFrame, whole: DataFrame, key: str) -> None:
    """Every key of whole once in parts, and no other."""
    unique_key(parts, key)
    same_keys(parts, whole, key)


def same_vocabulary(df: DataFrame, by: str, values: str) -> None:
    n = df.groupBy(by).agg(F.array_sort(F.collect_set(values)).alias("v")).select("v").distinct().count()
    if n > 1:
        fail(f"{values} differ between {by}")


def classes_present(train: DataFrame, classes: DataFrame, column: str) -> None:
    none_of(classes.select(column).distinct().join(train.select(column).distinct(), column, "left_anti"), f"no training row of a {column}")


def sentinel(df: DataFrame, inner: str, outer: str, k: int) -> None:
    """inner is -1 on the rows of outer fold k, and there only."""
    none_of(df.filter((F.col(inner) == -1) != (F.col(outer) == k)), f"{inner} is -1 elsewhere than on fold {k}")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    none_of(a.select(key).intersect(b.select(key)), f"{key} is in both tables")


def close(a: DataFrame, b: DataFrame, key: str, value: str, most: float) -> None:
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    none_of(both.filter(F.abs(F.col("x") - F.col("y")) > most), f"{value} differs by more than {most}")


def single_row(df: DataFrame, condition: Column) -> DataFrame:
    """The one row that meets the condition; none or several fail."""
    found = df.filter(condition)
    n = len(found.take(2))
    if n != 1:
        fail(f"expected one row, found {'none' if n == 0 else 'several'}")
    return found


def gate(allowed: bool, text: str) -> None:
    if not allowed:
        fail(text)
