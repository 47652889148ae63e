"""Relational building blocks: cascades, grids, keyed upserts, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import fail, none_of


def first_failure(steps: list[tuple[str, Column]]) -> Column:
    """Number (from 1) of the first step whose condition a row does not meet; null if it meets all."""
    return reduce(lambda acc, s: acc.when(~F.coalesce(s[1][1], F.lit(False)), F.lit(s[0])), enumerate(steps, 1), F.when(F.lit(False), F.lit(0)))


def filter_cascade(df: DataFrame, steps: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """The rows that meet all conditions, and per step how many of the rows still alive it removed and how many remain. One pass."""
    marked = df.withColumn("_fail", first_failure(steps))
    counts = marked.groupBy("_fail").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.range(1, len(steps) + 1).select(F.col("id").cast("int").alias("step"), F.get(F.array(*[F.lit(n) for n, _ in steps]), F.col("id").cast("int") - 1).alias("name"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("one", F.lit(1))
    # As many rows as steps.
    removed = names.join(counts.withColumnRenamed("_fail", "step"), "step", "left").fillna(0, ["n"]).withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    running = F.sum("n").over(Window.partitionBy("one").orderBy("step"))
    return marked.filter("_fail is null").drop("_fail"), removed.select("step", "name", F.col("n").alias("removed"), (F.col("total") - running).alias("remaining"))


def below_grid(df: DataFrame, value: str, cuts: list[float], medians: list[str] = ()) -> DataFrame:
    """Per cut: rows below it, their percentage, medians of other columns among them. A row is copied to the cuts above it only."""
    total = df.agg(F.count(value).alias("total")).withColumn("one", F.lit(1))
    hit = df.select(F.explode(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(value) < c)).alias("cut"), *medians)
    found = hit.groupBy("cut").agg(F.count(F.lit(1)).alias("n_below"), *[F.median(F.col(m).cast("double")).alias(f"median_{m}") for m in medians])
    grid = df.sparkSession.createDataFrame([(float(c), 1) for c in cuts], "cut double, one int")
    return grid.join(found, "cut", "left").fillna(0, ["n_below"]).join(F.broadcast(total), "one").select("cut", "n_below", F.round(100 * F.col("n_below") / F.col("total"), 2).alias("pct_below"), *[f"median_{m}" for m in medians])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows replace old's of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def best_per(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def inverse_rank(df: DataFrame, by: list[str], value: str, key: str, cuts: int = 256) -> DataFrame:
    """rank of each row within by, largest value first, nulls last, ties by key. A group is cut into ranges of equal width, ranked within each and shifted by the sizes of those above, so a task sees a range of a group."""
    names = [f"_by{k}" for k in range(len(by))]
    same = lambda t: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(t[n]) for c, n in zip(by, names, strict=True)])
    keys = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
    ends = df.groupBy(*keys).agg(F.max(value).cast("double").alias("_high"), (F.max(value).cast("double") - F.min(value).cast("double")).alias("_span"))
    # Where the span is 0 or infinite, all values are one range.
    place = F.floor((F.col("_high") - F.col(value).cast("double")) / F.col("_span") * cuts).cast("int")
    cut = F.when(F.col(value).isNull(), cuts + 1).when((F.col("_span") > 0) & (F.col("_span") < float("inf")), place).otherwise(0)
    dealt = df.join(ends, same(ends)).withColumn("_cut", cut).drop(*names, "_high", "_span")
    sizes = dealt.groupBy(*keys, F.col("_cut").alias("_at")).agg(F.count(F.lit(1)).alias("_size"))
    # At most cuts + 2 rows a group.
    above = sizes.withColumn("_above", F.sum("_size").over(Window.partitionBy(*names).orderBy("_at")) - F.col("_size"))
    within = F.row_number().over(Window.partitionBy(*by, "_cut").orderBy(F.desc(value), key))
    return dealt.withColumn("_k", within).join(above, same(above) & (F.col("_cut") == F.col("_at"))).withColumn("rank", F.col("_k") + F.col("_above")).drop(*names, "_cut", "_at", "_size", "_above", "_k")


def mode_per(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, n, the group's size, and whether others tie with it (the value is then the smallest)."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    top = n.withColumn("size", F.sum("n").over(w)).withColumn("_top", F.max("n").over(w)).filter("n = _top")
    return top.groupBy(*by).agg(F.min(value).alias(value), F.max("n").alias("n"), F.max("size").alias("size"), (F.count(F.lit(1)) > 1).alias("tie"))


def top_k_text(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """Per group: present, different values, and the k most frequent as "value (count)"; ties by value."""
    n = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.struct("r", value, "n")))), lambda s: F.format_string("%s (%d)", s[value], s["n"])), "; ")
    return r.groupBy(by).agg(F.sum("n").alias("n_present"), F.count(F.lit(1)).alias("n_distinct"), text.alias("top"))


def batch_numbers(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    return df.withColumn("batch", (F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size) + 1).cast("long"))


def largest_groups(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k largest groups; a tie at the cut-off fails."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(k + 1)
    rows = n.collect()
    if len(rows) > k and rows[k]["n"] == rows[k - 1]["n"]:
        fail(f"a tie between the {by} groups of size {rows[k]['n']}")
    return n.limit(k)


def match_labels(df: DataFrame, label: str, exact: DataFrame, aliases: DataFrame) -> DataFrame:
    """matched and how ("exact", "alias", "none"): by the label itself, else by its alias. exact, aliases: label, key, few rows each. An alias that no row has is an error, as is a label in both tables."""
    none_of(aliases.join(exact, "label", "left_semi").select("label"), "an alias of a label that is matched as it is")
    none_of(aliases.join(df.select(F.col(label).alias("label")), "label", "left_anti").select("label"), "an alias that is never used")
    of = lambda t, name: t.select(F.col("label").alias(label), F.col("key").alias(name))
    met = df.join(of(exact, "_exact"), label, "left").join(of(aliases, "_alias"), label, "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "alias").otherwise("none")
    return met.withColumns({"matched": F.coalesce("_exact", "_alias"), "how": how}).drop("_exact", "_alias")


def report_pivot(df: DataFrame, row: str, column: str, values: list, text: str) -> DataFrame:
    """A row per row, a column of text per value, "" where there is none; two texts for one place are an error."""
    once = F.when(F.count(text) > 1, F.raise_error(F.lit(f"ERROR: two texts for one {row} and {column}")).cast("string")).otherwise(F.coalesce(F.first(text, ignorenulls=True), F.lit("")))
    wide = df.groupBy(row).pivot(column, values).agg(once)
    return wide.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit("")).alias(str(v)) for v in values])


def settings_grid(spark, features: list[int], params: list[tuple[str, list]]) -> DataFrame:
    """Every combination, numbered s000, s001 ... in the order given; params as JSON with sorted keys."""
    import itertools
    import json

    rows = []
    for n, (f, *values) in enumerate(itertools.product(features, *[v for _, v in params])):
        rows.append((f"s{n:03d}", f, json.dumps(dict(sorted(zip([k for k, _ in params], values, strict=True))))))
    return spark.createDataFrame(rows, "setting string, n_features int, model_params string")


def random_search(space: dict[str, tuple], n: int, seed: int) -> list[dict]:
    """n draws from {name: ("choice", values) | ("int" | "float", low, high, log)}; a shorter search is a prefix of a longer one. A substitute for a model-based search."""
    import math
    import random

    out = []
    for k in range(n):
        rng, row = random.Random(f"{seed}|{k}"), {}
        for name, (kind, *spec) in sorted(space.items()):
            if kind == "choice":
                row[name] = rng.choice(spec[0])
            else:
                low, high, log = (*spec, False)[:3]
                x = math.exp(rng.uniform(math.log(low), math.log(high))) if log else rng.uniform(low, high)
                row[name] = round(x) if kind == "int" else x
        out.append(row)
    return out
