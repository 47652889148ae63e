"""Trees as tables of nodes, and exact attributions of their scores (Shapley values along the trees' own paths).

Nodes: tree, node, feature (-1 for a leaf), threshold (a row goes left if its value is at
most that), left, right, cover (fitting rows), value (what a leaf adds to each class's
score). paths() lays each leaf's way down as bounds per feature with the share of cover
that follows them. A row's attribution is a sum over leaves: with d features on the way,
feature i gets (followed_i - share_i) times the leaf's value times the weighted sum over
subsets of the other features, which a polynomial in the subset's size gives in d steps
instead of 2^d. With base (the scores' mean over covers) attributions add up to the score.

Scale: rows stay where they are; paths are sent to them in chunks of whole trees of at
most MAX_PATHS bytes, and chunks' sums meet per row and feature in one shuffle. A task
holds a block of rows x paths x depth numbers, whatever the forest's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import none_of

NODES = "tree int, node int, feature int, threshold double, left int, right int, cover double, value array<double>"
PATHS = "tree int, leaf int, features array<int>, low array<double>, high array<double>, share array<double>, value array<double>"
#: Bytes of paths that are sent to the rows at once, and numbers that a task works on at once.
MAX_PATHS, BLOCK = 64 << 20, 4_000_000


def forest_nodes(model, path: str) -> DataFrame:
    """Nodes of a fitted Spark ML forest or tree, through its own format: it is saved under path and its tables are read. Leaves hold class shares over the number of trees, so that scores are the model's probabilities."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    model.write().save(path)
    raw = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID") if "treeID" in raw.columns else F.lit(0)
    raw = raw.select(tree.alias("tree"), F.col("nodeData" if "nodeData" in raw.columns else "*")).select("tree", "nodeData.*")
    none_of(raw.filter("split.numCategories >= 0").select("tree", "id"), "a categorical split")
    # One number.
    n = raw.select("tree").distinct().count()
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    value = F.when(F.col("leftChild") < 0, F.transform("impurityStats", lambda x: x / total / n))
    return raw.select(
        "tree", F.col("id").alias("node"), F.when(F.col("leftChild") < 0, -1).otherwise(F.col("split.featureIndex")).alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("rawCount").cast("double").alias("cover"), value.alias("value"),
    )


def _tree_paths(nodes: list[dict]) -> Iterator[tuple]:
    by = {n["node"]: n for n in nodes}
    todo = [(0, {})]
    while todo:
        at, way = todo.pop()
        n = by[at]
        if n["feature"] < 0:
            kept = sorted(way.items())
            yield n["tree"], at, [f for f, _ in kept], *([w[k] for _, w in kept] for k in range(3)), n["value"]
            continue
        low, high, share = way.get(n["feature"], (-np.inf, np.inf, 1.0))
        for child, bounds in ((n["left"], (low, min(high, n["threshold"]))), (n["right"], (max(low, n["threshold"]), high))):
            todo.append((child, way | {n["feature"]: (*bounds, share * by[child]["cover"] / n["cover"])}))


def paths(nodes: DataFrame) -> DataFrame:
    """PATHS of NODES: a tree is a group, and no larger than a tree."""

    def run(table: pa.Table) -> pa.Table:
        found = list(_tree_paths(table.to_pylist()))
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 4]
        names = [c.split()[0] for c in PATHS.split(", ")]
        return pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=names)

    return nodes.groupBy("tree").applyInArrow(run, PATHS)


def subset_weights(follow: np.ndarray, share: np.ndarray) -> np.ndarray:
    """follow: n x P x d (0 or 1), share: P x d. n x P x d: (follow - share) times the weighted sum over subsets of the other features, which follow where they are in the subset and count by their share where they aren't."""
    n, p, d = follow.shape
    weight = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
    out = np.empty((n, p, d))
    for i in range(d):
        sizes = np.zeros((n, p, d))  # by how many of the others are in the subset
        sizes[..., 0] = 1
        for j in range(d):
            if j != i:
                more = sizes[..., :-1] * follow[..., j, None]
                sizes *= share[:, j, None]
                sizes[..., 1:] += more
        out[..., i] = (follow[..., i] - share[:, i]) * (sizes @ weight)
    return out


class _Paths:
    """Paths of like length, laid out as arrays."""

    def __init__(self, rows: list) -> None:
        self.features, self.low, self.high, self.share, self.value = (np.array([r[c] for r in rows]) for c in ("features", "low", "high", "share", "value"))
        self.d = self.features.shape[1] if self.features.size else 0

    def follow(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.features]
        return ((v > self.low) & (v <= self.high)).astype(float)


def laid_out(rows: list) -> list[_Paths]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["features"]), []).append(r)
    return [_Paths(own) for d, own in sorted(by.items()) if d]


def attributions(groups: list[_Paths], x: np.ndarray, used: np.ndarray, n_classes: int) -> np.ndarray:
    """n x used features x classes."""
    out = np.zeros((len(x), len(used), n_classes))
    for g in groups:
        step = max(1, BLOCK // max(len(x) * g.d * g.d, 1))
        for at in range(0, len(g.features), step):
            own = _Paths.__new__(_Paths)
            own.features, own.low, own.high, own.share, own.value = (a[at : at + step] for a in (g.features, g.low, g.high, g.share, g.value))
            phi = subset_weights(own.follow(x), own.share)
            where = np.searchsorted(used, own.features)
            for u in np.unique(where):
                path, place = np.nonzero(where == u)
                out[:, u] += phi[:, path, place] @ own.value[path]
    return out


def _chunks(found: DataFrame, most: int) -> list[list[int]]:
    """Trees in chunks whose paths take about `most` bytes (a number per tree comes to the driver)."""
    sizes = found.groupBy("tree").agg(F.sum(28 * F.size("features") + 8 * F.size("value") + 200).alias("n")).orderBy("tree").collect()
    out, held = [[]], 0
    for r in sizes:
        if out[-1] and held + r["n"] > most:
            out.append([])
            held = 0
        out[-1].append(r["tree"])
        held += r["n"]
    return out


def tree_shap(rows: DataFrame, found: DataFrame, n_classes: int, keep: tuple[str, ...] = ("sample_id",), target: str | None = None, most: int = MAX_PATHS) -> DataFrame:
    """rows: keep and x (array<double>); found: paths(). keep, feature, phi: an array over classes, or a number, of the class that the column target names. Features on no path have no rows."""
    spark, columns = rows.sparkSession, [*keep, *([target] if target else [])]
    kinds = dict(rows.dtypes)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", feature int, phi " + ("double" if target else "array<double>")
    parts = []
    for trees in _chunks(found, most):
        sent = spark.sparkContext.broadcast([r.asDict() for r in found.filter(F.col("tree").isin(trees)).collect()])  # at most `most` bytes, or one tree

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            groups = laid_out(sent.value)
            used = np.unique(np.concatenate([g.features.ravel() for g in groups])) if groups else np.zeros(0, int)
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    own = b.slice(at, 64)
                    n, x = own.num_rows, own.column(len(columns)).flatten().to_numpy().reshape(own.num_rows, -1)
                    phi = attributions(groups, x, used, n_classes)
                    again = pa.array(np.repeat(np.arange(n), len(used)))
                    if target:
                        flat = pa.array(np.take_along_axis(phi, own.column(len(keep)).to_numpy()[:, None, None], 2).ravel())
                    else:
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(n * len(used) + 1) * n_classes, pa.int32()), pa.array(phi.ravel()))
                    yield pa.RecordBatch.from_arrays([*[own.column(k).take(again) for k in range(len(keep))], pa.array(np.tile(used, n), pa.int32()), flat], [*keep, "feature", "phi"])

        parts.append(rows.select(*columns, "x").mapInArrow(run, ddl))
    every = reduce(DataFrame.unionAll, parts)
    if len(parts) == 1:
        return every
    total = F.sum("phi") if target else F.array(*[F.sum(F.get("phi", F.lit(c))) for c in range(n_classes)])
    return every.groupBy(*keep, "feature").agg(total.alias("phi"))


def path_scores(rows: DataFrame, found: DataFrame, n_classes: int, keep: tuple[str, ...] = ("sample_id",), most: int = MAX_PATHS) -> DataFrame:
    """keep and score (an array over classes): the values of the leaves that a row comes to, added up; paths are sent in chunks as for tree_shap()."""
    spark, kinds, parts = rows.sparkSession, dict(rows.dtypes), []
    for chosen in _chunks(found, most):
        sent = spark.sparkContext.broadcast([r.asDict() for r in found.filter(F.col("tree").isin(chosen)).collect()])  # at most `most` bytes, or one tree

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            groups, always = laid_out(sent.value), sum((np.array(r["value"]) for r in sent.value if not r["features"]), np.zeros(n_classes))
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    own = b.slice(at, 256)
                    x, score = own.column(len(keep)).flatten().to_numpy().reshape(own.num_rows, -1), np.tile(always, (own.num_rows, 1))
                    for g in groups:
                        score += g.follow(x).all(2) @ g.value
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n_classes, pa.int32()), pa.array(score.ravel()))
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], flat], [*keep, "score"])

        parts.append(rows.select(*keep, "x").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score array<double>"))
    every = reduce(DataFrame.unionAll, parts)
    return every if len(parts) == 1 else every.groupBy(*keep).agg(F.array(*[F.sum(F.get("score", F.lit(c))) for c in range(n_classes)]).alias("score"))


def base_values(found: DataFrame, n_classes: int) -> list[float]:
    """Each class's mean score over the covers (a number per class)."""
    p = F.aggregate("share", F.lit(1.0), lambda a, x: a * x)
    row = found.agg(*[F.sum(p * F.get("value", F.lit(c))) for c in range(n_classes)]).first()
    return [float(x or 0.0) for x in row]


def check_additive(phi: DataFrame, base: list[float], scores: DataFrame, key: str = "sample_id", most: float = 1e-6) -> None:
    """phi: key, feature, phi (array over classes); scores: key, score (array). Base and attributions must add up to the score, for every class."""
    n = len(base)
    sums = phi.groupBy(key).agg(F.array(*[F.sum(F.get("phi", F.lit(c))) for c in range(n)]).alias("s"))
    off = F.greatest(*[F.abs(F.coalesce(F.get("s", F.lit(c)), F.lit(0.0)) + base[c] - F.get("score", F.lit(c))) for c in range(n)], F.lit(0.0))
    none_of(scores.join(sums, key, "left").withColumn("off", off).filter(F.col("off").isNull() | (F.col("off") > most)).select(key, "off"), "attributions don't add up to the score")
