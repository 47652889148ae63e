"""Multiclass boosting with a softmax loss, by histograms of gradients.

rows: k (which problem the row belongs to, such as the outer fold that is left out), y
(class number), weight, x (array<double>, no missing values). Every round grows a tree
per class and problem, level by level, to depth levels. One pass over the rows makes the
histograms of gradient, curvature and count per (problem, class, node, feature, bin) of
a level, for all classes and problems at once; they are summed within tasks, then per
(problem, class, block of features) after a shuffle, where the best split of each node
is found. Only best splits reach the driver, a row per node and block.

Rows' scores are computed from the trees so far in every pass, so there is no state
between passes that a lost executor could take along; that costs depth look-ups a tree,
against a histogram entry for each feature. A task holds the histograms of as many
trees as fit in HISTOGRAM bytes; more trees take further passes.

Splits tie to the lower feature, then the lower bin. A node is a leaf where no split
gains, or where a side has fewer than min_rows rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passes
from .contracts import fail, none_of
from .trees import NODES

#: Bytes of histograms that a task holds, and features of a block after the shuffle.
HISTOGRAM, FEATURES = 256 << 20, 64
#: Gains closer than this (relative) are equal.
EQUAL = 1e-9


@dataclass
class Settings:
    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    bins: int = 63
    ridge: float = 1.0
    min_rows: int = 2
    #: Share of features that a tree may use, of rows that a round uses; drawn by seed.
    features: float = 1.0
    rows: float = 1.0
    seed: int = 0


@dataclass
class Boosted:
    """Trees are full: feature and bin of node n of tree (round, problem, class), children 2n + 1 and 2n + 2; an unsplit node sends all rows left."""

    ks: list[int]
    n_classes: int
    edges: dict[int, list[np.ndarray]]
    start: dict[int, np.ndarray]
    settings: Settings
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(0))
    split: np.ndarray = field(default_factory=lambda: np.zeros(0))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cover: np.ndarray = field(default_factory=lambda: np.zeros(0))


def bin_edges(rows: DataFrame, bins: int) -> dict[int, list[np.ndarray]]:
    """k -> for each feature its sorted distinct upper bin edges, at most bins - 1: quantiles of the rows of k. Bounded by problems x features x bins."""
    gone = rows.filter(F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    none_of(gone.select("k", F.posexplode("x").alias("feature", "v")).filter("v is null or isnan(v)").select("k", "feature"), "a missing value; impute first")

    def groups(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        k, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
        for kk in set(k.tolist()):
            yield kk, x[k == kk]

    own = rows.select(F.col("k").cast("int"), "x")
    ranks = lambda n: sorted({max(1, math.ceil(q / bins * n)) for q in range(1, bins)})
    seen, out = passes.ranges(own, groups), {}
    for k, found in sorted(passes.order_statistics(own, groups, ranks, seen).items()):
        out[k] = [np.unique(v[v < passes.valued(most)]) for v, most in zip(found, seen[k][2], strict=True)]
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """n x features: how many edges lie below the value, so that bin <= b means value <= edge b."""
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.uint8)


def _walk(bins: np.ndarray, feature: np.ndarray, at_most: np.ndarray, levels: int) -> np.ndarray:
    """n x trees: the node (from the root's 0 on) that rows are in after so many levels. feature, at_most: trees x nodes."""
    n, trees = len(bins), len(feature)
    node, row, tree = np.zeros((n, trees), np.int32), np.arange(n)[:, None], np.arange(trees)[None, :]
    for _ in range(levels):
        node = 2 * node + 1 + (bins[row, feature[tree, node]] > at_most[tree, node])
    return node


def raw_scores(bins: np.ndarray, model: Boosted, p: int) -> np.ndarray:
    """n x classes, of problem number p: the start and what each round's trees add."""
    depth, out = model.settings.depth, np.tile(model.start[model.ks[p]], (len(bins), 1))
    for r in range(len(model.feature)):
        leaf = _walk(bins, model.feature[r, p], model.bin[r, p], depth) - (2**depth - 1)
        out += model.value[r, p][np.arange(model.n_classes)[None, :], leaf]
    return out


def softmax(u: np.ndarray) -> np.ndarray:
    e = np.exp(u - u.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def row_draw(ids: np.ndarray, seed: int) -> np.ndarray:
    """Uniforms from ids: a mix of the bits, the same whatever the partition."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(times)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def best_split(h: np.ndarray, first: int, s: Settings, allowed: np.ndarray) -> tuple | None:
    """h: features x bins x (gradient, curvature, rows) of a node. (gain, feature, bin, then left and all sums) of its best split, or None."""
    total = h[0].sum(0)
    left = h[:, :-1].cumsum(1)
    right = total - left
    score = lambda a: a[..., 0] ** 2 / (a[..., 1] + s.ridge)
    gain = (score(left) + score(right) - score(total)) / 2
    gain[(left[..., 2] < s.min_rows) | (right[..., 2] < s.min_rows) | ~allowed[:, None]] = -np.inf
    most = gain.max(initial=-np.inf)
    if not most > 1e-12:
        return None
    f, b = np.argwhere(gain >= most * (1 - EQUAL))[0]
    return float(most), int(first + f), int(b), *map(float, left[f, b]), *map(float, total)


def fit(rows: DataFrame, n_classes: int, settings: Settings | None = None, edges: dict[int, list[np.ndarray]] | None = None) -> Boosted:
    """edges: bin_edges() of these problems, and maybe others, if several fits share them."""
    s = settings or Settings()
    if not 2 <= s.bins <= 255 or not 1 <= s.depth <= 8:
        fail("bins must be 2 to 255, depth 1 to 8")
    spark, edges = rows.sparkSession, bin_edges(rows, s.bins) if edges is None else edges
    shares = {(r["k"], r["y"]): r["w"] for r in rows.groupBy("k", "y").agg(F.sum("weight").alias("w")).collect()}
    edges = {k: edges[k] for k in sorted({k for k, _ in shares})}
    ks, n_features = list(edges), len(next(iter(edges.values())))
    for k in ks:
        if gone := [c for c in range(n_classes) if not shares.get((k, c), 0) > 0]:
            fail(f"no row of class {gone[0]} to fit {k} on")
    start = {k: np.log(np.array([shares[k, c] for c in range(n_classes)]) / sum(shares[k, c] for c in range(n_classes))) for k in ks}
    model, numbers = Boosted(ks, n_classes, edges, start, s), {k: p for p, k in enumerate(ks)}

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, x = b.column(0).to_numpy(), b.column(4).flatten().to_numpy().reshape(-1, n_features)
            out = np.zeros(x.shape, np.uint8)
            for kk in set(k.tolist()):
                out[k == kk] = binned(x[k == kk], edges[kk])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in out], pa.binary())], ["k", "sample_id", "y", "weight", "bins"])

    kept = rows.select("k", F.col("sample_id").cast("long"), F.col("y").cast("int"), F.col("weight").cast("double"), "x").mapInArrow(to_bins, "k int, sample_id long, y int, weight double, bins binary").persist()
    inner, leaves, trees = 2**s.depth - 1, 2**s.depth, len(ks) * n_classes
    for r in range(s.rounds):
        feature, at_most, split = np.zeros((len(ks), n_classes, inner), np.int32), np.full((len(ks), n_classes, inner), 255, np.int32), np.zeros((len(ks), n_classes, inner), bool)
        sums = np.zeros((len(ks), n_classes, inner + leaves, 3))
        allowed = np.random.default_rng([s.seed, r]).random((len(ks), n_classes, n_features)) < s.features if s.features < 1 else np.ones((len(ks), n_classes, n_features), bool)
        for level in range(s.depth):
            at_once = max(1, HISTOGRAM // (2**level * n_features * s.bins * 24))
            found = [x for a in range(0, trees, at_once) for x in _level(spark, kept, model, feature, at_most, split, r, level, range(a, min(a + at_once, trees)), allowed, n_features, numbers)]
            for (p, c, node), best in _choose(found).items():
                if level == 0:
                    sums[p, c, 0] = best[6:]
                if best[0] > 0:
                    feature[p, c, node], at_most[p, c, node], split[p, c, node] = best[1], best[2], True
                    sums[p, c, 2 * node + 1], sums[p, c, 2 * node + 2] = best[3:6], np.subtract(best[6:], best[3:6])
        for node in range(inner):  # rows of an unsplit node go left
            whole = ~split[:, :, node]
            sums[whole, 2 * node + 1] = sums[whole, node]
        value = -s.rate * sums[:, :, inner:, 0] / (sums[:, :, inner:, 1] + s.ridge)
        add = lambda old, new: new[None] if not len(old) else np.concatenate([old, new[None]])
        model.feature, model.bin, model.split, model.value, model.cover = add(model.feature, feature), add(model.bin, at_most), add(model.split, split), add(model.value, value), add(model.cover, sums[..., 2])
    kept.unpersist()
    return model


def _choose(found: list) -> dict[tuple[int, int, int], tuple]:
    """The best of the blocks' splits for each node: (gain, feature, bin, left sums, all sums); gain 0 where there is none."""
    out: dict[tuple[int, int, int], tuple] = {}
    for r in sorted(found, key=lambda r: (r["p"], r["c"], r["node"], r["feature"])):
        key, new = (r["p"], r["c"], r["node"]), (r["gain"], r["feature"], r["bin"], *r["sums"])
        if key not in out or new[0] > out[key][0] * (1 + EQUAL):
            out[key] = new
    return out


def _level(spark, kept, model, feature, at_most, split, r, level, trees, allowed, n_features, numbers) -> list:
    """Best splits (p, c, node, gain, feature, bin, sums) of the trees' nodes at a level, from one pass."""
    s, n_classes, first, nodes = model.settings, model.n_classes, 2**level - 1, 2**level
    blocks = -(-n_features // FEATURES)
    # The model so far and the round's trees: no part of it grows with the rows.
    sent = spark.sparkContext.broadcast((model, feature, at_most))

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features, limits = sent.value
        width = nodes * n_features * s.bins
        held: dict[int, np.ndarray] = {}
        for b in batches:
            k = b.column(0).to_numpy()
            ids, y, weight = (b.column(c).to_numpy() for c in (1, 2, 3))
            bins = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, n_features)
            for kk in set(k.tolist()):
                p, rows = numbers[kk], k == kk
                wanted = [t % n_classes for t in trees if t // n_classes == p]
                if s.rows < 1:
                    rows &= row_draw(ids, s.seed * 1_000_003 + r) < s.rows
                if not wanted or not rows.any():
                    continue
                x, w, prob = bins[rows], weight[rows], softmax(raw_scores(bins[rows], own, p))
                node = _walk(x, features[p], limits[p], level) - first
                flat = np.arange(n_features) * s.bins + x  # n x features
                for c in wanted:
                    g, h = w * (prob[:, c] - (y[rows] == c)), w * prob[:, c] * (1 - prob[:, c])
                    place = (node[:, c, None] * (n_features * s.bins) + flat).ravel()
                    stats = [np.bincount(place, np.repeat(v, n_features), width) for v in (g, h, np.ones(len(g)))]
                    t = p * n_classes + c
                    held[t] = held.get(t, 0) + np.stack(stats, 1)
        rows = [(t * blocks + f, h.reshape(nodes, n_features, s.bins, 3)[:, f * FEATURES : (f + 1) * FEATURES].ravel()) for t, h in held.items() for f in range(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.list_(pa.float64()))], ["key", "h"])

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for key, h in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                new = h.values.to_numpy()
                total[key] = total[key] + new if key in total else new
        out = []
        for key, h in total.items():
            t, f = divmod(key, blocks)
            p, c = divmod(t, n_classes)
            may = allowed[p, c, f * FEATURES : (f + 1) * FEATURES]
            for n, own in enumerate(h.reshape(nodes, -1, s.bins, 3)):
                node = first + n
                if level and not split[p, c, (node - 1) // 2]:
                    continue
                best = best_split(own, f * FEATURES, s, may) or (0.0, n_features, 0, 0.0, 0.0, 0.0, *map(float, own[0].sum(0)))
                out.append((p, c, node, *best[:3], list(best[3:])))
        kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["p", "c", "node", "gain", "feature", "bin", "sums"])

    parts = kept.mapInArrow(histograms, "key int, h array<double>").repartition("key")
    found = parts.mapInArrow(splits, "p int, c int, node int, gain double, feature int, bin int, sums array<double>").collect()
    sent.destroy()
    return found


def predict(rows: DataFrame, model: Boosted, *keep: str) -> DataFrame:
    """rows: k, x and keep. keep, k, raw and proba (arrays over classes), by the model of k."""
    sent, numbers, n_features = rows.sparkSession.sparkContext.broadcast(model), {k: p for p, k in enumerate(model.ks)}, len(next(iter(model.edges.values())))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            k, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, n_features)
            raw = np.zeros((len(k), own.n_classes))
            for kk in set(k.tolist()):
                raw[k == kk] = raw_scores(binned(x[k == kk], own.edges[kk]), own, numbers[kk])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * own.n_classes, pa.int32()), pa.array(v.ravel())) for v in (raw, softmax(raw))]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], b.column(0), *lists], [*keep, "k", "raw", "proba"])

    ddl = "".join(f"{c} {kinds[c]}, " for c in keep) + f"k {kinds['k']}, raw array<double>, proba array<double>"
    return rows.select("k", "x", *keep).mapInArrow(run, ddl)


def nodes(spark, model: Boosted, k: int) -> DataFrame:
    """The trees of problem k as NODES, the start as a tree of one leaf: their values add up to the raw scores."""
    p, out, inner = model.ks.index(k), [], 2**model.settings.depth - 1
    zero = [0.0] * model.n_classes
    for r in range(len(model.feature)):
        for c in range(model.n_classes):
            t, todo = r * model.n_classes + c, [0]
            while todo:
                n = todo.pop()
                cover = float(model.cover[r, p, c, n])
                if n < inner and model.split[r, p, c, n]:
                    f, b = int(model.feature[r, p, c, n]), int(model.bin[r, p, c, n])
                    out.append((t, n, f, float(model.edges[k][f][b]), 2 * n + 1, 2 * n + 2, cover, None))
                    todo += [2 * n + 1, 2 * n + 2]
                else:
                    leaf = n
                    while leaf < inner:
                        leaf = 2 * leaf + 1
                    out.append((t, n, -1, None, -1, -1, cover, [*zero[:c], float(model.value[r, p, c, leaf - inner]), *zero[c + 1 :]]))
    out.append((len(model.feature) * model.n_classes, 0, -1, None, -1, -1, 1.0, model.start[k].tolist()))
    return spark.createDataFrame(out, NODES)
