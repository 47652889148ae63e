"""Resumable nested cross-validation of fitted models: a store of predictions, one folder per fit.

A run is a folder: manifest.json (configuration and digest of the folds), one folder of
predictions per (outer fold, inner fold or test, setting), selected.json, and a log of
fits. Predictions are written under another name and renamed, so what exists is whole; a
stopped run goes on with what is missing and a changed configuration or fold table is
refused. The inner stage never reads cells of the outer fold that it leaves out; the outer
stage runs only behind a choice for every outer fold, and only if it is asked for by name.

Scale: the cells of at_once outer folds are read once per feature setting, for the missing
fits of their inner folds together: features are fitted by split as one more key
(features.by_split), boosting and logistic models take their steps for all splits at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from ..sources.tables import digest
from . import boosting, softmax
from .contracts import fail, none_of, unique_key
from .features import by_split
from .metrics import SCORES_BETTER_LOW, fold_scores

#: What a configuration must list.
KEYS = ("run_name", "model", "seed", "select_by", "features", "model_params")
FEATURES = ("n_probes", "correct_material")


def settings_of(config: dict) -> list[dict]:
    """The grid: every feature setting with every model setting, in order, named s000 and so on."""
    if missing := [k for k in KEYS if k not in config]:
        fail(f"configuration: {missing[0]!r} is missing")
    if config["select_by"] not in ("accuracy", "macro_f1", "balanced_accuracy", "log_loss"):
        fail("configuration: select_by is none of the scores")
    if set(config["features"]) != set(FEATURES):
        fail(f"configuration: features must list exactly {FEATURES}")
    if config["model"] not in MODELS:
        fail(f"configuration: unknown model {config['model']!r} (known: {sorted(MODELS)})")
    each = lambda d: [dict(zip(sorted(d), v, strict=True)) for v in product(*(d[k] for k in sorted(d)))]
    return [{"setting": f"s{n:03d}", **f, "model_params": p} for n, (f, p) in enumerate(product(each(config["features"]), each(config["model_params"])))]


# Models: rows have s (split), sample_id, class (number), held, weight, x. They give s, sample_id, proba for held rows.
# every: the rows of all splits of a feature setting; kept: what its model settings share, made by the first.


def boosted(rows: DataFrame, params: dict, n_classes: int, seed: int, every: DataFrame, kept: dict) -> DataFrame:
    settings, training = boosting.Settings(seed=seed, **params), lambda r: r.filter("not held").withColumnsRenamed({"s": "k", "class": "y"})
    if settings.bins not in kept:
        kept[settings.bins] = boosting.bin_edges(training(every), settings.bins)
    model = boosting.fit(training(rows), n_classes, settings, kept[settings.bins])
    return boosting.predict(rows.filter("held").withColumnRenamed("s", "k"), model, "sample_id").select(F.col("k").alias("s"), "sample_id", "proba")


def logistic(rows: DataFrame, params: dict, n_classes: int, seed: int, every: DataFrame, kept: dict) -> DataFrame:
    x = rows.select(F.col("s").alias("k"), F.lit(0).alias("j"), "sample_id", F.col("class").cast("int").alias("y"), "x", "held").persist()
    ks = sorted(r["k"] for r in x.select("k").distinct().collect())
    fits = softmax.fit(x.filter("not held"), softmax.grid(ks, [-1], ("raw",), (float(params["c"]),)), n_classes, len(x.first()["x"]), tolerance=params.get("tolerance", 1e-4))
    out = softmax.applied(x.filter("held").drop("held"), fits, dict.fromkeys(ks, ("raw", float(params["c"]))), on=-1)
    return out.select(F.col("k").alias("s"), "sample_id", F.col("x").alias("proba"))


def forest(rows: DataFrame, params: dict, n_classes: int, seed: int, every: DataFrame, kept: dict) -> DataFrame:
    """Spark ML's forest, split by split; classes weigh alike."""
    v, out = rows.withColumn("features", array_to_vector("x")).withColumn("label", F.col("class").cast("double")).persist(), None
    for s in sorted(r["s"] for r in v.select("s").distinct().collect()):
        fitted = RandomForestClassifier(weightCol="weight", featureSubsetStrategy="sqrt", seed=seed, numTrees=params.get("trees", 100), maxDepth=params.get("depth", 8), minInstancesPerNode=params.get("min_rows", 1)).fit(v.filter((F.col("s") == s) & ~F.col("held")))
        part = fitted.transform(v.filter((F.col("s") == s) & F.col("held"))).select("s", "sample_id", vector_to_array("probability").alias("proba"))
        out = part if out is None else out.unionByName(part)
    return out


MODELS: dict[str, Callable[[DataFrame, dict, int, int, DataFrame, dict], DataFrame]] = {"boosting": boosted, "logistic": logistic, "forest": forest}


def weighted(rows: DataFrame) -> DataFrame:
    """weight: n / (K n_c) over a split's rows that aren't held out; a number per split and class is joined back."""
    per = rows.filter("not held").groupBy("s", "class").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("s")
    return rows.join(F.broadcast(per.select("s", "class", (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))), ["s", "class"], "left").fillna(1.0, ["weight"])


@dataclass
class Run:
    """cells: sample_id, class, material, probe, beta. folds: sample_id, class, material, outer_fold, inner (array by outer fold, -1 on its own)."""

    cells: DataFrame
    folds: DataFrame
    config: dict
    root: str
    n_inner: int = 3
    at_once: int = 1  # outer folds whose features are made in one pass: cells are held once per split of these
    classes: list = field(default_factory=list)
    loaded: list = field(default_factory=list)  # (outer fold, inner folds) whose cells were read

    def __post_init__(self) -> None:
        self.spark, self.dir = self.cells.sparkSession, f"{self.root}/{self.config['run_name']}"
        self.settings = settings_of(self.config)
        self.check()

    def check(self) -> None:
        self.n_outer, self.classes = self.folds.select(F.max(F.size("inner"))).first()[0], [r[0] for r in self.folds.select("class").distinct().orderBy("class").collect()]
        each = self.folds.select("sample_id", "class", "material", "outer_fold", F.to_json("inner").alias("inner"))
        store.check_manifest(self.spark, f"{self.dir}/manifest.json", {"config": self.config, "folds": digest(each, *each.columns), "n_samples": each.count()})

    def path(self, k: int, j: int | None, setting: str) -> str:
        return f"{self.dir}/pred/o{k}_{'test' if j is None else f'i{j}'}_{setting}"

    def done(self) -> set[str]:
        return {n for n in store.names(self.spark, f"{self.dir}/pred") if ".tmp" not in n}

    def missing(self, ks: list[int], settings: list[dict]) -> dict[int, list[tuple[int, dict]]]:
        """outer fold -> (inner fold, setting) of fits that aren't there."""
        have = self.done()
        gone = {k: [(j, s) for j in range(self.n_inner) for s in settings if self.path(k, j, s["setting"]).rsplit("/", 1)[1] not in have] for k in ks}
        return {k: v for k, v in gone.items() if v}

    def _fit(self, todo: dict[int, list[tuple[int | None, dict]]]) -> int:
        """Fits of outer folds (fold -> inner fold or None for its test, setting): feature setting by feature setting, all splits of a setting at once."""
        groups, n, width = {}, 0, self.n_inner + 1
        misplaced = reduce(lambda a, b: a | b, [(F.get("inner", F.lit(k)) == -1) != (F.col("outer_fold") == k) for k in todo])
        none_of(self.folds.filter(misplaced), "inner is -1 elsewhere than on a sample's own outer fold")
        for k, items in todo.items():
            for j, s in items:
                groups.setdefault(tuple(s[f] for f in FEATURES), []).append((k, -1 if j is None else j, s))
        for features, items in groups.items():
            options, splits = dict(zip(FEATURES, features, strict=True)), None
            if options["correct_material"]:
                at = self.folds.groupBy("material").agg(F.min("outer_fold").alias("first"), F.max("outer_fold").alias("last"))
                alone = (F.col("first") == F.col("last")) & F.col("first").isin(sorted({k for k, _, _ in items}))
                none_of(at.filter(alone | F.col("material").isNull()), "unknown material")
            for k in sorted({k for k, _, _ in items}):
                js = sorted({j for kk, j, _ in items if kk == k})
                self.loaded.append((k, js))
                own = self.folds.select("sample_id", F.explode(F.array(*map(F.lit, js))).alias("j"), F.get("inner", F.lit(k)).alias("inner_fold"), "outer_fold")
                own = own.filter((F.col("j") == -1) | (F.col("outer_fold") != k))  # of inner splits the training side only
                held = F.when(F.col("j") == -1, F.col("outer_fold") == k).otherwise(F.col("inner_fold") == F.col("j"))
                own = own.select((F.lit(k * width + 1) + F.col("j")).alias("s"), "sample_id", held.alias("held"))
                splits = own if splits is None else splits.unionAll(own)
            vectors, _ = by_split(self.cells, splits, options["n_probes"], correct_material=options["correct_material"])
            number = F.array_position(F.array(*map(F.lit, self.classes)), F.col("class")) - 1
            rows = weighted(vectors.withColumn("class", number.cast("int"))).persist()
            none_of(self._absent(rows), "the training samples lack a class")
            kept: dict = {}
            for name in sorted({s["setting"] for _, _, s in items}):
                setting = next(s for _, _, s in items if s["setting"] == name)
                own = {k * width + 1 + j: (k, None if j < 0 else j) for k, j, s in items if s["setting"] == name}
                proba = MODELS[self.config["model"]](rows.filter(F.col("s").isin(list(own))), setting["model_params"], len(self.classes), self.config["seed"], rows, kept)
                made = f"{self.dir}/pred/tmp-{uuid.uuid4().hex[:12]}.tmp"
                proba.select("s", "sample_id", "proba").repartition(len(own), "s").write.partitionBy("s").parquet(made)
                for s, (k, j) in own.items():  # each fit is committed by itself
                    store.commit(self.spark, f"{made}/s={s}", self.path(k, j, name))
                store.remove(self.spark, made)
                n += len(own)
            log = F.explode(F.array(*[F.struct(F.lit(k).alias("outer"), F.lit(j).alias("inner"), F.lit(s["setting"]).alias("setting")) for k, j, s in items])).alias("fit")
            self.spark.range(1, numPartitions=1).select(log).select("fit.*", F.current_timestamp().alias("finished")).write.mode("append").parquet(f"{self.dir}/fits")
            rows.unpersist()
        return n

    def _batches(self, todo: dict[int, list]) -> int:
        ks = sorted(todo)
        return sum(self._fit({k: todo[k] for k in ks[a : a + self.at_once]}) for a in range(0, len(ks), self.at_once))

    def _absent(self, rows: DataFrame) -> DataFrame:
        seen = rows.filter("not held").groupBy("s").agg(F.count_distinct("class").alias("n_classes"))
        return seen.filter(F.col("n_classes") < len(self.classes))

    def inner(self, ks: list[int] | None = None, settings: list[dict] | None = None) -> int:
        """Fits what is missing; the number of fits done now."""
        ks = list(range(self.n_outer)) if ks is None else ks
        return self._batches(self.missing(ks, self.settings if settings is None else settings))

    def load(self, fits: list[tuple[int, int | None, str]]) -> DataFrame:
        """k, j (-1: test), setting, sample_id, class, p of stored fits, once each holds exactly its fold's samples with valid probabilities. The checks are one pass each for all fits."""
        paths = [self.path(*fit) for fit in fits]
        read = self.spark.read.schema("sample_id " + dict(self.folds.dtypes)["sample_id"] + ", proba array<double>").parquet(*paths)
        of = F.create_map(*[x for p, (k, j, s) in zip(paths, fits, strict=True) for x in (F.lit(p.rsplit("/", 1)[1]), F.struct(F.lit(k).alias("k"), F.lit(-1 if j is None else j).alias("j"), F.lit(s).alias("setting")))])
        every = read.select(F.element_at(of, F.element_at(F.split("_metadata.file_path", "/"), -2)).alias("fit"), "sample_id", "proba").select("fit.*", "sample_id", "proba")
        keys = ["k", "j", "setting", "sample_id"]
        asked = self.spark.createDataFrame([(k, -1 if j is None else j, s) for k, j, s in fits], "k int, j int, setting string")
        dealt = self.folds.select("sample_id", F.posexplode("inner").alias("k", "j"))
        want = asked.join(dealt, ["k", "j"]).select(*keys)  # a sample's own outer fold has -1 there
        unique_key(every, *keys)
        both = every.select(*keys, F.lit(True).alias("there")).join(want.withColumn("wanted", F.lit(True)), keys, "full_outer")
        none_of(both.filter("there is null or wanted is null"), "a fit's samples aren't those of its fold")
        total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
        bad = (F.size("proba") != len(self.classes)) | total.isNull() | F.isnan(total) | (F.abs(total - 1) > 1e-5) | F.exists("proba", lambda x: x < 0)
        none_of(every.filter(bad).select(*keys), "not a distribution over the classes")
        return every.select(*keys, F.posexplode("proba").alias("n", "p")).select(*keys, F.get(F.array(*map(F.lit, self.classes)), F.col("n")).alias("class"), "p")

    def inner_scores(self, pairs: list[tuple[int, dict]]) -> DataFrame:
        """k, j, setting and scores of the stored inner fits of (outer fold, setting)."""
        every = self.load([(k, j, s["setting"]) for k, s in pairs for j in range(self.n_inner)])
        return fold_scores(every, self.folds.select("sample_id", F.col("class").alias("truth")), "k", "j", "setting")

    def select(self) -> list[dict]:
        """For each outer fold the setting of the best mean inner score, the first of equals; needs every inner fit."""
        gone = self.missing(list(range(self.n_outer)), self.settings)
        if gone:
            fail(f"{sum(map(len, gone.values()))} inner fits are missing; finish the inner stage first")
        by = self.config["select_by"]
        scores = self.inner_scores([(k, s) for k in range(self.n_outer) for s in self.settings])
        mean = scores.groupBy("k", "setting").agg(F.avg(by).alias("score")).collect()  # folds x settings
        sign, out = 1 if by in SCORES_BETTER_LOW else -1, []
        for k in range(self.n_outer):
            best = min((r for r in mean if r["k"] == k), key=lambda r: (round(sign * r["score"], 12), r["setting"]))
            out.append({"outer": k, "setting": best["setting"], "score": best["score"], "selected_by": by})
        path = f"{self.dir}/selected.json"
        store.remove(self.spark, path)
        store.write_text(self.spark, path, json.dumps(out))
        return out

    def outer(self, final_scoring: bool = False) -> int:
        """Fits each outer fold's chosen setting on its whole training side and scores its test samples: behind the choices, and only if final scoring is asked for."""
        path = f"{self.dir}/selected.json"
        if not store.exists(self.spark, path):
            fail("no choices yet; run select first")
        if not final_scoring:
            fail("the outer test folds are read only with final_scoring=True")
        chosen, by, have, todo = {r["outer"]: r["setting"] for r in json.loads(store.read_text(self.spark, path))}, {s["setting"]: s for s in self.settings}, self.done(), {}
        for k in range(self.n_outer):
            if chosen.get(k) not in by:
                fail(f"no valid setting chosen for outer fold {k}")
            if self.path(k, None, chosen[k]).rsplit("/", 1)[1] not in have:
                todo[k] = [(None, by[chosen[k]])]
        return self._batches(todo)

    def pooled(self) -> DataFrame:
        """k, sample_id, class, p of all outer test folds, each sample once."""
        chosen = {r["outer"]: r["setting"] for r in json.loads(store.read_text(self.spark, f"{self.dir}/selected.json"))}
        return self.load([(k, None, s) for k, s in sorted(chosen.items())]).drop("j", "setting")
