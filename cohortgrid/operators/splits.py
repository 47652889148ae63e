"""Splits and draws. Randomness is a hash of seed and id, so a row's draw never depends on other rows, partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform


def keyed(seed: int, *cols: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def stratified_folds(samples: DataFrame, n_outer: int = 5, n_inner: int = 3, seed: int = 42) -> DataFrame:
    """sample_id, class, outer_fold, inner (array by outer fold; -1 on its own). Each class is dealt out in the order of a hash."""
    dealt = lambda key, *by: F.row_number().over(Window.partitionBy(*by).orderBy(key, "sample_id")) - 1
    out = samples.select("sample_id", "class").withColumn("outer_fold", F.pmod(dealt(keyed(seed, "sample_id"), "class") + F.col("class"), F.lit(n_outer)))
    for k in range(n_outer):
        rank = dealt(keyed(seed + k + 1, "sample_id"), "class", F.col("outer_fold") == k)
        out = out.withColumn(f"_i{k}", F.when(F.col("outer_fold") == k, F.lit(-1)).otherwise(F.pmod(rank, F.lit(n_inner))))
    return out.select("sample_id", "class", "outer_fold", F.array(*[f"_i{k}" for k in range(n_outer)]).alias("inner"))


def inner_long(folds: DataFrame) -> DataFrame:
    return folds.select("sample_id", "class", "outer_fold", F.posexplode("inner").alias("outer", "inner_fold"))


def fold_balance(folds: DataFrame) -> DataFrame:
    """Per outer fold: samples, classes, smallest class; and the smallest class of any inner training set."""
    per = folds.groupBy("outer_fold", "class").agg(F.count(F.lit(1)).alias("n"))
    outer = per.groupBy("outer_fold").agg(F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_class"))
    counts = inner_long(folds).filter("inner_fold >= 0").groupBy("outer", "class", "inner_fold").agg(F.count(F.lit(1)).alias("n"))
    rest = counts.withColumn("train", F.sum("n").over(Window.partitionBy("outer", "class")) - F.col("n"))
    return outer.join(rest.groupBy(F.col("outer").alias("outer_fold")).agg(F.min("train").alias("min_inner_train")), "outer_fold")


def fold_share(folds: DataFrame, samples: DataFrame, flag: str) -> DataFrame:
    """Per outer fold the share of samples with a flag."""
    return folds.join(samples, "sample_id").groupBy("outer_fold").agg(F.avg(F.col(flag).cast("int")).alias("share"))


def observed(cells: DataFrame, levels: list[float], seed: int = 7) -> DataFrame:
    """A row per cell and coverage level at which it is seen: u < level, or level 1. Levels are nested, as u is one draw a cell."""
    u = uniform(seed, "sample_id", "probe")
    level = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: (x == 1.0) | (F.col("u") < x)))
    return cells.withColumn("u", u).select("*", level.alias("level"))


def observed_flags(cells: DataFrame, levels: list[float], seed: int = 7) -> DataFrame:
    """Every cell at every coverage level, with seen: not missing and drawn at that level (the same draws as observed())."""
    each = cells.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return each.withColumn("seen", F.col("beta").isNotNull() & drawn_at_level(F.col("probe"), seed))


def drawn_at_level(probe: Column, seed: int = 7) -> Column:
    """Whether the sample's cell of a probe is drawn at the row's level."""
    return (F.col("level") == 1.0) | (uniform(seed, "sample_id", probe) < F.col("level"))


def masked_flags(cells: DataFrame, epochs: int, min_fraction: float = 0.001, seed: int = 9) -> DataFrame:
    """Every cell in every epoch, with share (of the sample in that epoch, log-uniform in (min_fraction, 1]) and seen: not missing and drawn at that share."""
    each = masked_epochs(cells, epochs, min_fraction, seed)
    return each.withColumn("seen", F.col("beta").isNotNull() & drawn_in_epoch(F.col("probe"), seed))


def masked_epochs(rows: DataFrame, epochs: int, min_fraction: float = 0.001, seed: int = 9) -> DataFrame:
    """Every row in every epoch, with the share of its sample in that epoch."""
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return each.withColumn("share", F.exp(uniform(f"{seed}s", "epoch", "sample_id") * F.log(F.lit(min_fraction))))


def drawn_in_epoch(probe: Column, seed: int = 9) -> Column:
    """Whether the sample's cell of a probe is drawn at the row's share."""
    return uniform(seed, "epoch", "sample_id", probe) < F.col("share")


def shuffle_within(df: DataFrame, label: str, fold: str, seed: int = 1) -> DataFrame:
    """Labels change places within a fold: the row that is i-th by id takes the label of the row that is i-th by hash."""
    by_id, by_hash = (F.row_number().over(Window.partitionBy(fold).orderBy(*o)) for o in (("sample_id",), (keyed(seed, "sample_id"), "sample_id")))
    ranked = df.select("sample_id", fold, label).withColumn("i", by_id).withColumn("j", by_hash)
    return ranked.select("sample_id", fold, "i").join(ranked.select(fold, F.col("j").alias("i"), F.col(label).alias("shuffled")), [fold, "i"]).drop("i")


def random_subset(df: DataFrame, n: int, seed: int = 3) -> DataFrame:
    return df.orderBy(keyed(seed, "sample_id"), "sample_id").limit(n)


def group_folds(df: DataFrame, group: str, n_folds: int) -> DataFrame:
    """Whole groups, dealt out by size (largest first). One row per group."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("fold", F.pmod(F.row_number().over(Window.orderBy(F.desc("n"), group)) - 1, F.lit(n_folds)))


def halves(samples: DataFrame, n_splits: int, seed: int = 11) -> DataFrame:
    """sample_id, split, half (0 or 1, equal in size up to one)."""
    each = samples.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split"))
    order = Window.partitionBy("split").orderBy(keyed(seed, "split", "sample_id"), "sample_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("split"))
    return each.withColumn("half", (F.row_number().over(order) > F.floor(n / 2)).cast("int"))


def numbered(rows: DataFrame, *by: str, buckets: int = 256) -> DataFrame:
    """_i: 0 .. _n - 1 within by, in the order of a hash bucket of the id and the id. No task sees more than a bucket: the buckets' offsets come from their counts."""
    rows = rows.withColumn("_bucket", F.floor(uniform("row", "sample_id") * buckets).cast("int"))
    sizes = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    one = list(by) or [F.lit(1)]
    # At most buckets rows per by.
    offsets = sizes.withColumn("_from", F.sum("_size").over(Window.partitionBy(*one).orderBy("_bucket")) - F.col("_size")).withColumn("_n", F.sum("_size").over(Window.partitionBy(*one)))
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("sample_id")) - 1
    return rows.withColumn("_k", within).join(offsets.drop("_size"), [*by, "_bucket"]).withColumn("_i", (F.col("_from") + F.col("_k")).cast("long")).drop("_bucket", "_k", "_from")


def bootstrap_draws(scored: DataFrame, n_boot: int = 1000, seed: int = 0, group: str | None = None) -> DataFrame:
    """n_boot resamples with replacement: of rows numbered 0..n-1, draw i of resample b takes row floor(u(seed, b, i) n).

    The same draws serve every model and label level of a sample set.
    """
    by = [group] if group else []
    rows = numbered(scored, *by)
    draws = rows.select(*by, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    draws = draws.select(*by, "b", F.floor(uniform(seed, "b", "_i") * F.col("_n")).cast("long").alias("_i"))
    return draws.join(rows.drop("_n"), [*by, "_i"]).drop("_i")


def mask_shares(samples: DataFrame, low: float = 0.001, seed: int = 17, epoch: int = 0) -> DataFrame:
    """share: log-uniform in [low, 1], a draw per sample and epoch, as masked training uses it."""
    return samples.select("sample_id", F.pow(F.lit(low), 1 - uniform(seed, F.lit(epoch), "sample_id")).alias("share"))
