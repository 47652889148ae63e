"""Sources and sinks: text tables without inference, header-oriented text, wide matrices, keyed and audited writes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import unquote
from ..operators.contracts import fail, required_columns
from . import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tsv(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """Tab-separated text (gz by its name) with a header: every column is text, "NA" and "" stay text."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "\u0001").csv(path)
    required_columns(raw, dict.fromkeys(required))
    return raw.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in raw.columns])


def write_tsv(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    """Numbers in the formats given, such as {"value": "%.5f"}."""
    shown = df.withColumns({c: F.format_string(f, F.col(c)) for c, f in (formats or {}).items()})
    shown.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def read_series_header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines "!Sample_key<TAB>"v1"<TAB>..." as rows key, line, position, cell. CRLF-safe; the table below is not read as cells."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("v"), F.monotonically_increasing_id().alias("line")).filter(F.col("v").startswith("!Sample_"))
    cells = lines.select("line", F.posexplode(F.split("v", "\t")).alias("position", "cell"), F.split("v", "\t")[0].alias("key"))
    return cells.filter("position > 0").select(F.expr("substring(key, 9)").alias("key"), "line", (F.col("position") - 1).alias("position"), unquote("cell").alias("cell"))


def unpivot_wide(wide: DataFrame, id_col: str, names: tuple[str, str] = ("sample_id", "beta")) -> DataFrame:
    """A column per sample becomes a row per cell; NaN becomes null."""
    columns = [c for c in wide.columns if c != id_col]
    long = wide.unpivot([id_col], columns, *names)
    return long.withColumn(names[1], F.when(~F.isnan(names[1]), F.col(names[1])))


def in_request_order(df: DataFrame, ids: list, key: str = "sample_id") -> DataFrame:
    """The rows asked for, in the caller's order; ids that repeat or are unknown fail."""
    if len(set(ids)) != len(ids):
        fail("an id is asked for twice")
    kind = dict(df.dtypes)[key]
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, {key} {kind}")
    if missing := wanted.join(df.select(key), key, "left_anti").first():
        fail(f"{key} {missing[key]!r} is unknown")
    return df.join(wanted, key).orderBy("pos")


def append_once(df: DataFrame, path: str) -> None:
    """A result that may be written only once."""
    df.write.mode("errorifexists").parquet(path)


def audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def digest(df: DataFrame, *columns: str) -> str:
    """SHA-256 over the sorted rows of some columns, from one digest a row."""
    rows = df.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]), 256).alias("h"))
    # Order-free: the sum of row digests, in four parts, with the count.
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return hashlib.sha256("|".join(map(str, rows.agg(F.count(F.lit(1)), *parts).first())).encode()).hexdigest()


def check_manifest(path: str, config: dict, folds: DataFrame) -> None:
    """Writes config and fold digest on the first run; another run must have the same. On whatever file system the path names."""
    store.check_manifest(folds.sparkSession, path, {"config": config, "folds": digest(folds, *sorted(folds.columns))})


def file_pairs(files: DataFrame) -> DataFrame:
    """files: path. Array files GSM..._{Grn,Red}.idat.gz per sample; complete is true with exactly one of each."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select(F.regexp_extract(name, r"^(GSM\d+)_.*_(Grn|Red)\.idat\.gz$", 1).alias("gsm"), F.regexp_extract(name, r"^(GSM\d+)_.*_(Grn|Red)\.idat\.gz$", 2).alias("channel")).filter("gsm <> ''")
    n = parts.groupBy("gsm").agg(F.count(F.when(F.col("channel") == "Grn", 1)).alias("n_grn"), F.count(F.when(F.col("channel") == "Red", 1)).alias("n_red"))
    return n.withColumn("complete", (F.col("n_grn") == 1) & (F.col("n_red") == 1))


def reconcile(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are only in one manifest or whose values differ."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("status", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))
