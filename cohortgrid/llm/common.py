"""Helpers that the training-data operators share: row keys, shared tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters between words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Python's translation table for the same folding as ascii_lower().
LOWER = str.maketrans(UPPER, UPPER.lower())
#: Bytes of file names that are broadcast at most.
MAX_PATHS = 32 << 20
#: Rows of an Arrow batch while a table is written.
BATCH = 1000


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; everything else, and null, stays."""
    return F.translate(col, UPPER, UPPER.lower())


def scan_key() -> Column:
    """A key for each row of one scan; another scan of the same table may number them otherwise, so nothing is joined by it."""
    return F.monotonically_increasing_id()


def stable(docs: DataFrame) -> DataFrame:
    """docs itself if it is a scan of Parquet files under plain filters and projections, so that rows have a place (file and row index); else a written copy."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().head()
    if node.nodeName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation" and node.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat":
        return docs
    return written(docs, "rows")


def placed(docs: DataFrame, name: str) -> DataFrame:
    """stable() docs with the column name more: the row's key, the same in every scan whatever the splits, as it is the file's number and the row's index in it. Ids in the data may repeat or be null; this can't."""
    # Without a host, Spark writes file:/ in one place and file:/// in the other.
    meta, files = docs.metadataColumn("_metadata"), sorted({re.sub(r"^([^:/]+):///", r"\1:/", f) for f in docs.inputFiles()})
    if len(files) < 2:
        return docs.withColumn(name, meta["row_index"])
    paths, number, path, file = "\n".join(files), f"{name}_number", f"{name}_path", f"{name}_file"
    numbers = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(paths), "\n")).alias(number, file))
    # The list of files grows with the input; a long one is joined without broadcast.
    numbers = F.broadcast(numbers) if len(paths) <= MAX_PATHS else numbers
    known = F.coalesce(F.col(number), F.raise_error(F.lit("ERROR: a row of a file that was not there when the scan was planned")).cast("int"))
    met = docs.withColumns({name: meta["row_index"], path: meta["file_path"]}).join(numbers, F.col(path) == F.col(file), "left")
    return met.withColumn(name, F.shiftleft(known.cast("long"), 36) + F.col(name)).drop(number, path, file)


def fresh(docs: DataFrame) -> str:
    """A column name that docs doesn't have, in any case."""
    name, taken = "_row", {c.lower() for c in docs.columns}
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def keyed(docs: DataFrame, **columns: Column) -> DataFrame:
    """_row (see placed()) and the columns, by their new names. Further scans must start from what this returns, or from the same stable() table."""
    docs = stable(docs)
    name = fresh(docs)
    return placed(docs, name).select(F.col(name).alias("_row"), *[c.alias(k) for k, c in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own, which only a local master can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("ERROR: spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cohortgrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Arrow batches are bounded by rows only; rows with whole texts are wide.
    spark.conf.set(key, str(min(int(before), BATCH) if int(before) > 0 else BATCH))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table that written() made and nothing reads any longer."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
