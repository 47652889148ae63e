"""Small files and commits on Spark's own file systems (whatever scheme the path has), so that nothing depends on the driver's disk."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.contracts import fail


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name under spark.checkpoint.dir, which driver and executors share; where that is unset, under one of our own, which only a local master can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            fail("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cohortgrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, sorted; nothing if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def commit(spark: SparkSession, made: str, path: str) -> None:
    """Renames what was made under another name: what exists under its own name is whole. The target must not exist. (Stores without an atomic rename copy instead; there a reader must look for _SUCCESS.)"""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fail(f"{path} exists already")
    fs.mkdirs(p.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(made), p):
        fail(f"{path} couldn't be committed")


def write_table(df: DataFrame, path: str) -> None:
    made = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
    df.write.parquet(made)
    commit(df.sparkSession, made, path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    made = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
    fs, p = _fs(spark, made)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    commit(spark, made, path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    came = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(came, "UTF-8")
    finally:
        came.close()


def check_manifest(spark: SparkSession, path: str, now: dict) -> None:
    """The first run writes what it was begun with; another run must have the same."""
    now = json.loads(json.dumps(now, sort_keys=True))
    if not exists(spark, path):
        write_text(spark, path, json.dumps(now, sort_keys=True, indent=1))
    elif json.loads(read_text(spark, path)) != now:
        fail(f"{path}: the run was begun with different settings or a different fold table")
