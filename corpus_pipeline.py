"""The corpus pipeline: stages over documents, each written and reread by run().

Stages take (spark, docs, sf_dir) and work on all rows their predecessor kept;
all but the last return the columns of documents. Rows are told apart by their
place in the table, so ids may repeat or be null.

Cases, for every stage: null text counts as empty (quality rejects it); repeated
rows are copies (exact keeps one; where they reach mixing each has its own
copies, alike); other columns pass through under their names, whatever those are;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgrid.llm.byte_bpe import byte_bpe
from cohortgrid.llm.common import fresh, new_path, placed, stable, table
from cohortgrid.llm.exact_dedup import exact_dedup
from cohortgrid.llm.mixing import mix
from cohortgrid.llm.near_dedup import near_dedup
from cohortgrid.llm.quality_rules import quality_rules

RANKS = "byte_bpe_multi_50k.tiktoken"


def only(docs: DataFrame, rows: DataFrame, copies: bool = False) -> DataFrame:
    """The documents, a stable() table, whose row key is in rows._row; rows.copies times, if asked for."""
    key = fresh(docs)
    if not copies:
        return placed(docs, key).join(rows.select(rows["_row"].alias(key)), key, "left_semi").drop(key)
    met = placed(docs, key).join(rows.select(rows["_row"].alias(key), rows["copies"].alias(f"{key}n")), key)
    return met.withColumn(f"{key}n", F.explode(F.sequence(F.lit(1), f"{key}n"))).drop(key, f"{key}n")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = stable(docs)
    return only(docs, quality_rules(docs).filter("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = stable(docs)
    return only(docs, exact_dedup(docs).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = stable(docs)
    return only(docs, near_dedup(docs).filter("kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as its rate gives it copies, so that what is written has the target weights."""
    docs = stable(docs)
    return only(docs, mix(docs, table(spark, sf_dir, "labels")).filter("copies > 0"), copies=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only here: the other stages need no vocabulary

    return byte_bpe(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("tokens", tokens)]

#: Order MinHash and mixing iterate, and byte-level BPE isn't SQL. Tests hold quality, exact and near to rows made by hand, each operator to a plain version, and run() to its stages in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
