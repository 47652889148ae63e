"""Queries over the operators of this subpackage, with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import byte_bpe
from .chat_format import format_turns, read_back
from .common import table
from .conversation_repair import damage, repair
from .exact_dedup import exact_dedup
from .fill_in_middle import digests, fill_in_middle
from .license_scan import license_scan
from .mixing import mix
from .near_dedup import near_dedup
from .pii import find_pii
from .quality_rules import quality_rules
from .rule_ensemble import classify
from .substring_dedup import substring_dedup
from .warc import read_warc, write_warc

#: The vocabulary of op7.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: What op2 adds to the table: a conversation whose texts hold control strings.
CONTROL_CASE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(spark.createDataFrame(CONTROL_CASE, turns.schema))))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages")), with_payload=False).drop("payload")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("_row")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("_row")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("_row")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("_row", "all_spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("_row", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_row")


def op11_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
