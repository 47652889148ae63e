"""Quality rules with host-level verdicts.

Rules are counted per document. Failures are then summed per host (the column
named by host_col), each host's failure rate is shrunk towards the corpus by a
beta prior fitted to all hosts (method of moments), and the host's verdict is
joined back: a document stays if it passes its own rules and its host's shrunk
rate stays under HOST_LIMIT.

Scale: one pass over the text; what it makes (about 60 bytes a document) is
written to the shared folder, so the text is not read twice. Sums per host are
pre-aggregated, so a hot host costs one row a task. The table of verdicts, one row
a host, is written and measured: up to MAX_HOSTS bytes it is broadcast, so the
rows of a hot host stay where they are; a larger one is joined by shuffle, where
Spark may split a hot host.

Cases: null or empty text has no words and fails; a null host is a host of its
own; repeated rows and ids each get their row; no table or an empty one gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, written

MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: A host whose shrunk failure rate is above this loses its other documents too.
HOST_LIMIT = 0.6
#: What the prior may weigh, in documents.
MIN_PRIOR, MAX_PRIOR = 2.0, 1000.0
#: Bytes of verdicts (names and 64 a row) that are broadcast at most.
MAX_HOSTS = 16 << 20

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, where, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for b in batches:
        found = [measures(x.as_py() or "") for x in b.column(3)]
        cols = [pa.array([r[k] for r in found], pa.int64()) for k in range(5)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["_row", "_id", "_host", *names])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: _row, id, the five counts, base_failed, host, host_rate (shrunk), kept."""
    kind = dict(docs.dtypes)[id_col]
    found = keyed(docs, _id=F.col(id_col), _host=F.coalesce(F.col(host_col).cast("string"), F.lit("\0null")), _t=F.col(text_col)).mapInArrow(
        _measure, f"_row long, _id {kind}, _host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    rows = written(found.withColumn("base_failed", failed), "quality")
    verdicts = written(host_verdicts(rows), "hosts")
    size = verdicts.agg(F.sum(F.octet_length("_host") + 64)).first()[0] or 0
    verdicts = F.broadcast(verdicts) if size <= MAX_HOSTS else verdicts
    return rows.join(verdicts, "_host", "left").select(
        "_row", F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("_host") != "\0null", F.col("_host")).alias("host"), "host_rate",
        (~F.col("base_failed") & (F.col("host_rate") <= HOST_LIMIT)).alias("kept"),
    )


def host_verdicts(rows: DataFrame) -> DataFrame:
    """Per host its shrunk failure rate: (failures + a) / (documents + a + b), a and b from the mean and variance of the hosts' rates."""
    hosts = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("base_failed"), 1)).alias("f"))
    spread = hosts.agg((F.sum("f") / F.sum("n")).alias("m"), F.var_pop(F.col("f") / F.col("n")).alias("v"))
    weight = F.least(F.greatest(F.coalesce(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(MAX_PRIOR)), F.lit(MIN_PRIOR)), F.lit(MAX_PRIOR))
    # One row of two numbers goes to each host.
    prior = spread.select(F.lit(1).alias("one"), "m", weight.alias("k"))
    return hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior), "one").select("_host", F.round((F.col("f") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k")), 9).alias("host_rate"))
