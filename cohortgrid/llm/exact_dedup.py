"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive runs of bytes of their normalised text (A-Z
lower-cased, UTF-8): first by the first WIDTHS[0] bytes, each group again by the
next WIDTHS[1], and so on. A group of one leaves; a group whose texts have ended
is a group of equal texts. No digest takes part: groups are told apart by the
bytes themselves, and a group's name is the smallest row key in it.

Scale: a level moves only that level's bytes of documents that still share all
bytes before; the rows that go on to the next level are two integers. Where they
are at most one in SHARE of the texts last read, what is left of their texts is
written once, and further levels read that table instead of all texts. Counts
per (group, bytes) are pre-aggregated, and rows are joined back to groups of two
or more, both sides read from written tables, so Spark can split a hot group.
Widths grow fourfold, so levels are logarithmic in the longest shared prefix.

Cases: null counts as the empty text, which is a text like any other; repeated
rows are copies; ids may repeat or be null (a null id never wins over another);
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, keyed, written

#: Bytes a level takes; the last width holds for all further levels.
WIDTHS = (64, 256, 1024, 4096, 16384, 65536, 262144)
#: Texts are written anew for at most one in so many of the rows last written.
SHARE = 4


def exact_groups(docs: DataFrame) -> DataFrame:
    """docs: _row, _id, _t. Rows of groups of two or more: _row, keep_id, _keep (the row that stays), group_size."""
    # A-Z are single bytes in UTF-8, so a run of bytes can be lower-cased without the rest, as Latin-1.
    texts = docs.select("_row", "_id", F.lit(0).cast("long").alias("_group"), F.coalesce("_t", F.lit("")).cast("binary").alias("_rest"))
    # texts: of `held` rows, without their first `cut` bytes, with the groups that they were in then.
    alive, ended, level, start, cut, held = None, [], 0, 0, 0, docs.count()
    while True:
        width = WIDTHS[min(level, len(WIDTHS) - 1)]
        run = F.encode(ascii_lower(F.decode(F.substring("_rest", start - cut + 1, width), "ISO-8859-1")), "ISO-8859-1")
        rows = texts.filter(F.octet_length("_rest") >= start - cut).select("_row", "_id", "_group", run.alias("_bytes"))
        if cut < start:
            rows = written(rows.drop("_group").join(alive, "_row"), "radix-rows")
        groups = rows.groupBy("_group", "_bytes").agg(F.count(F.lit(1)).alias("group_size"), F.min("_row").alias("_next"), F.max("_id").alias("keep_id"), F.coalesce(F.max_by("_row", "_id"), F.min("_row")).alias("_keep")).filter("group_size > 1")
        groups = written(groups, "radix-groups")
        split = rows.join(groups, ["_group", "_bytes"]).select("_row", F.col("_next").alias("_group"), "keep_id", "_keep", "group_size", (F.octet_length("_bytes") < width).alias("_ended"))
        split = written(split, "radix-split")
        for old in (groups, *((rows,) if cut < start else ())):
            dropped(old)
        ended.append(split.filter("_ended").select("_row", "keep_id", "_keep", "group_size"))
        alive = split.filter("not _ended").select("_row", "_group")
        start, level, left = start + width, level + 1, alive.count()
        if left and left * SHARE <= held:
            fewer = written(texts.drop("_group").join(alive, "_row").select("_row", "_id", "_group", F.substr("_rest", F.lit(start - cut + 1)).alias("_rest")), "radix-texts")
            if cut:
                dropped(texts)
            texts, held, cut = fewer, left, start
        if not left:
            if cut:
                dropped(texts)
            return reduce(DataFrame.unionAll, ended)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _row, id, keep_id (largest id of its group), group_size, kept, text_sha256 (of the normalised text, for the reader).

    One row of each group is kept; of rows that share the largest id, any one.
    """
    rows = keyed(docs, _id=F.col(id_col), _t=F.col(text_col))
    found = exact_groups(rows)
    every = rows.select("_row", "_id", F.sha2(F.encode(ascii_lower(F.coalesce("_t", F.lit(""))), "UTF-8"), 256).alias("text_sha256"))
    return every.join(found, "_row", "left").select(
        "_row",
        F.col("_id").alias(id_col),
        F.coalesce("keep_id", "_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("_keep", "_row") == F.col("_row")).alias("kept"),
        "text_sha256",
    )
