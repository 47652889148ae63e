"""Fill-in-middle transformation, in Spark SQL functions only.

A text is cut into units (a run of A-Z and a-z, or any other single character),
two cuts drawn by a hash of the document's id split the units into prefix,
middle and suffix, and these are arranged behind sentinels:

    psm: <P> prefix <S> suffix <M> middle        spm: <S> suffix <P> prefix <M> middle

Some documents stay plain: empty texts, texts that hold a sentinel themselves, and
the share that the draw leaves out. So a sentinel in an arranged output is always
one of ours, and restore() finds the parts by splitting at them; an output that
isn't in this grammar stops the run.

Scale: one pass over the text and no shuffle; draws depend on the id alone, so the
result is the same whatever the partitions or retries. A row holds its text's units
as one array (about 40 bytes a unit while the row is worked on): the longest text
bounds a task's memory.

Cases: a null text counts as empty, a null id as the empty string; repeated ids draw
alike, repeated rows each get their row; other columns are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

UNITS = "[A-Za-z]+|[^A-Za-z]"
#: Per cent of documents that are arranged, and of these the per cent in spm order.
RATE, SPM = 90, 20

SENTINELS = "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE)))


def draw(digest: Column, k: int) -> Column:
    """The k-th group (from 0) of 8 hex digits, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm: int = SPM, epoch: int = 1) -> DataFrame:
    """Per row: id, text (null as empty), n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output. epoch: another one draws anew."""
    text, digest = F.coalesce(F.col(text_col), F.lit("")), F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    cut = docs.select(F.col(id_col), text.alias("text"), digest.alias("_h")).withColumn("_units", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)))
    cut = cut.withColumn("n", F.size("_units").cast("long"))
    plain = (F.col("n") == 0) | F.col("text").rlike(SENTINELS) | (F.pmod(draw(F.col("_h"), 2), F.lit(100)) >= rate)
    places = [F.pmod(draw(F.col("_h"), k), F.col("n") + 1) for k in range(2)]
    cut = cut.withColumns({
        "form": F.when(plain, "plain").when(F.pmod(draw(F.col("_h"), 3), F.lit(100)) < spm, "spm").otherwise("psm"),
        "_low": F.least(*places).cast("int"), "_high": F.greatest(*places).cast("int"),
    })
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start + 1, length), ""))
    low, high = F.col("_low"), F.col("_high")
    parts = cut.withColumns({"prefix": part(F.lit(0), low), "middle": part(low, high - low), "suffix": part(high, F.col("n").cast("int") - high)})
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )
    return parts.select(id_col, "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text, from output and form alone."""
    parts = F.split(output, SENTINELS, -1)
    starts = F.when(form == "psm", output.startswith(PREFIX)).otherwise(output.startswith(SUFFIX))
    bad = F.raise_error(F.concat(F.lit("ERROR: not an arranged text: "), F.substring(output, 1, 80))).cast("string")
    first, second = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    joined = F.when(form == "psm", F.concat(first, F.get(parts, F.lit(3)), second)).otherwise(F.concat(second, F.get(parts, F.lit(3)), first))
    return F.when(form == "plain", output).when((F.size(parts) != 4) | ~starts, bad).otherwise(joined)


def digests(arranged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the query reports of fill_in_middle(): lengths, and digests of the output and of the text restored from it."""
    back = arranged.withColumn("_back", restore(F.col("output"), F.col("form")))
    return back.select(
        id_col, "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("_back", 256).alias("restored_sha256"),
    )
