"""Scalar functions: text cleaning, arrays of scores, hashing. Column in, Column out; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Text


def clean_label(c) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def first_part(c, sep: str = ",") -> Column:
    return F.trim(F.split_part(col(c), F.lit(sep), F.lit(1)))


def unquote(c) -> Column:
    """Takes one pair of surrounding double quotes away."""
    return F.regexp_replace(col(c), '^"(.*)"$', "$1")


def key_of(c) -> Column:
    """What stands before the first colon; "unlabeled" without one."""
    return F.when(F.instr(col(c), ":") > 0, F.trim(F.substring_index(col(c), ":", 1))).otherwise(F.lit("unlabeled"))


def value_of(c) -> Column:
    """What stands behind the first colon, all of it; the cell itself without one."""
    at = F.instr(col(c), ":")
    return F.when(at > 0, F.trim(F.substring(col(c), at + 1, F.length(col(c))))).otherwise(col(c))


def syntactic_name(c) -> Column:
    """A name as R makes them: other characters become dots, an X leads where a letter (or a dot and no digit) doesn't."""
    dotted = F.regexp_replace(col(c), r"[^A-Za-z0-9._]", ".")
    return F.when(dotted.rlike(r"^([A-Za-z]|\.([^0-9]|$))"), dotted).otherwise(F.concat(F.lit("X"), dotted))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_|_$", "")


def distinct_parts(c, sep: str = ";") -> Column:
    """A delimited list as a sorted array of its different non-empty parts."""
    return F.array_sort(F.array_distinct(F.filter(F.split(col(c), sep), lambda x: x != "")))


def interval_text(value, low, high) -> Column:
    return F.format_string("%.3f (%.3f-%.3f)", col(value), col(low), col(high))


def text_bool(c) -> Column:
    """"True" and "False" as booleans; null for all else (a domain check finds those)."""
    return F.when(col(c) == "True", True).when(col(c) == "False", False)


def log_time(c) -> Column:
    """A time as logs have it, to the second."""
    return F.date_format(col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def sha1_prefix(c, n: int = 10) -> Column:
    return F.substring(F.sha1(col(c)), 1, n)


def must(c, value: Column, what: str) -> Column:
    """value, and an error where it is null though c isn't: for casts and mappings that have to succeed."""
    return F.when(F.assert_true(col(c).isNull() | value.isNotNull(), F.concat(F.lit(f"ERROR: {what}: "), col(c).cast("string"))).isNull(), value)


# Numbers


def clip(c, low: float, high: float) -> Column:
    """Null stays null (greatest and least alone would take the bound)."""
    return F.when(col(c).isNotNull(), F.greatest(F.least(col(c), F.lit(high)), F.lit(low)))


def ratio(a, b) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def bin_index(c, bins: int) -> Column:
    """Equal-width bin of a number in [0, 1]; 1 belongs to the last."""
    return F.least(F.floor(col(c) * bins), F.lit(bins - 1)).cast("long")


def uniform(seed: int | str, *cols) -> Column:
    """A number in [0, 1) that depends on seed and cols only: the first 32 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


# Arrays of scores


def argmax(p) -> Column:
    """Position (from 0) of the first largest score."""
    return F.array_position(col(p), F.array_max(col(p))) - 1


def normalised(p) -> Column:
    total = F.aggregate(col(p), F.lit(0.0), lambda a, x: a + x)
    return F.transform(col(p), lambda x: x / total)


def softmax(p) -> Column:
    top = F.array_max(col(p))
    return normalised(F.transform(col(p), lambda x: F.exp(x - top)))


def brier(p, truth) -> Column:
    """Sum of squares - 2 p(truth) + 1; truth is a position from 0."""
    return F.aggregate(col(p), F.lit(0.0), lambda a, x: a + x * x) - 2 * F.get(col(p), col(truth)) + 1
