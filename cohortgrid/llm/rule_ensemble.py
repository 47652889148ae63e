"""Quality classifier: a sparse ensemble of rules over statistics of the text.

A forest of shallow trees is grown on labelled rows; each path from a root to a node
is a rule, a conjunction of bounds on statistics. A lasso logistic regression over all
rules keeps those that tell something, and what it keeps is compiled into one column
expression: the intercept plus the weights of the rules that hold, through the logistic
function. So scoring is an ordinary projection, and the model is a short readable table.

Rows whose crc32 of the id's text is divisible by HOLD_OUT are never learned from;
neither labels nor ids, language or source enter a score.

Scale: one pass over the text makes STATISTICS (narrow rows, written once in the shared
folder); learning reads those of labelled rows, at most MAX_TRAIN of them, taken in the
order of a hash of the id, in one partition, so that the model is the same whatever the
cluster does; scoring reads the statistics again. Nothing but the model (its trees and
weights, bounded by TREES and DEPTH) comes to the driver.

Cases: a null text counts as empty and is scored as any other, from statistics that are
0; a null id hashes as the empty string and has no label; repeated rows each get their
row and count as often in learning, as do repeated labels; null labels are left out;
without labels of both kinds the score is the share of label 1, or 0.5 without any; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

HOLD_OUT, THRESHOLD = 5, 0.3
#: Labelled rows that are learned from at most.
MAX_TRAIN = 20_000
TREES, DEPTH, LASSO = 30, 3, 0.001
SEED = 7

#: White space as the quality rules have it.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, DIGITS, SYMBOLS, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", ".,;:"

#: feature -> (low, high): low < feature <= high.
Rule = dict[int, tuple[float, float]]


def statistics(text: Column) -> dict[str, Column]:
    """Counts and shares, over the columns _text, _words and _lines that with_statistics() lays out."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n_chars, n_words, n_lines = F.length(text), F.size("_words"), F.size("_lines")
    among = lambda letters: n_chars - F.length(F.translate(text, letters, ""))
    lower = F.transform("_words", lambda w: F.lower(w))
    return {
        "n_words": n_words.cast("double"),
        "word_length": share(F.length(F.array_join("_words", "")), n_words),
        "distinct_words": share(F.size(F.array_distinct(lower)), n_words),
        "distinct_lines": share(F.size(F.array_distinct("_lines")), n_lines),
        "echoes": share(F.size(F.filter(F.zip_with("_words", F.slice("_words", 2, F.greatest(n_words - 1, F.lit(1))), lambda a, b: a == b), lambda same: same)), n_words),
        "line_words": share(n_words, n_lines),
        "upper": share(among(UPPER), n_chars),
        "digits": share(among(DIGITS), n_chars),
        "symbols": share(among(SYMBOLS), n_words),
        "bars": share(among("|"), n_words),
        "exclamations": share(among("!"), n_words),
        "marks": share(among(MARKS), n_words),
        "single_letters": share(F.size(F.filter("_words", lambda w: F.length(w) == 1)), n_words),
    }


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, held_out and the statistics, a row per document."""
    remainder = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(HOLD_OUT))
    text = docs.select(F.col(id_col).alias("_id"), (remainder == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    laid = text.withColumns({"_words": F.filter(F.split("_text", SPACE), lambda w: w != ""), "_lines": F.filter(F.split("_text", "\n"), lambda x: x != "")})
    return laid.select("_id", "held_out", *[c.alias(k) for k, c in statistics(F.col("_text")).items()])


def paths(described: str) -> list[Rule]:
    """Rules of a forest from its description (toDebugString): one per node below a root, bounds on the same feature merged, equal rules once."""
    found, above = {}, []
    for line in described.splitlines():
        if "Tree " in line and "weight" in line:
            above = []
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        above = [x for x in above if x[0] < depth]
        above.append((depth, int(m[2]), m[3], float(m[4])))
        rule: Rule = {}
        for _, feature, sign, value in above:
            low, high = rule.get(feature, (-math.inf, math.inf))
            rule[feature] = (low, min(high, value)) if sign == "<=" else (max(low, value), high)
        found[str(sorted(rule.items()))] = rule
    return list(found.values())


def holds(rule: Rule, names: list[str]) -> Column:
    each = [c for k, (low, high) in sorted(rule.items()) for c in ([F.col(names[k]) > low] * (low > -math.inf) + [F.col(names[k]) <= high] * (high < math.inf))]
    out = each[0]
    for c in each[1:]:
        out = out & c
    return out


def shown(rule: Rule, names: list[str]) -> str:
    return " and ".join((f"{low:g} < " if low > -math.inf else "") + names[k] + (f" <= {high:g}" if high < math.inf else "") for k, (low, high) in sorted(rule.items()))


class RuleEnsemble:
    """fit() on statistics with a label (0 or 1), then score: a column over statistics."""

    def __init__(self, names: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> None:
        self.names, self.trees, self.depth, self.lasso, self.seed = names, trees, depth, lasso, seed
        self.intercept, self.rules = 0.0, []  # rules: (rule, weight)

    def fit(self, rows: DataFrame) -> RuleEnsemble:
        n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
        self.rules = []
        if not n or ones in (0, n):
            self.intercept = 0.0 if not n else math.inf if ones else -math.inf
            return self
        features = rows.select("label", *self.names, array_to_vector(F.array(*self.names)).alias("features"))
        forest = RandomForestClassifier(labelCol="label", numTrees=self.trees, maxDepth=self.depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=self.seed).fit(features)
        rules = paths(forest.toDebugString)
        if not rules:
            self.intercept = math.log(ones / (n - ones))
            return self
        met = features.select("label", array_to_vector(F.array(*[holds(r, self.names).cast("double") for r in rules])).alias("features"))
        lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=self.lasso, standardization=False, maxIter=100).fit(met)
        self.intercept, self.rules = float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
        return self

    def score(self) -> Column:
        if math.isinf(self.intercept):
            return F.lit(1.0 if self.intercept > 0 else 0.0)
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, self.names), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def table(self) -> list[tuple[float, str]]:
        """Weights and rules, heaviest first."""
        return sorted(((w, shown(r, self.names)) for r, w in self.rules), key=lambda x: -abs(x[0]))


def training_rows(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int = MAX_TRAIN) -> DataFrame:
    """Statistics and label of at most `most` labelled rows that aren't held out, by a hash of the id, in one partition."""
    names = [c for c in stats.columns if c not in ("_id", "held_out")]
    known = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("double").alias("label")).filter("label in (0, 1)")
    rows = stats.filter(~F.col("held_out")).join(known, F.col("_id") == F.col("_label_id")).select("_id", "label", *names)
    return written(rows.orderBy(F.xxhash64("_id"), "_id", "label", *names).limit(most), "training").coalesce(1)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAIN) -> tuple[DataFrame, RuleEnsemble]:
    """Per row: id, held_out, score, predicted; and the model."""
    stats = written(with_statistics(docs, id_col, text_col), "statistics")
    names = [c for c in stats.columns if c not in ("_id", "held_out")]
    model = RuleEnsemble(names).fit(training_rows(stats, labels, id_col, label_col, most))
    score = F.round(model.score(), 9)
    return stats.select(F.col("_id").alias(id_col), "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted")), model
