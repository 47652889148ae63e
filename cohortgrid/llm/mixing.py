"""Mixing to target weights with soft membership, in DataFrame functions only.

1. A naive Bayes classifier learns the domains from a table of labels: documents
   labelled toxic, of high and of low quality. Its features are hashed words and
   four measures of layout (words, symbols, different words and capitals, each in
   LEVELS levels). Only words that tell count: those whose documents in some domain
   are TELLING standard deviations from what its size lets expect. Their evidence
   is tempered, as words are not independent.
2. Documents are dealt into PARTS by a hash of their id, and each part is scored
   with weights that were fitted without its labels, as scores of rows that a
   classifier was fitted on say too much. The log odds, in levels, make a grid;
   a document's posteriors, to STEP, are the shares of the domains among the
   labelled documents of its cell.
3. Nonnegative document rates r meet the targets in least squares: the expected
   tokens of each domain, sum over documents of r * tokens * posterior, against
   the targets, with a small pull towards r = 1. The steps are Newton's on the dual
   problem, projected on r >= 0; plain projected gradients are too slow where
   posteriors hardly differ.

Rates depend on a document only through its posteriors, so documents with equal
posteriors are summed up first: at most (1/STEP + 1)(1/STEP + 2)/2 rows whatever
the input. At the optimum r = max(0, 1 - sum of p * u / RIDGE), where u holds each
domain's residual relative to its tokens: three numbers, found to TOLERANCE, each
step being one aggregate. If they are not found, that is an error.

Scale: words are exploded and summed within their task, so one narrow row per
document is shuffled. Broadcast are the weights, PARTS times WIDTH rows at most, and
at most MAX_LABELLED labelled ids (the sample the classifier is fitted on, drawn
by hash). Weights are integers, so sums don't depend on the order of rows.

Cases: null or empty text has 0 tokens, and its layout's posteriors; labels that
are null or repeat are dropped or merged (toxic first, then low); without labels
all posteriors are equal; repeated rows each get their row, and of rows with the
same id and text all get the same copies; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, UPPER, ascii_lower, keyed, written

DOMAINS = ("high", "low", "toxic")
#: Shares of the mixture. The domain with the largest share is the anchor: its tokens are to be met once, the others follow from that.
TARGETS = {"high": 0.94, "low": 0.05, "toxic": 0.01}

#: Labelled documents that the classifier is fitted on at most; buckets of hashed words; standard deviations by which a domain's count must differ from the expected one, and the log of the factor by which; weight of the corpus in a bucket's shrinkage, in documents; telling words from which the evidence is tempered.
MAX_LABELLED, BUCKETS, TELLING, FACTOR, SHRINK, TEMPER = 20_000, 65_536, 4.0, 1.1, 1.0, 4
#: Parts of the documents, each of which is scored without its own labels; levels of a measure of layout; unit of the integer weights.
PARTS, LEVELS, UNIT = 4, 16, 1 << 16
#: The bucket that every document has, with the log of the priors; buckets of all kinds.
PRIOR = BUCKETS + 4 * LEVELS
WIDTH = PRIOR + 1
STEP = 0.001
#: Log odds of a level, and levels to either side.
NATS, MOST = 1.0, 12
#: Pull towards rate 1, the largest gradient (share of a domain's tokens) at the optimum, and evaluations after which the fit has failed.
RIDGE, TOLERANCE, TRIES = 0.001, 1e-8, 200

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def part() -> Column:
    return F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(PARTS))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """docs: the columns to keep and _t. A row per different word or level of layout of a document: the columns, n_tokens, bucket (words below BUCKETS)."""
    text = F.coalesce("_t", F.lit(""))
    split = docs.select(*keep, F.array_remove(F.split(ascii_lower(text), GAP), "").alias("_all"), F.length(text).alias("_n"), *[F.length(F.translate(text, c, "")).alias(k) for k, c in (("_s", SYMBOLS), ("_u", UPPER))])
    words = split.withColumn("_w", F.array_distinct("_all")).withColumn("n_tokens", F.size("_all").cast("long"))
    some = F.greatest("n_tokens", F.lit(1))
    level = [F.log2(F.col("n_tokens") + 1), 8 * (F.col("_n") - F.col("_s")) / some, LEVELS * F.size("_w") / some, LEVELS * (F.col("_n") - F.col("_u")) / F.greatest("_n", F.lit(1))]
    layout = F.array(*[(BUCKETS + LEVELS * k + F.least(F.floor(x), F.lit(LEVELS - 1))).cast("string") for k, x in enumerate(level)], F.lit(str(PRIOR)))
    # A word can't begin with a blank.
    each = words.select(*keep, "n_tokens", F.explode(F.concat("_w", F.transform(layout, lambda x: F.concat(F.lit(" "), x)))).alias("_w"))
    return each.select(*keep, "n_tokens", F.when(F.col("_w").startswith(" "), F.col("_w").cast("long")).otherwise(F.pmod(F.xxhash64("_w"), F.lit(BUCKETS))).alias("bucket"))


def weight_table(texts: DataFrame, labels: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """texts: _id, _t. key (bucket, and WIDTH more for each part before the one that is left out) with a weight per domain: log of the domain's shrunk document count over the expected one; and the labelled ids with their domain."""
    domain = F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 0, F.lit("low")).when(F.col("quality") == 1, F.lit("high"))
    known = labels.select(F.col(id_col).alias("_id"), domain.alias("domain")).dropna().groupBy("_id").agg(F.max("domain").alias("domain"))
    known = written(known.orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED), "labelled")
    labelled = texts.select("_id", "_t", part().alias("part")).join(F.broadcast(known), "_id")  # before there is a row per word
    each = [F.count(F.when((F.col("domain") == d) & (F.col("part") == v), 1)).alias(f"{d}{v}") for d in DOMAINS for v in range(PARTS)]
    counts = written(features(labelled, "domain", "part").groupBy("bucket").agg(*each), "word-counts")
    # Documents (each has the prior's bucket) and their different words: what a bucket's count is held against.
    sums = [F.sum(F.when(cond, F.col(f"{d}{v}"))).alias(f"{k}_{d}{v}") for k, cond in (("docs", F.col("bucket") == PRIOR), ("words", F.col("bucket") < BUCKETS)) for d in DOMAINS for v in range(PARTS)]
    here = counts.agg(*sums).first()
    tables = []
    for out in range(PARTS):
        others = [v for v in range(PARTS) if v != out]
        have = {d: reduce(Column.__add__, [F.col(f"{d}{v}") for v in others]) for d in DOMAINS}
        size = {k: {d: sum(here[f"{k}_{d}{v}"] or 0 for v in others) for d in DOMAINS} for k in ("docs", "words")}
        total = {k: max(sum(x.values()), 1) for k, x in size.items()}
        share = {d: F.when(F.col("bucket") < BUCKETS, F.lit(size["words"][d] / total["words"])).otherwise(F.lit(size["docs"][d] / total["docs"])) for d in DOMAINS}
        prior = {d: float(np.log((size["docs"][d] + 1) / (sum(size["docs"].values()) + len(DOMAINS)))) for d in DOMAINS}
        every = reduce(Column.__add__, have.values())
        weight = {d: F.when(F.col("bucket") == PRIOR, F.lit(prior[d])).otherwise(F.log((have[d] + SHRINK) / (every * share[d] + SHRINK))) for d in DOMAINS}
        # Most words differ by chance only, or by little, and would add up to noise.
        tells = reduce(Column.__or__, [(F.abs(have[d] - every * share[d]) > TELLING * F.sqrt(every * share[d] + 1)) & (F.abs(weight[d]) > FACTOR) for d in DOMAINS]) | (F.col("bucket") >= BUCKETS)
        tables.append(counts.filter(tells).select((F.col("bucket") + WIDTH * out).alias("key"), *[F.round(weight[d] * UNIT).cast("long").alias(d) for d in DOMAINS]))
    return reduce(DataFrame.unionAll, tables), known


def scores(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: _row, _id, _draw (a hash of id and text), n_tokens, domain (of labelled rows), low and toxic: levels of the log odds against high."""
    texts = keyed(docs, _id=F.col(id_col), _t=F.col(text_col))
    weights, known = weight_table(texts, labels, id_col)
    rows = texts.withColumn("_draw", F.xxhash64("_id", "_t")).withColumn("part", part()).join(F.broadcast(known), "_id", "left")
    met = features(rows, "_row", "_id", "_draw", "domain", "part").withColumn("key", F.col("bucket") + WIDTH * F.col("part")).join(F.broadcast(weights), "key", "left")
    word = F.col("bucket") < BUCKETS
    parts = [F.coalesce(F.sum(F.when(cond, F.col(d))), F.lit(0)).alias(f"{d}_{k}") for d in DOMAINS for k, cond in (("words", word), ("layout", ~word))]
    sums = met.groupBy("_row", "_id", "_draw", "n_tokens", "domain").agg(F.count(F.when(word, F.col("high"))).alias("n_telling"), *parts)
    # Words of a text are not independent: their evidence grows with the root of their number.
    score = {d: (F.col(f"{d}_words") / F.sqrt(1 + F.col("n_telling") / TEMPER) + F.col(f"{d}_layout")) / UNIT for d in DOMAINS}
    level = {d: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.round((score[d] - score["high"]) / NATS))).cast("int").alias(d) for d in DOMAINS[1:]}
    return written(sums.select("_row", "_id", "_draw", "n_tokens", "domain", *level.values()), "scores")


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _row, _id, _draw, n_tokens, p_high, p_low, p_toxic (to STEP)."""
    found = scores(docs, labels, id_col, text_col)
    counts = [F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{d}") for d in DOMAINS]
    cells = written(found.groupBy("low", "toxic").agg(F.count("domain").alias("n"), *counts), "score-cells")
    total = cells.agg(F.sum("n").alias("all"), *[F.sum(f"n_{d}").alias(d) for d in DOMAINS]).first()
    # Half a document of the labels' shares goes to each cell.
    share = {d: (total[d] + 1) / (total["all"] + len(DOMAINS)) if total["all"] is not None else 1 / len(DOMAINS) for d in DOMAINS}
    p = {d: F.round((F.col(f"n_{d}") + 0.5 * share[d]) / (F.col("n") + 0.5) / STEP) * STEP for d in DOMAINS[1:]}
    told = cells.select("low", "toxic", F.greatest(F.lit(0.0), 1 - reduce(Column.__add__, p.values())).alias("p_high"), *[x.alias(f"p_{d}") for d, x in p.items()])
    return found.join(F.broadcast(told), ["low", "toxic"]).select("_row", "_id", "_draw", "n_tokens", *[f"p_{d}" for d in DOMAINS])


def descent(found: DataFrame, targets: dict[str, float]) -> Column:
    """The rate of a document as an expression of its posteriors, at the optimum."""
    keys = [f"p_{d}" for d in DOMAINS]
    cells = written(found.groupBy(*keys).agg(F.sum("n_tokens").alias("n")), "cells")
    sums = lambda *cols: [float(x or 0) for x in cells.agg(*[F.sum(F.col("n") * c).alias(f"_{k}") for k, c in enumerate(cols)]).first()]
    have = sums(*map(F.col, keys))
    anchor = max(targets, key=targets.get)
    budget, every = have[DOMAINS.index(anchor)] / targets[anchor], max(sum(have), 1.0)
    own = np.maximum(have, 1.0) / every
    want = np.array([targets.get(d, 0.0) * budget for d in DOMAINS]) / every

    def rate(u: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), 1 - reduce(Column.__add__, [F.col(k) * float(x / RIDGE) for k, x in zip(keys, u, strict=True)]))

    def at(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual function's value, gradient and Hessian."""
        r, used = rate(u), (rate(u) > 0).cast("double")
        pairs = [F.col(x) * F.col(y) * used for x in keys for y in keys]
        got = np.array(sums(r * r, *[F.col(k) * r for k in keys], *pairs)) / every
        return (own @ u**2 + RIDGE * got[0]) / 2 + want @ u, own * u + want - got[1:4], np.diag(own) + got[4:].reshape(3, 3) / RIDGE

    u = np.zeros(len(DOMAINS))
    value, slope, bend = at(u)
    step, size = None, 1.0
    for _ in range(TRIES):
        if np.all(np.abs(slope) <= TOLERANCE * own):
            return rate(u)
        if step is None:
            step, size = -np.linalg.solve(bend, slope), 1.0
        new = at(u + size * step)
        if new[0] <= value + 1e-4 * size * (slope @ step) + 1e-14 * abs(value):
            u, (value, slope, bend), step = u + size * step, new, None
        else:
            size /= 2
    raise ValueError(f"ERROR: mixing rates did not converge: gradient {slope.tolist()}")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _row, id, n_tokens, p_high, p_low, p_toxic, rate, copies (rate rounded up or down by a hash of id and text, so that it is met on average)."""
    found = written(posteriors(docs, labels, id_col, text_col), "posteriors")
    rate = F.round(descent(found, targets or TARGETS), 6)
    draw = F.pmod("_draw", F.lit(1 << 20)) / (1 << 20)
    rated = found.withColumn("rate", rate)
    return rated.select("_row", F.col("_id").alias(id_col), "n_tokens", *[F.round(f"p_{d}", 3).alias(f"p_{d}") for d in DOMAINS], "rate", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"))
