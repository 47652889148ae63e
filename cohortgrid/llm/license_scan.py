"""License scans by diagonal voting, in DataFrame functions only.

Every document's rolling word k-gram hashes are joined to the positions at which
known notices have the same k-gram. A hit votes for the diagonal (word position
in the document minus position in the notice). Votes are summed per diagonal;
for long notices, diagonals up to MERGE words apart vote together (an inserted or
lost word shifts the rest). A diagonal with enough votes is a candidate span: it
begins there and is as long as the notice. It is verified: the notice's grams
that stand in the span, in the order of the text and each place once, are
compared with the notice's own sequence by edit distance, and the similarity (1
less edits per gram) must be MIN_SIMILAR. Repeats of a few grams vote again and
again but don't stand in the notice's order. Of verified spans of a notice that
begin up to APART words from each other the most similar stays (the first of
equals). Short notices must stand whole, and all places count. A gram meets a
notice's only if both its 64-bit and its 32-bit hash are the same.

Scale: the notices are a fixed parameter of a few hundred rows, so that side is
broadcast; documents are never grouped by anything but their own row key, so no
key can be hot. Only hits and one row per document are shuffled. A diagonal
carries at most the notice's grams.

Cases: null text counts as empty; a document without words or hits gets
n_base 0, null positions, empty labels and score 0; repeated rows and ids are
kept apart by a row key; columns other than id and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, ascii_lower, scan_key

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notices, label to texts in public use. Short ones must stand whole, long ones to MIN_COVER.
NOTICES = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache": ["you may not use this file except in compliance with the license you may obtain a copy of the license at", "licensed under the apache license version 2 0 the license"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["lesser general public license"],
    "agpl": ["affero general public license"],
    "bsd": ["bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl": ["mozilla public license", "this source code form is subject to the terms of the mozilla public license"],
    "epl": ["eclipse public license"],
    "isc": ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "cc-by": ["under cc by", "creative commons attribution"],
    "cc-by-nc": ["cc by nc"],
    "cc-by-sa": ["cc by sa"],
    "cc0": ["cc0 1 0"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
}

#: Words a gram (the shortest notice has two); from how many words a notice is long.
K, LONG = 2, 8
#: Share of a long notice's grams that must vote; similarity a span must have; how far diagonals that vote together may be; how near each other spans of a notice are one.
MIN_COVER, MIN_SIMILAR, MERGE, APART = 0.6, 0.6, 3, 24


def notice_grams() -> list[tuple]:
    """template, label, base, grams of the notice, grams that must vote, the notice's grams as letters (equal grams have one letter), position, the gram's words: a row per gram."""
    rows, texts = [], [(p, label, True) for p, label in BASE.items()]
    texts += [(t, label, False) for label, ts in NOTICES.items() for t in ts]
    for n, (text, label, base) in enumerate(texts):
        words = text.split()
        grams = [words[i : i + K] for i in range(len(words) - K + 1)]
        need = math.ceil(len(grams) * MIN_COVER) if len(words) >= LONG else len(grams)
        letters = "".join(chr(ord("a") + grams.index(g)) for g in grams)
        rows += [(n, label, base, len(grams), need, letters, i, g) for i, g in enumerate(grams)]
    return rows


def templates(spark) -> DataFrame:
    """notice_grams() with their hashes, and the row (template -1) that every document's own marker meets."""
    names = ("template", "label", "base", "grams", "need", "letters", "t_pos")
    rows = [(-1, None, False, 1, 1, "a", 0, []), *notice_grams()]
    hashes = lambda words: [(f(*map(F.lit, words)) if words else F.lit(0)).cast(t).alias(c) for f, t, c in ((F.xxhash64, "long", "h"), (F.hash, "int", "check"))]
    made = [F.struct(*[F.lit(v).alias(c) for c, v in zip(names, r, strict=False)], *hashes(r[7])) for r in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans (all verified spans)."""
    words = docs.select(
        scan_key().alias("_row"),
        F.col(id_col).alias("_id"),
        F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP), "").alias("_w"),
    )

    pairs = words.select("_row", "_id", F.posexplode_outer(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.size("_w")).alias("b"))).alias("at", "w"))
    # The last word has no follower; its row (or that of a document without words) is the document's marker, meets template -1 and carries the number of words.
    last = F.col("w.b").isNull()
    rolled = pairs.select(
        "_row", "_id",
        F.when(last, F.coalesce(F.col("at") + 1, F.lit(0))).otherwise(F.col("at")).alias("pos"),
        F.when(last, F.lit(0).cast("long")).otherwise(F.xxhash64("w.a", "w.b")).alias("h"),
        F.when(last, F.lit(0)).otherwise(F.hash("w.a", "w.b")).alias("check"),
    )
    hits = rolled.join(F.broadcast(templates(docs.sparkSession)), ["h", "check"])
    keys = ["_row", "_id", "template", "label", "base", "grams", "need", "letters"]
    diagonals = hits.repartition("_row").groupBy(*keys, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.count(F.lit(1)).alias("own"), F.collect_list("t_pos").alias("at"))
    long = F.col("need") < F.col("grams")
    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    near = along.rangeBetween(-MERGE, MERGE)
    merged = diagonals.withColumn("votes", F.when(long, F.sum("own").over(near)).otherwise(F.col("own"))).withColumn("around", F.collect_list(F.struct("diagonal", "at")).over(near))
    grams = F.flatten(F.transform("around", lambda d: F.transform(d["at"], lambda t: F.struct((d["diagonal"] + t).alias("pos"), F.substring("letters", t + 1, F.lit(1)).alias("letter")))))
    inside = F.filter(grams, lambda g: (g["pos"] >= F.col("diagonal")) & (g["pos"] < F.col("diagonal") + F.col("grams")))
    seen = F.array_join(F.transform(F.array_sort(F.array_distinct(inside)), lambda g: g["letter"]), "")
    # A short notice whose own diagonal has all its grams stands there word for word.
    similar = F.when(long, 1 - F.levenshtein(seen, "letters") / F.col("grams")).otherwise(F.lit(1.0))
    verified = merged.filter(F.col("votes") >= F.col("need")).withColumn("similar", similar).filter(F.col("similar") >= MIN_SIMILAR)
    rank = F.struct("similar", (-F.col("diagonal")).alias("d"))
    best = F.max(rank).over(along.rangeBetween(-APART, APART))
    spans = verified.withColumn("best", best["d"]).filter(~long | (F.col("best") == -F.col("diagonal"))).withColumn("start", F.col("diagonal").cast("long"))
    real, base = F.col("label").isNotNull(), F.col("base")
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return spans.groupBy("_row", "_id").agg(
        F.max(F.when(~real, F.col("start"))).alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(real).alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("similar"))), F.lit(0.0)).alias("score"),
        F.count(F.when(real, 1)).alias("n_spans"),
    ).drop("_row").withColumnRenamed("_id", id_col)
