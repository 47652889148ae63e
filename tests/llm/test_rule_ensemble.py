"""The rule ensemble: statistics against plain ones, rules against the trees they come from, accuracy on held-out rows."""

import math
import re
import zlib

import pytest
from cohortgrid.llm import rule_ensemble as rules_
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, score double, held_out string, label int, _id int"


def plain_statistics(text):
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    among = lambda chars: sum(c in chars for c in text)
    return {
        "n_words": float(len(words)), "word_length": share(sum(map(len, words)), len(words)), "distinct_words": share(len({w.lower() for w in words}), len(words)),
        "distinct_lines": share(len(set(lines)), len(lines)), "line_words": share(len(words), len(lines)), "echoes": share(sum(a == b for a, b in zip(words, words[1:])), len(words)),  # noqa: B905
        "upper": share(among(rules_.UPPER), len(text)), "digits": share(among(rules_.DIGITS), len(text)), "symbols": share(among(rules_.SYMBOLS), len(words)), "bars": share(among("|"), len(words)),
        "exclamations": share(among("!"), len(words)), "marks": share(among(rules_.MARKS), len(words)), "single_letters": share(sum(len(w) == 1 for w in words), len(words)),
    }


def test_statistics_and_held_out_rows(spark):
    texts = [None, "", " \n\t", "!!!", "a", "The The the.\nThe The the.\n\nx | y", "é É 😀 42 $$", "AB cd\r\nab CD", " lead and trail ", "w " * 30_000, "x" * 100_000]
    rows = [(k, t, 0.1, "c", 1, 1) for k, t in enumerate(texts)] + [(None, "null id", None, None, None, None), (3, "again", None, None, None, None)]
    found = rules_.with_statistics(spark.createDataFrame(rows, DOC), "doc_id", "text").collect()
    assert len(found) == len(rows)
    for r, (doc_id, text, *_) in zip(found, rows, strict=True):  # the partitions keep the order of createDataFrame
        want = plain_statistics(text)
        assert r.held_out == (zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0)
        assert {k: pytest.approx(r[k]) for k in want} == want


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out, model = rules_.classify(docs, labels)
    return docs, labels, out, model


def test_held_out_accuracy(fitted):
    docs, labels, out, model = fitted
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.predicted for r in good) >= 0.98 * len(good) and sum(r.predicted for r in bad) <= 0.1 * len(bad)
    auc = sum((g.score > b.score) + (g.score == b.score) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert 0 < len(model.rules) < 60 and "distinct_words" in str(model.table())


def test_compiled_score_is_the_sum_of_its_rules(fitted):
    docs, _, out, model = fitted
    texts, n = {r.doc_id: r.text for r in docs.collect()}, 0
    for r in out.collect():
        s = list(plain_statistics(texts[r.doc_id]).values())
        by = dict(zip(plain_statistics(""), s, strict=True))
        total = model.intercept + sum(w for rule, w in model.rules if all(low < by[model.names[k]] <= high for k, (low, high) in rule.items()))
        n += abs(r.score - 1 / (1 + math.exp(-total))) > 1e-8
    assert n == 0


def test_held_out_labels_ids_and_other_columns_do_not_matter(spark, fitted):
    docs, labels, out, _ = fitted
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other, _ = rules_.classify(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "score": F.lit("clash")}), flipped)
    assert sorted(other.collect()) == sorted(out.collect())


def test_paths_are_the_leaves_and_nodes_of_the_trees(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    rows = rows.withColumn("label", ((F.col("a") > 3) & (F.col("b") <= 4)).cast("double"))
    forest = RandomForestClassifier(labelCol="label", numTrees=3, maxDepth=3, seed=1).fit(rows.select("label", array_to_vector(F.array("a", "b")).alias("features")))
    found = rules_.paths(forest.toDebugString)
    assert 4 <= len(found) <= sum(t.numNodes - 1 for t in forest.trees)
    assert any(set(r) == {0, 1} for r in found)
    for rule in found:
        assert all(low < high for low, high in rule.values())
        assert rows.filter(rules_.holds(rule, ["a", "b"])).count() > 0


def test_tables_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 0.0, "", 0, 0), (None, None, None, None, None, None)], DOC)
    for rows, want in (([], 0.5), ([(1, 1), (2, 1), (None, 1), (2, None)], 1.0), ([(1, 0)], 0.0)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        learned = zlib.crc32(b"1") % 5 != 0
        out = rules_.classify(docs, labels)[0].collect()
        assert [r.score for r in out] == [want if learned else 0.5] * 2
    assert rules_.classify(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))[0].count() == 0


def test_the_sample_is_bounded_and_the_same_for_any_partitions(spark, fitted):
    docs, labels, *_ = fitted
    stats = rules_.with_statistics(docs, "doc_id", "text")
    picks = [sorted(map(tuple, rules_.training_rows(stats.repartition(n), labels, "doc_id", "quality", 50).collect())) for n in (1, 5)]
    assert picks[0] == picks[1] and len(picks[0]) == 50
