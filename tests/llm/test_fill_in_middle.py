"""Fill-in-middle against a plain version."""

import hashlib
import random
import re

import pytest
from cohortgrid.llm import fill_in_middle as fim
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain_version(doc_id, text, rate=90, spm=20, epoch=1):
    text, h = text or "", sha(f"{epoch}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def texts():
    rng = random.Random(5)
    odd = [None, "", " ", "\n", "a", "é", "😀", "a<P>b", "<S", "<<<S", "M>", "<M>", "P><", "<P <S <M", "x" * 50_000, "a b\r\n" * 20_000, " \u0085 line", "\0nul", "$1 \\ (a|b) [c]"]
    return odd + ["".join(rng.choice("ab <>PSM\n é😀.") for _ in range(rng.randrange(60))) for _ in range(400)]


def test_like_the_plain_version(spark):
    rows = [(k, t, "clash", 3) for k, t in enumerate(texts())] + [(None, "null id", "x", 1), (None, "null id", "x", 1), (-7, "neg", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    found = sorted(map(tuple, fim.digests(fim.fill_in_middle(docs)).collect()), key=str)
    assert found == sorted((plain_version(r[0], r[1]) for r in rows), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_parameters_and_parts(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "key int, body string")
    out = fim.fill_in_middle(docs, "key", "body", rate=50, spm=100, epoch=2).collect()
    assert {r.form for r in out} == {"plain", "spm"}
    for r in out:
        assert (r.text, r.output) == (r.text, r.text) if r.form == "plain" else r.prefix + r.middle + r.suffix == r.text
        assert (r.key, r.n, r.form) == plain_version(r.key, r.text, 50, 100, 2)[:3]


def test_empty_table_and_bad_output(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(fim.fill_in_middle(none)).count() == 0
    for output in ("no sentinel", "<P>a<S>b", "x<P>a<S>b<M>c", "<S>a<P>b<M>c"):
        with pytest.raises(PySparkException, match="not an arranged text"):
            spark.range(1).select(fim.restore(F.lit(output), F.lit("psm"))).collect()


def test_no_shuffle_and_no_python(spark):
    plan = fim.digests(fim.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", plan)
