"""Operators against plain versions, on documents with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from cohortgrid.llm import byte_bpe, chat_format, common, exact_dedup, license_scan, mixing, near_dedup, pii, quality_rules, substring_dedup, warc
from pyspark.sql import functions as F

DOC = "doc_id long, text string, source string, kept int, _row int, n_words int"
WORDS = [a + b for a in ("ba", "ko", "Li", "mu", "éa") for b in ("ra", "ne", "si", "to", "wu", "xé")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple]:
    shared = prose(99, 120)
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    texts = [None, "", " \n\t ", "!!!", "???", "one two", base, base, base.upper().replace("É", "É"), " ".join(near), base + " tail", prose(2, 80) + " " + shared + " " + prose(3, 40), shared + " " + prose(4, 70), "ab" * 3000, "MIT License; the Apache License, GNU General Public License. mit license " + prose(5, 60), prose(6, 20_000)]
    texts += [prose(k, 60) for k in range(10, 14)]
    rows = [(k, t, "host" + str(k % 3) if k % 5 else None, 7, 8, 9) for k, t in enumerate(texts)]
    return [*rows, rows[6], (None, base, "host0", 1, 1, 1), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return common.stable(spark.createDataFrame(corpus(), DOC).coalesce(2))


@pytest.fixture(scope="module")
def rows(docs):
    return {r["_row"]: r for r in common.keyed(docs, doc_id=F.col("doc_id"), text=F.col("text")).collect()}


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def fold(text: str | None) -> str:
    return (text or "").translate(common.LOWER)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_row_keys_are_the_same_whatever_the_splits(spark, docs, tmp_path):
    many = docs.select("doc_id", F.col("text").alias("_metadata"), F.lit("x").alias("_ROW")).repartition(5)
    many.write.parquet(f"file://{tmp_path}/an odd é%20 name")
    read = lambda: spark.read.parquet(f"file://{tmp_path}/an odd é%20 name")
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in ("1000", "100000000"):
        spark.conf.set(key, size)
        found.append(sorted(map(tuple, common.keyed(read(), t=F.col("_metadata"), i=F.col("doc_id")).collect())))
    spark.conf.set(key, before)
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == docs.count()
    assert common.stable(read()).inputFiles() == read().inputFiles()
    for moving in (read().limit(3), read().join(read().select("doc_id").limit(4), "doc_id"), read().filter(F.rand() < 0.5)):
        assert set(common.stable(moving).inputFiles()).isdisjoint(read().inputFiles())


def test_exact_groups_while_split_sizes_change(spark, docs, monkeypatch):
    """Executors that come and go change how a scan is split."""
    want, sizes = sorted(map(str, exact_dedup.exact_dedup(docs).collect())), iter(range(300, 100_000, 700))
    write = exact_dedup.written

    def changing(df, name):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(next(sizes)))
        return write(df, name)

    monkeypatch.setattr(exact_dedup, "written", changing)
    try:
        assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_exact_texts_are_read_whole_only_while_many_share_bytes(spark, tmp_path, monkeypatch):
    long = prose(1, 900)
    texts = [f"{k}: {prose(k, 5)}" for k in range(80)] + [long + end for end in ("", "", "x", "X", "é", "è")] + [long[:n] for n in (64, 64, 320, 1344, 1344, 1345)] + [None, ""]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(2).write.parquet(f"file://{tmp_path}/docs")
    given, reads, write = spark.read.parquet(f"file://{tmp_path}/docs"), [], exact_dedup.written

    def noted(df, name):
        reads.append((name, any(f"{tmp_path}/docs/" in f for f in df.inputFiles())))
        return write(df, name)

    monkeypatch.setattr(exact_dedup, "written", noted)
    out = {r["doc_id"]: r for r in exact_dedup.exact_dedup(given).collect()}
    want = defaultdict(list)
    for k, t in enumerate(texts):
        want[fold(t)].append(k)
    assert len(out) == len(texts)
    for ids in want.values():
        assert all((out[k]["keep_id"], out[k]["group_size"], out[k]["kept"]) == (max(ids), len(ids), k == max(ids)) for k in ids)
    # One text in six goes on after the first level; levels after it read what is left of those.
    assert len([n for n, _ in reads if n == "radix-groups"]) > 4
    assert len([n for n, whole in reads if whole]) <= 3


def test_license_base_phrases(docs, rows, empty):
    got = Counter(tuple(r) for r in license_scan.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    want = Counter()
    for r in rows.values():
        words = re.findall(common.WORD, fold(r.text))
        hits = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        want[r.doc_id, len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    assert got == want
    assert license_scan.license_scan(empty).count() == 0


def test_license_long_notice_with_a_lost_word(spark):
    words = license_scan.NOTICES["bsd"][1].split()
    d = spark.createDataFrame([(1, " ".join(["x"] + words[:10] + words[11:]))], "doc_id long, text string")
    r = license_scan.license_scan(d).first()
    assert r.labels == "bsd" and r.n_base == 0 and 0.6 <= r.score < 1 and r.n_spans == 1


def test_license_repeated_grams_are_no_notice(spark):
    d = spark.createDataFrame([(1, "the license " * 40), (2, "of the license " * 40), (3, "this software and " * 30), (4, "the terms of " * 9)], "doc_id long, text string")
    assert [tuple(r) for r in license_scan.license_scan(d).select("labels", "score", "n_spans").collect()] == [("", 0.0, 0)] * 4
    notice = license_scan.NOTICES["mpl"][1]
    r = license_scan.license_scan(spark.createDataFrame([(1, f"a {notice} b {prose(1, 30)} {notice}")], "doc_id long, text string")).first()
    assert r.labels == "mpl" and r.n_spans == 4 and r.score == 1  # the long notice and the short one in it, twice


def test_chat_long_texts_and_clashing_columns(spark):
    turns = [(1, 1, "user", prose(1, 30_000), "a", "b"), (1, 2, "assistant", "[/INST]" * 20_000 + prose(2, 30_000), "c", "d")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string, loss_start string")
    r = chat_format.read_back(chat_format.format_turns(d)).first()
    assert (r.loss_chars, r.loss_sha256, r.n_turns) == (len(turns[1][3]), sha(turns[1][3].encode()), 2)
    with pytest.raises(Exception, match="grammar"):
        chat_format.read_back(chat_format.format_turns(d).withColumn("formatted", F.concat("formatted", F.lit("x")))).collect()


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\s> <s", "[/INST", "\\", "<", "", None, "é\n[\\/INST]"]
    turns = [(k, t, ("user", "assistant", None, "<s>")[t % 4], nasty[((k or 0) + t) % len(nasty)]) for k in (1, 2, None) for t in range(9)] + [(1, 3, "assistant", "again")] * 2
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(d)).collect()}
    for conv in (1, 2, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1], t[2] is not None, t[2] or "", t[3] is not None, t[3] or ""))
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss.encode()))
    for r in chat_format.format_turns(d).filter("loss_start is not null").collect():
        assert chat_format.unescape(r.formatted[r.loss_start : r.loss_end]) == (r.text or "")
        assert not chat_format.CONTROL.search(r.formatted[r.loss_start : r.loss_end])
    assert chat_format.read_back(chat_format.format_turns(d.limit(0))).count() == 0


def test_chat_parser_refuses_other_text():
    assert chat_format.parse("<s>[INST]user[/INST]a") is None and chat_format.parse("x") is None and chat_format.parse("") == []


def test_warc_round_trip(spark):
    pages = [(1, "http://a/é x", "<p>"), (2, None, "<p>"), (5, "u", "<p>"), (5, "u", "<p>"), (3, "u", None), (4, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 5), (None, "u", "only")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.read_warc(warc.write_warc(d)).drop("url").collect()), key=str)
    want = []
    for page, _, html in pages:
        body = (html or "").encode()
        top = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        first = page == top or top is None
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top, body if first else None))
    assert got == sorted(want, key=str)
    assert warc.read_warc(warc.write_warc(d.limit(0))).count() == 0


def test_warc_long_texts_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "u", prose(1, 200_000), 5, "x"), (2, "u", prose(1, 200_000), 6, "y")], "page_id long, url string, html string, bytes long, first string")
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(d)).collect()}
    assert bytes(got[2].payload).decode() == prose(1, 200_000) and got[1].refers_to == 2


def test_warc_reader_refuses_damage():
    import io

    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").digest(), 3, None)
    assert warc.parsed(next(warc.members(io.BytesIO(good))))[:4] == (1, "u", 3, base64.b32encode(hashlib.sha1(b"abc").digest()).decode())
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(next(warc.members(io.BytesIO(warc.record(1, "u", b"abd", hashlib.sha1(b"abc").digest(), 3, None)))))
    with pytest.raises(ValueError, match="inside"):
        list(warc.members(io.BytesIO(good[:-9])))


def test_quality_measures(docs, rows, empty):
    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        win = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if win[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)

    got = Counter(tuple(r) for r in quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in rows.values():
        m = plain(r.text)
        want[(r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.measures("a b c a b c d # |\nx\nx\n\n") == (11, 11, 2, 1, 6)


@pytest.mark.parametrize("most", [0, quality_rules.MAX_HOSTS])
def test_a_bad_host_takes_its_documents_along(spark, most, monkeypatch):
    monkeypatch.setattr(quality_rules, "MAX_HOSTS", most)
    good = prose(1, 70)
    d = spark.createDataFrame([(k, good if k % 10 == 0 else "bad", "worst") for k in range(200)] + [(k, good + str(k), f"h{k % 5}") for k in range(200, 600)], "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.quality_rules(d).filter("kept").collect()}
    assert kept == set(range(200, 600))


def test_exact_groups(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows.values():
        groups[fold(r.text)].append(r.doc_id)
    out = exact_dedup.exact_dedup(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        text = fold(rows[r["_row"]].text)
        assert (r.group_size, r.text_sha256) == (len(groups[text]), sha(text.encode()))
        assert r.keep_id == max((x for x in groups[text] if x is not None), default=None)
    assert sum(r.kept for r in out) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def labelled(words):
    c, out = Counter(), set()
    for k in range(len(words) - 4):
        g = tuple(words[k : k + 5])
        out.add((g, c[g]))
        c[g] += 1
    return out


def test_near_classes(docs, rows, empty):
    words = {k: re.findall(common.WORD, fold(r.text)) for k, r in rows.items()}
    sets = {k: labelled(w) for k, w in words.items()}
    parent = {k: k for k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            same = words[a] == words[b] if words[a] else not words[b] and (rows[a].text or "") == (rows[b].text or "")
            both = len(sets[a] & sets[b])
            if same or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    want = {frozenset(k for k in rows if root(k) == x) for x in {root(k) for k in rows}}
    found = defaultdict(set)
    out = near_dedup.near_dedup(docs)
    by_class = {r["_row"]: r for r in out.collect()}
    keepers = [r for r in by_class.values() if r.kept]
    assert len(keepers) == len(want) and len(by_class) == len(rows)
    for k in rows:
        found[by_class[k].class_id, by_class[k].class_size, root(k)].add(k)
    assert {frozenset(v) for v in found.values()} == want
    assert near_dedup.near_dedup(empty).count() == 0


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(3)
    base = prose(7, 200).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for k in rng.sample(range(200), 2):
            w[k] = rng.choice(WORDS)
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts + [prose(8, 200)])), "doc_id long, text string")
    assert sorted(r.class_size for r in near_dedup.near_dedup(d).filter("kept").collect()) == [1, 60]


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 16])
def test_large_buckets_miss_no_link_of_brute_force(spark, block, monkeypatch):
    """One original whose copies are similar to it but not to each other, and rows that share a passage with it."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for copies, rest in ((150, 60), (120, 0)):
        original = [word() for _ in range(600)]
        texts.append(original)
        for k in range(copies):
            copy = list(original)
            for at in range(k % 7, 600, 50):
                copy[at + rng.randrange(40)] = word()
            texts.append(copy)
        if not rest:  # without the original there are only chains of copies
            texts.remove(original)
        texts += [original[:400] + [word() for _ in range(200)] for _ in range(rest)]
    ids = [np.fromiter(map(near_dedup.WordHashes().__getitem__, t), np.uint32) for t in texts]
    sets = [near_dedup.kmers(i)[1] for i in ids]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if top(i) != top(j) and near_dedup.similar(ids[i], ids[j], sets[i], sets[j]):
                root[top(i)] = top(j)
    want = sorted(Counter(map(top, range(len(texts)))).values())
    assert want[-1] == 151
    out = near_dedup.near_dedup(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted(r.class_size for r in out.filter("kept").collect()) == want


def test_open_pairs_have_every_similar_pair_of_any_sizes(spark, monkeypatch):
    """Copies that are cut or changed in some places, in classes drawn at random: sizes fall into many size classes, groups into many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = np.random.default_rng(11)
    rows = []
    for long in (6, 40, 150):
        base = rng.integers(0, 2**32, long, dtype=np.uint32)
        for _ in range(40):
            a = base.copy()
            a[rng.integers(0, long, rng.integers(0, 1 + long // 20))] += 1 + rng.integers(0, 3, dtype=np.uint32)
            rows.append((len(rows), int(rng.choice([1, 1, 1, 2, 3, 4])), a[: max(near_dedup.K, long - int(rng.integers(0, 1 + long // 4)))]))
    sets = [near_dedup.kmers(w)[1] for *_, w in rows]
    want = set()
    for i, x, _ in rows:
        for j, y, _ in rows[:i]:
            both = len(np.intersect1d(sets[i], sets[j]))
            if x != y and both >= near_dedup.SIMILAR * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                want.add((j, i))
    table = spark.createDataFrame([(k, r, w.tobytes()) for k, r, w in rows], "rep long, root long, words binary")
    got = {(p.a, p.b) for p in near_dedup.open_pairs(table).collect()}
    assert len(want) > 400 and want <= got and all(rows[a][1] != rows[b][1] for a, b in got)


def test_rows_of_a_large_class_are_dealt_in_proportion(spark, monkeypatch):
    """A class whose rows share a k-mer with two rows of other classes: none of them is dealt once for each block of its own class."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    seen = []
    deal = near_dedup.dealt

    def counted(ends):
        out = near_dedup.written(deal(ends), "dealt")
        seen.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "dealt", counted)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, 60, dtype=np.uint32)
    for copies in (200, 400):
        rows = [(k, 0, base.copy()) for k in range(copies)] + [(copies + k, 1 + k, base.copy()) for k in range(2)]
        table = spark.createDataFrame([(k, r, w.tobytes()) for k, r, w in rows], "rep long, root long, words binary")
        assert near_dedup.open_pairs(table).count() == 2 * copies + 1
    assert seen[1] < 2.2 * seen[0]


def test_first_kmers_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 2**32, rng.integers(near_dedup.K, 200), dtype=np.uint32)
        b = a.copy()
        b[rng.integers(0, len(a), rng.integers(0, 1 + len(a) // 15))] += 1
        b = b[: max(near_dedup.K, len(b) - rng.integers(0, 1 + len(b) // 20))]
        counts = rng.integers(0, 4, near_dedup.COUNTED)
        x, y = (near_dedup.kmers(w)[1] for w in (a, b))
        both = len(np.intersect1d(x, y))
        if both >= near_dedup.SIMILAR * (len(x) + len(y) - both):
            assert len(np.intersect1d(near_dedup.firsts(a, counts), near_dedup.firsts(b, counts)))


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        d = plain(a, b)
        for most in (0, 2, 5, 14):
            assert near_dedup.edit_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == (d if d <= most else None)


def test_byte_bpe_is_tiktoken(spark, docs, rows, empty, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = byte_bpe.Coder(path, P.PATTERN)
    long = [prose(1, 9000), "x" * 90_000, "a " * 30_000 + " " * 5000 + "we're" * 9000, "日本語 " * 20_000]
    more = spark.createDataFrame([(100 + k, t, None, None, None, None) for k, t in enumerate(long)], DOC)
    both = docs.unionByName(more)
    got = Counter(tuple(r) for r in byte_bpe.byte_bpe(both, path, P.PATTERN).collect())
    want = Counter()
    for key, text in [*((r.doc_id, r.text or "") for r in rows.values()), *((100 + k, t) for k, t in enumerate(long))]:
        ids = own.core.encode_ordinary(text)
        want[key, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text.encode())] += 1
    assert got == want
    assert byte_bpe.byte_bpe(empty, path, P.PATTERN).count() == 0


def merged_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-level BPE by its definition: again and again the neighbours of lowest rank become one."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], 1 << 30))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_byte_bpe_by_its_definition_and_stitching():
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = byte_bpe.Coder(path, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    rng = random.Random(8)
    for text in [prose(k, 40) for k in range(5)] + ["日本語 we're 12345 \n\n x"]:
        ids = [n for piece in own.split.findall(text) for n in merged_bytes(piece.encode(), ranks)]
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    for _ in range(300):
        text = "".join(rng.choice(("word", " ", "\n", "  ", "1", "'re", "é日", "!", " " * 500, "x" * 300)) for _ in range(rng.randrange(6000)))
        assert byte_bpe.stitched(own, text) == byte_bpe.whole(own, text)


BASE_KINDS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    def passes(kind, found):
        d = re.sub("[^0-9]", "", found)
        return (True, kind == 1 and all(int(x) <= 255 for x in found.split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[kind]

    return sorted((m.start(), k, m.end()) for k, p in enumerate(BASE_KINDS) for m in re.finditer(p, text) if passes(k, m.group()))


def test_pii_base_on_random_text():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("aB1 2.@-+%()0é") for _ in range(rng.randrange(40)))
        assert [x[:3] for x in pii.entities(text)] == plain_pii(text)
    assert not pii.luhn("4111111111111112") and pii.luhn("4111111111111111")
    for run in ("1" * 50_000, "a" * 50_000, "1." * 30_000, "+" * 50_000):
        pii.entities(run)


def test_pii_spans_of_a_whole_table(spark):
    """Terms by counting over all documents in plain Python."""
    path = "/root/testdata/sf0.001/documents.parquet"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(path).select("doc_id", "text").collect()}
    texts |= {10**6 + k: f"{prose(k, 12)} badge{'xyz'[k % 3]} zanzibar help{k}@host{k}.org {prose(50 + k, 12)}" for k in range(9)}
    n_t, n_e, n_et, places, base = Counter(), Counter(), Counter(), {}, {}
    for k, text in texts.items():
        n_t.update({m.group().lower() for m in re.finditer(r"[^\W\d_]{4,}", text)})
        found = [x for x in pii.entities(text)]
        for m in re.finditer(r"[A-Za-z0-9]{20,}", text):
            run = m.group()
            bits = -sum(np.log2(run.count(c) / len(run)) for c in run)
            if re.search("[a-zA-Z]", run) and re.search("[0-9]", run) and bits >= pii.BITS and all(m.end() <= s or e <= m.start() for s, _, e, _ in found[: len(found)]):
                found.append((m.start(), 4, m.end(), run))
        base[k], pairs = found, {}
        words = [m.span() for m in re.finditer(r"\S+", text)]
        for s, kind, e, value in found:
            over = [i for i, (a, z) in enumerate(words) if z > s and a < e]
            low, high = words[max(0, over[0] - pii.WINDOW)][0], words[min(len(words) - 1, over[-1] + pii.WINDOW)][1]
            for m in re.finditer(r"[^\W\d_]{4,}", text):
                if low <= m.start() and m.end() <= high and all(m.end() <= a or z <= m.start() for a, _, z, _ in found):
                    for name in pii.names(kind, value):
                        pairs.setdefault((name, m.group().lower()), set()).add(m.span())
        n_e.update({n for _, kind, _, v in found for n in pii.names(kind, v)})
        n_et.update(pairs.keys())
        places[k] = pairs
    total = len(texts)
    tells = {(e, t) for (e, t), n in n_et.items() if n >= pii.SUPPORT and n_e[e] < total and np.log2(total * n / (n_e[e] * n_t[t])) >= pii.DISCLOSES * np.log2(total / n_e[e]) - 1e-9}
    want = {}
    for k in texts:
        spans = {(s, kind, e) for s, kind, e, _ in base[k]} | {(a, 5, z) for x, at in places[k].items() if x in tells for a, z in at}
        want[k] = ",".join(f"{pii.KINDS[kind]}:{s}:{e}" for s, kind, e in sorted(spans))
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want
    assert sum("term:" in x for x in want.values()) >= 9


def test_pii_terms(spark, docs, empty):
    rows = [(k, f"write to our contact zanzibar at help@x.org today {k}") for k in range(6)] + [(10 + k, f"nothing but contact today write our {k}") for k in range(40)] + [(90, None), (91, "")]
    d = common.stable(spark.createDataFrame(rows, "doc_id long, text string"))
    found = pii.find_pii(d)
    got = {r.doc_id: r for r in found.collect()}
    assert all(got[k].spans.startswith("term:21:29,email:33:43") and got[k].n_term == 1 and got[k].n_email == 1 for k in range(6))
    assert all(got[k].spans == "" for k in (*range(10, 50), 90, 91))
    assert got[0].base_sha256 == sha(b"email:33:43") and got[90].base_sha256 == sha(b"")
    clean = {r["_row"]: r.sanitised for r in pii.sanitised(d, found).collect()}
    assert clean[got[3]["_row"]] == "write to our contact  at [EMAIL] today 3"
    assert pii.find_pii(empty).count() == 0 and pii.find_pii(docs).count() == docs.count()


def plain_repeats(texts, length):
    seen = Counter(d[k : k + length] for d in texts for k in range(len(d) - length + 1))
    out = []
    for d in texts:
        gone = np.zeros(len(d) + 1, int)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0 if len(d) else np.zeros(0, bool)
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha(kept)))
    return out


@pytest.mark.parametrize("group", [256, 2])
def test_substrings(spark, docs, rows, empty, group, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    shared, rng = prose(50, 90), random.Random(4)
    cut = [(200 + k, prose(60 + k, 30) + shared[rng.randrange(30) : rng.randrange(420, 700)] + prose(80 + k, 20)) for k in range(14)]
    both = docs.unionByName(spark.createDataFrame([(*x, "start", 1, 2, 3) for x in cut], DOC))
    texts = [(r.doc_id, (r.text or "").encode()) for r in rows.values()] + [(k, t.encode()) for k, t in cut]
    want = Counter((k, *m) for (k, _), m in zip(texts, plain_repeats([t for _, t in texts], 400), strict=True))
    got = Counter(tuple(r) for r in substring_dedup.substring_dedup(both).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(6)
    for _ in range(50):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(3))) + b"q" * rng.choice((0, 31, 40)) + bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(30)]
        assert [strings[k] for k in substring_dedup.deep_shallow(strings)] == sorted(strings)


def test_mixing_meets_targets(spark, docs, empty):
    rng = random.Random(9)
    kinds = {0: ("good", "fine"), 1: ("spam", "buy"), 2: ("vile", "hate")}
    rows, labels = [], []
    for k in range(600):
        kind = (0, 0, 0, 1, 2)[k % 5]
        rows.append((k, prose(k, 30) + " " + " ".join(rng.choices(kinds[kind], k=6))))
        if k % 2:
            labels.append((k, int(kind != 1), int(kind == 2)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None, None), labels[0]], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in mixing.mix(d, lab, {"high": 0.9, "low": 0.08, "toxic": 0.02}).collect()}
    held = [k for k in range(600) if not k % 2]
    right = sum(max(mixing.DOMAINS, key=lambda x: out[k][f"p_{x}"]) == ("high", "high", "high", "low", "toxic")[k % 5] for k in held)
    assert right >= 0.95 * len(held)
    total = {x: sum(r.rate * r.n_tokens * r[f"p_{x}"] for r in out.values()) for x in mixing.DOMAINS}
    share = {x: v / sum(total.values()) for x, v in total.items()}
    assert share["high"] == pytest.approx(0.9, abs=0.02) and share["low"] == pytest.approx(0.08, abs=0.01) and share["toxic"] == pytest.approx(0.02, abs=0.01)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in out.values())
    assert mixing.mix(docs, lab.limit(0)).count() == docs.count()
    assert mixing.mix(empty, lab).count() == 0
    assert set(out) == set(range(600))


def test_mixing_is_the_same_over_any_files(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one, many = (sorted(map(tuple, mixing.mix(common.stable(x), labels).drop("_row").collect())) for x in (d, d.repartition(8, "source")))
    assert one == many


def test_mixing_leaves_clean_documents_alone(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    met = mixing.mix(d, labels).join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg((F.col("copies") > 0).cast("int")).alias("kept"))
    kept = {(r.quality, r.toxic): r.kept for r in met.collect()}
    assert kept[1, 0] > 0.88 and kept[1, 1] < 0.2 and kept[0, 1] < 0.2


@pytest.mark.parametrize("spread", [0.01, 0.2])
def test_mixing_rates_are_the_optimum(spark, spread):
    """Against accelerated projected gradients, on posteriors that hardly tell the domains apart."""
    rng = np.random.default_rng(4)
    low, toxic = np.clip(rng.normal(0.127, spread, 300), 0, 0.5).round(3), np.clip(rng.normal(0.113, 3 * spread, 300), 0, 0.5).round(3)
    p, n = np.stack([1 - low - toxic, low, toxic], 1), rng.integers(20, 2000, 300)
    found = spark.createDataFrame([(*map(float, x), int(m)) for x, m in zip(p, n, strict=True)], "p_high double, p_low double, p_toxic double, n_tokens long")
    out = found.withColumn("rate", mixing.descent(found, mixing.TARGETS)).collect()
    have = n @ p
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * have[0] / mixing.TARGETS["high"]
    r = ahead = np.ones(300)
    for k in range(30_000):
        new = np.maximum(0, ahead - (p @ (((ahead * n) @ p - want) / have) + mixing.RIDGE * (ahead - 1)) / (1 + mixing.RIDGE))
        ahead = new + (new - r) * (1 - mixing.RIDGE**0.5) / (1 + mixing.RIDGE**0.5)
        r = new
    best = {tuple(x): y for x, y in zip(p.tolist(), r, strict=True)}
    assert all(x.rate == pytest.approx(best[x.p_high, x.p_low, x.p_toxic], abs=1e-3) for x in out)
