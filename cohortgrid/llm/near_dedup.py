"""Near-duplicate classes by Order MinHash and banded alignment.

Words are digits, a-z (A-Z lower-cased) and everything beyond ASCII. A document's
5-word k-mers are labelled with their occurrence number; each of the sketch's
entries takes the two labelled k-mers of smallest hash and keeps them in the
order of the text (Order MinHash, l = 2). Two entries make a band; documents
that share a band are candidates. A candidate pair is linked if the Jaccard
similarity of its labelled k-mers is at least SIMILAR and an alignment within a
diagonal band finds an edit similarity of at least SIMILAR. Classes are the
connected components of links.

Scale: documents with equal word sequences are one class from the start, summed
up before any shuffle, so copies never meet in a bucket. Buckets of up to SMALL
rows give all their pairs; a larger one first pairs its rows with two of them:
one drawn by a hash (a different one in each band), and the one that stands in
most large buckets, as the original of many copies does. Where rows of a large
bucket are then in different classes, all its rows are open, and all pairs of
open rows in different classes that can reach SIMILAR are verified: such a pair
shares one of the k-mers in which the two start (rarest first, a fifth of them
and one more), at a place that leaves enough others. That filter loses no pair,
so no candidate pair stays unverified unless its rows are in one class already.
Rows that share a k-mer meet by size classes, in which a row stands only where
its size and its place leave room for a similar one, and rows of the group's main
class don't meet each other; what is left of over BLOCK rows is dealt out by
pairs of blocks. Every table that a hot key could hit is written first, so Spark
can split it. Words travel as
32-bit hashes, only for open rows and candidate pairs. Collected are the counts
of hashed k-mers, COUNTED numbers whatever the input.

Cases: null text counts as empty; documents without words are equal if their
texts are; with fewer than five words, a document is only near to equal ones;
repeated rows are copies; ids may repeat or be null; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD, dropped, keyed, written

K, SIMILAR = 5, 0.8
#: Bands, and rows of a bucket that are paired all with all at once.
BANDS, SMALL = 20, 8
ENTRIES = 2 * BANDS
#: Counters of hashed k-mers (a power of two), rows of a shared k-mer that are paired in one group, and how far sizes of one class may be apart.
COUNTED, BLOCK, SIZES = 1 << 18, 256, 1.05

WORDS = re.compile(WORD)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RNG = np.random.default_rng(20)
POWERS = _RNG.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEEDS = _RNG.integers(1, 2**63, (ENTRIES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALT = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 32-bit hash, remembered for up to 100,000 words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word)
        return h


def kmers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers in order, and the same labelled with their occurrence number."""
    w = mixed(words.astype(np.uint64))
    n = len(w) - K + 1
    plain = np.zeros(n, np.uint64)
    for j in range(K):
        plain += w[j : j + n] * POWERS[j]
    plain = mixed(plain)
    order = np.argsort(plain, kind="stable")
    run = plain[order]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    nth = np.empty(n, np.uint64)
    nth[order] = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    return plain, mixed(plain + nth * MIX2)


def bands(words: np.ndarray) -> np.ndarray:
    """BANDS hashes."""
    plain, labelled = kmers(words)
    order = labelled * SEEDS
    one = order.argmin(1)
    order[np.arange(ENTRIES), one] = np.uint64(2**64 - 1)
    two = order.argmin(1)
    entry = mixed(plain[np.minimum(one, two)] * MIX1 + plain[np.maximum(one, two)])
    return mixed(entry[0::2] * MIX2 + entry[1::2] + BAND_SALT)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for b in batches:
        digests, words, sizes, sketches, none = [], [], [], [], np.empty(0, np.int64)
        for value in b.column(2):  # one text in memory at a time
            text = value.as_py() or ""
            found = WORDS.findall(text.translate(LOWER))
            ids = np.fromiter(map(known.__getitem__, found), np.uint32, len(found))
            digests.append(hashlib.blake2b("\n".join(found).encode() if found else b"\0" + text.encode(), digest_size=16).digest())
            words.append(ids.tobytes())
            sizes.append(len(found))
            sketches.append(bands(ids).view(np.int64) if len(found) >= K else none)
        ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *sketches])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(words, pa.binary()), pa.array(sizes, pa.int32()), lists], ["_row", "_id", "digest", "words", "n", "bands"])


def slide(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How far the diagonal through (i, j) matches: the first i without a match."""
    step = 16
    while True:
        x, y = a[i : i + step], b[j : j + step]
        n = min(len(x), len(y))
        if not n:
            return i
        off = x[:n] != y[:n]
        p = int(off.argmax())
        if off[p]:
            return i + p
        i, j, step = i + n, j + n, step * 4


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edits between a and b, aligned inside the band of diagonals that most edits can reach; None if more than most."""
    goal = len(a) - len(b)
    if abs(goal) > most:
        return None
    reach = {0: slide(a, b, 0, 0)}
    for edits in range(most + 1):
        if reach.get(goal, -1) >= len(a):
            return edits
        now = {}
        for d in range(-edits - 1, edits + 2):
            if abs(d - goal) > most - edits:
                continue
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -1))
            i = min(i, len(a), len(b) + d)
            if i >= max(0, d):
                now[d] = slide(a, b, i, i - d)
        reach = now
    return None


def similar(a: np.ndarray, b: np.ndarray, a_kmers: np.ndarray, b_kmers: np.ndarray) -> bool:
    both = len(np.intersect1d(a_kmers, b_kmers, assume_unique=True))
    if both < SIMILAR * (len(a_kmers) + len(b_kmers) - both) - 1e-9:
        return False
    longer = max(len(a), len(b))
    return edit_distance(a, b, int(longer - SIMILAR * longer + 1e-9)) is not None


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        links, last = [], (None, None, None)
        for x, y, wx, wy in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            if last[0] != x:
                ids = np.frombuffer(wx.as_py(), np.uint32)
                last = (x, ids, kmers(ids)[1])
            ids = np.frombuffer(wy.as_py(), np.uint32)
            if similar(last[1], ids, last[2], kmers(ids)[1]):
                links.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component): alternating large and small stars, until nothing changes."""
    edges, before = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        for large in (True, False):
            near = edges.union(edges.select("v", "u")) if large else edges
            least = written(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
            met = near.join(least, "u")
            if large:
                made = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                made = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            new = written(made.filter("u <> v").distinct(), "edges")
            dropped(edges)
            dropped(least)
            edges = new


def close(x: Column, y: Column) -> Column:
    """Whether the sizes allow the similarity."""
    return F.least(x, y) - K + 1 >= SIMILAR * (F.greatest(x, y) - K + 1) - 1e-9


def candidates(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members: rep, n, key. Pairs (a, b) to verify, and the rows (key, rep) of large buckets."""
    buckets = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    met = members.join(buckets, "key")
    large = written(met.filter(F.col("size") > SMALL).select("key", "rep", "n"), "large")
    seen = large.groupBy("rep").agg(F.count(F.lit(1)).alias("seen"))
    draw = F.xxhash64("rep", "key")
    row = F.struct("rep", "n")
    leads = large.join(seen, "rep").groupBy("key").agg(F.array(F.min_by(row, draw), F.max_by(row, F.struct("seen", "rep"))).alias("leads"))
    star = large.join(written(leads, "leads"), "key").select("rep", "n", F.explode("leads").alias("y")).filter((F.col("rep") != F.col("y.rep")) & close(F.col("n"), F.col("y.n"))).select("rep", "y.rep")
    # At most SMALL rows a list.
    lists = met.filter(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("rep", "n")).alias("all"))
    each = lists.select(F.posexplode("all").alias("i", "x"), "all").select("x", F.explode(F.slice("all", F.col("i") + 2, SMALL)).alias("y"))
    few = each.filter(close(F.col("x.n"), F.col("y.n"))).select("x.rep", "y.rep")
    pairs = star.toDF("x", "y").union(few.toDF("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return written(pairs, "pairs"), large.select("key", "rep")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTED, np.int64)
    for b in batches:
        for words in b.column(0):
            np.add.at(counts, kmers(np.frombuffer(words.as_py(), np.uint32))[1] % np.uint64(COUNTED), 1)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["h", "n"])


def firsts(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The k-mers in which a document starts, rarest first. Of two documents that are similar, at least one is in both's."""
    labelled = kmers(words)[1]
    n = len(labelled)
    order = np.lexsort((labelled, counts[labelled % np.uint64(COUNTED)]))
    return labelled[order[: n - math.ceil(SIMILAR * n - 1e-9) + 1]]


def in_sizes(met: DataFrame) -> DataFrame:
    """met: t, rep, root, n, at; least and most n of t's rows. A row for each pair of size classes (short, long) in which a row can be the shorter or the longer of a similar pair that first meets in t: its place, too, bounds the size of the other."""
    size, low, high = F.col("n") - K + 1, F.col("least") - K + 1, F.col("most") - K + 1
    # What is left from here on must hold the k-mers that both share, as in open_pairs().
    bound = F.floor(((1 + SIMILAR) * (size - F.col("at")) + 2e-6) / SIMILAR) - size
    of = lambda c: F.floor(F.log(c.cast("double")) / math.log(SIZES))
    longest = F.least(high, bound, F.floor((size + 1e-6) / SIMILAR))
    shortest, shorter_most = F.greatest(low, F.ceil(SIMILAR * size - 1e-6)), F.least(size, bound)
    rows = met.select("t", "rep", "root", "n", "at", of(size).alias("own"), *[c.alias(k) for k, c in (("size", size), ("longest", longest), ("shortest", shortest), ("shorter_most", shorter_most))])
    one = rows.filter("longest >= size").withColumn("long", F.explode(F.sequence("own", of(F.col("longest"))))).withColumn("short", F.col("own")).withColumn("shorter", F.lit(True))
    two = rows.filter("shorter_most >= shortest").withColumn("short", F.explode(F.sequence(of(F.col("shortest")), of(F.col("shorter_most"))))).withColumn("long", F.col("own")).withColumn("shorter", F.lit(False))
    names = ["t", "short", "long", "shorter", "rep", "root", "n", "at"]
    return one.select(*names).union(two.select(*names))


def dealt(ends: DataFrame) -> DataFrame:
    """ends: in_sizes(). Its rows in the blocks (part, p, q) in which they meet. Rows of a group's main class need not meet each other: part 0 has the shorter rows of other classes and all longer ones, part 1 the shorter rows of the main class and the longer ones of others. So at most twice the pairs of different classes meet."""
    key = ["t", "short", "long"]
    per = ends.groupBy(*key, "root").agg(F.count_if("shorter").alias("x"), F.count_if(~F.col("shorter")).alias("y"))
    main = F.max_by(F.struct("root", "x", "y"), F.struct(F.col("x") + F.col("y"), "root"))
    groups = per.groupBy(*key).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), main.alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1 and x > 0 and y > 0")
    blocks = lambda n: F.ceil(n / BLOCK)
    part = lambda x, y: F.struct(blocks(x).alias("ps"), blocks(y).alias("qs"))
    x, y = F.col("x"), F.col("y")
    parts = groups.select(*key, F.col("main.root").alias("main"), F.array(part(x - F.col("main.x"), y), part(F.col("main.x"), y - F.col("main.y"))).alias("parts"))
    met = ends.join(written(parts, "parts"), key).withColumn("is_main", F.col("root") == F.col("main"))
    held = F.when(F.col("shorter"), F.array(F.when(F.col("is_main"), 1).otherwise(0))).when(F.col("is_main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    # A part without rows of either side has no blocks.
    held = F.filter(held, lambda i: (F.get("parts", i)["ps"] > 0) & (F.get("parts", i)["qs"] > 0))
    met = met.withColumn("part", F.explode(held)).withColumn("of", F.get("parts", F.col("part")))
    draw = F.xxhash64("rep", "t")
    own = F.pmod(draw, F.when(F.col("shorter"), F.col("of.ps")).otherwise(F.col("of.qs")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("shorter"), F.col("of.qs")).otherwise(F.col("of.ps")) - 1))
    met = met.withColumn("block", own).withColumn("other", other)
    p, q = (F.when(F.col("shorter") == k, F.col("block")).otherwise(F.col("other")) for k in (True, False))
    return met.select(*key, "shorter", "part", p.alias("p"), q.alias("q"), "rep", "root", "n", "at")


def open_pairs(rows: DataFrame) -> DataFrame:
    """rows: rep, root, words. All pairs (a, b) of different roots that the sizes, the shared first k-mer and its place allow to be similar."""
    counts = np.zeros(COUNTED, np.int64)
    for r in rows.select("words").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.h] = r.n

    def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, root, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = np.frombuffer(words.as_py(), np.uint32)
                t = firsts(ids, counts)
                full = lambda x, m=len(t): pa.array(np.full(m, x, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), full(rep), full(root), full(len(ids)), pa.array(np.arange(len(t)))], ["t", "rep", "root", "n", "at"])

    table = written(rows.select("rep", "root", "words").mapInArrow(_firsts, "t long, rep long, root long, n long, at long"), "firsts")
    shared = table.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")).filter("lo <> hi").drop("lo", "hi")
    ends = written(in_sizes(table.join(written(shared, "shared"), "t")), "sizes")
    met = dealt(ends)
    key, own = ["t", "short", "long", "part", "p", "q"], ["rep", "root", "n", "at"]
    x, y = (met.filter(F.col("shorter") == of).select(*key, *[F.col(c).alias(f"{c}_{name}") for c in own]) for of, name in ((True, "x"), (False, "y")))
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) - K + 1
    enough = (1 + SIMILAR) * left >= SIMILAR * (F.col("n_x") + F.col("n_y") - 2 * K + 2) - 1e-6
    pairs = x.join(y, key).filter((F.col("root_x") != F.col("root_y")) & (F.struct("n_x", "rep_x") < F.struct("n_y", "rep_y")) & close(F.col("n_x"), F.col("n_y")) & enough)
    return written(pairs.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct(), "pairs")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _row, id, class_id (largest id of its class, whose row is the one kept), class_size, kept."""
    kind = dict(docs.dtypes)[id_col]
    sketch = written(
        keyed(docs, _id=F.col(id_col), _t=F.col(text_col)).mapInArrow(_sketch, f"_row long, _id {kind}, digest binary, words binary, n int, bands array<long>"), "sketch"
    )
    same = written(sketch.groupBy("digest").agg(F.min("_row").alias("rep")), "same")
    reps = sketch.select(F.col("_row").alias("rep"), "n", "bands").join(same.select("rep"), "rep").filter(F.col("n") >= K)
    members = written(reps.select("rep", "n", F.explode("bands").alias("key")), "bands")
    words = sketch.select(F.col("_row"), "words")

    def verified(pairs: DataFrame) -> DataFrame:
        told = pairs.join(words.toDF("b", "wb"), "b").join(words.toDF("a", "wa"), "a").select("a", "b", "wa", "wb")
        return written(told.mapInArrow(_verify, "a long, b long"), "links")

    pairs, large = candidates(members)
    links = verified(pairs)
    root = components(links)
    # Large buckets whose rows are still in several classes.
    in_large = large.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    still = in_large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    still = written(in_large.join(written(still, "open"), "key").select("rep", "root").distinct(), "open-rows")
    if not still.isEmpty():
        rest = open_pairs(still.join(words.toDF("rep", "words"), "rep"))
        new = components(links.union(verified(rest)))
        dropped(root)
        root = new
    rows = sketch.select("_row", "_id", "digest").join(same, "digest").join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").select("_row", "_id", F.coalesce("root", "rep").alias("root"))
    rows = written(rows, "classes")
    stays = written(rows.groupBy("root").agg(F.max("_id").alias("class_id"), F.coalesce(F.max_by("_row", "_id"), F.min("_row")).alias("_keep"), F.count(F.lit(1)).alias("class_size")), "stays")
    return rows.join(stays, "root").select("_row", F.col("_id").alias(id_col), "class_id", "class_size", (F.col("_row") == F.col("_keep")).alias("kept"))
