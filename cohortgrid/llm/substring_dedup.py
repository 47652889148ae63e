"""Removal of repeated 400-byte strings by a sparse, distributed suffix array.

Which suffixes to sort. Every window of LENGTH bytes holds a minimiser: the
smallest hash of its KMER-byte strings, the first of equals. Equal windows have
it at the same place, so a window that is repeated contains an anchor (a
minimiser's place) whose k-mer is repeated, and only the suffixes at such
anchors need sorting, with what stands before them.

How an anchor is settled. Its context is the REACH bytes before it to LENGTH
bytes behind. Two places share a window around the anchor if they agree on l
bytes before and r bytes behind it, l + r >= LENGTH. (1) Equal whole contexts
share everything; counting them settles nearly all anchors of copies. (2) In the
other groups of equal k-mers, suffixes from the anchor and reversed prefixes up
to it are sorted deep-shallow: multikey quicksort on eight bytes a step to
SHALLOW bytes, then blind tries for what is still tied. Neighbours' common
prefixes give l and r of all pairs, hence the furthest shared window to either
side; all windows of an anchor overlap, so the outermost two bound what goes.
Pairs are looked at a row at a time, in memory of the group's size.
(3) Groups of more than GROUP different contexts are not sorted in one task:
their windows are counted by digest instead, each as a row, summed before the
shuffle. It is exact too, and no cap.

Scale: anchors are about one in 160 bytes and travel as 32 bytes; equal contexts
in a document travel once. Bytes travel only for contexts that step 2 needs.
Tables that a hot string could hit are written first and joined, so Spark can
split them. Nothing is collected.

Cases: null text counts as empty; texts shorter than LENGTH stay whole; windows
never cross documents; a document's own repeats count, overlapping or not;
repeated rows are documents like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, written

LENGTH, KMER = 400, 80
#: k-mers in a window, and so how far before its anchor a window can start.
SPAN = LENGTH - KMER + 1
REACH = SPAN - 1
SHALLOW, GROUP = 32, 4096
#: Bytes that are hashed at a time; neighbouring blocks overlap.
BLOCK = 1 << 20

_RNG = np.random.default_rng(9)
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(0, 2**61)) * 8 + 5
MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEPS = np.full(BLOCK + 2 * LENGTH, BASE, np.uint64)
_BACK = np.full(BLOCK + 2 * LENGTH, pow(BASE, -1, 2**64), np.uint64)
_STEPS[0] = _BACK[0] = 1
POWER, INVERSE = np.cumprod(_STEPS, dtype=np.uint64), np.cumprod(_BACK, dtype=np.uint64)
PLACE = np.uint64((1 << 21) - 1)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of minimisers and the hashes of their k-mers: polynomial sums modulo 2^64, mixed. Equal hashes: the first place of a window."""
    places, hashes = [], []
    for start in range(0, max(1, len(data) - LENGTH + 1), BLOCK):
        part = data[start : start + BLOCK + LENGTH - 1]
        if len(part) < LENGTH:
            break
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[part] * POWER[: len(part)], dtype=np.uint64)])
        h = (sums[KMER:] - sums[:-KMER]) * INVERSE[: len(part) - KMER + 1]
        h = (h ^ (h >> np.uint64(32))) * MIX
        h ^= h >> np.uint64(29)
        # The place in the low bits makes the least value of a window its first minimum; least values by prefixes and suffixes of runs of SPAN.
        key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        grid = np.concatenate([key, np.full(-len(key) % SPAN, 2**64 - 1, np.uint64)]).reshape(-1, SPAN)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[: len(h) - SPAN + 1], ahead[SPAN - 1 : len(h)])
        at = (least[np.r_[True, least[1:] != least[:-1]]] & PLACE).astype(np.int64)
        places.append(at + start)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def context(data: bytes, at: int) -> tuple[bytes, bytes]:
    return data[max(0, at - REACH) : at], data[at : at + LENGTH]


def digest(*parts: bytes) -> int:
    h = hashlib.blake2b(len(parts[0]).to_bytes(4, "little"), digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, hs, cs, offs = [], [], [], []
        for row, text in zip(b.column(0), b.column(1), strict=True):  # one text in memory at a time
            row, data = row.as_py(), text.as_py().encode()
            if len(data) < LENGTH:
                continue
            at, h = anchors(np.frombuffer(data, np.uint8))
            own: dict[tuple[int, int], list[int]] = {}
            for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                own.setdefault((x, digest(*context(data, p))), []).append(p)
            rows += [row] * len(own)
            hs += [k[0] for k in own]
            cs += [k[1] for k in own]
            offs += own.values()
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hs, pa.int64()), pa.array(cs, pa.int64()), pa.array(offs, pa.list_(pa.int32()))], ["_row", "h", "c", "offs"])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Orders strings that share a long prefix: inner nodes know only the depth at which their strings part and one byte a branch (-1: the string ends)."""

    def __init__(self, strings: list[bytes], first: int) -> None:
        self.strings, self.root = strings, first

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, new: int) -> None:
        s, node = self.strings[new], self.root
        while isinstance(node, tuple):  # blindly: bytes between branches are not compared
            node = node[1].get(self._byte(s, node[0])) if self._byte(s, node[0]) in node[1] else next(iter(node[1].values()))
        leaf = node[0] if isinstance(node, list) else node
        shared = common(s, self.strings[leaf])
        if shared == len(s) == len(self.strings[leaf]):
            depth = None
        else:
            depth = shared
        parent, key, node = None, None, self.root
        while isinstance(node, tuple) and (depth is None or node[0] < depth):
            parent, key = node, self._byte(s, node[0])
            node = node[1][key]
        if depth is None:
            put = [*node, new] if isinstance(node, list) else [node, new]
        elif isinstance(node, tuple) and node[0] == depth:
            node[1][self._byte(s, depth)] = new
            return
        else:
            put = (depth, {self._byte(self.strings[leaf], depth): node, self._byte(s, depth): new})
        if parent is None:
            self.root = put
        else:
            parent[1][key] = put

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out += node if isinstance(node, list) else [node]
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of the strings."""
    out, todo = [], [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) <= 1:
            out += group
        elif depth >= SHALLOW:
            trie = BlindTrie(strings, group[0])
            for x in group[1:]:
                trie.add(x)
            out += trie.order()
        else:
            keys = [strings[x][depth : depth + 8] for x in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            same = [x for x, k in zip(group, keys, strict=True) if k == pivot]
            todo.append(([x for x, k in zip(group, keys, strict=True) if k > pivot], depth))
            todo.append((same, depth + 8 if len(pivot) == 8 else SHALLOW))
            todo.append(([x for x, k in zip(group, keys, strict=True) if k < pivot], depth))
    return out


class Shared:
    """Common prefixes of one string with all others, from those of neighbours in order."""

    def __init__(self, strings: list[bytes]) -> None:
        self.order = np.array(deep_shallow(strings), np.int64)
        self.place = np.argsort(self.order)
        self.near = np.array([common(strings[a], strings[b]) for a, b in zip(self.order, self.order[1:], strict=False)], np.int32)

    def of(self, k: int) -> np.ndarray:
        """By string; 0 for k itself."""
        at, out = self.place[k], np.zeros(len(self.order), np.int32)
        out[self.order[at + 1 :]] = np.minimum.accumulate(self.near[at:])
        out[self.order[:at]] = np.minimum.accumulate(self.near[:at][::-1])[::-1]
        return out


def furthest(contexts: list[tuple[bytes, bytes]]) -> list[tuple[int, int]]:
    """For each context how many bytes before and behind the anchor go; (0, 0) for none."""
    left, right = Shared([a[::-1] for a, _ in contexts]), Shared([b for _, b in contexts])
    out = []
    for k in range(len(contexts)):
        a, b = left.of(k), right.of(k)
        on = a + b >= LENGTH
        out.append((int(a[on].max()), int(b[on].max())) if on.any() else (0, 0))
    return out


CONTEXTS = "_row long, h long, off int, size long, only boolean, before binary, behind binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_row", "h", "off", "size", "only", "before", "behind"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)
        out.clear()
        return made

    for b in batches:
        for row, text, wanted in zip(*b.columns, strict=True):
            row, data = row.as_py(), text.as_py().encode()
            for w in wanted.as_py():
                out.append((row, w["h"], w["off"], w["size"], w["only"], *context(data, w["off"])))
                if len(out) >= 4000:
                    yield flushed()
    yield flushed()


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal k-mers, at most GROUP contexts each, one after the other."""
    held, now = [], None

    def settle() -> list[tuple[int, int, int]]:
        found = furthest([(r[5], r[6]) for r in held])
        return [(r[0], r[2] - back, r[2] + ahead) for r, (back, ahead) in zip(held, found, strict=True) if r[4] and ahead]

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["_row", "start", "end"])

    for b in batches:
        rows = []
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[1] != now:
                rows += settle() if len(held) > 1 else []
                held, now = [], r[1]
            held.append(r)
        yield out(rows)
    yield out(settle() if len(held) > 1 else [])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, _, off, _, only, before, behind in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data, n = before + behind, len(before) + len(behind) - LENGTH + 1
            keys = [digest(data[k : k + LENGTH]) for k in range(n)]
            starts = np.arange(n) + off - len(before)
            yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([off] * n, pa.int32()), pa.array(starts, pa.int32()), pa.array([only] * n, pa.bool_()), pa.array(keys, pa.int64())], ["_row", "off", "start", "only", "key"])


def repeated(texts: DataFrame) -> DataFrame:
    """texts: _row, _t. _row, start, end: bytes that go, from each anchor's point of view; they overlap."""
    found = written(texts.mapInArrow(_scan, "_row long, h long, c long, offs array<int>"), "anchors")
    groups = found.groupBy("h").agg(F.sum(F.size("offs")).alias("n"), (F.min("c") != F.max("c")).alias("mixed")).filter("n > 1").select("h", "mixed")
    twice = written(found.join(written(groups, "kmers"), "h"), "anchors-twice")
    mixed = twice.filter("mixed").groupBy("h", "c").agg(F.sum(F.size("offs")).alias("n"), F.min("_row").alias("_row"), F.min_by(F.get("offs", F.lit(0)), "_row").alias("off"))
    mixed = written(mixed, "contexts")
    sizes = written(mixed.groupBy("h").agg(F.count(F.lit(1)).alias("size")), "kmer-sizes")
    whole = twice.filter("not mixed").select("_row", "offs").union(twice.filter("mixed").join(mixed.filter("n > 1").select("h", "c"), ["h", "c"]).select("_row", "offs"))
    # Ends beyond the text are cut off where bytes are removed.
    full = whole.select("_row", F.explode("offs").alias("off")).select("_row", F.greatest(F.col("off") - REACH, F.lit(0)).alias("start"), (F.col("off") + LENGTH).alias("end"))
    wanted = mixed.join(sizes, "h").groupBy("_row").agg(F.collect_list(F.struct("h", "off", "size", (F.col("n") == 1).alias("only"))).alias("wanted"))
    shown = written(texts.join(wanted, "_row").mapInArrow(_contexts, CONTEXTS), "context-bytes")
    few = shown.filter(F.col("size") <= GROUP).repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_groups, "_row long, start int, end int")
    windows = shown.filter(F.col("size") > GROUP).mapInArrow(_windows, "_row long, off int, start int, only boolean, key long")
    windows = written(windows, "windows")
    # Several anchors may show a window at the same place, which counts once.
    apart = (F.min("_row") != F.max("_row")) | (F.min("start") != F.max("start"))
    again = written(windows.groupBy("key").agg(apart.alias("apart")).filter("apart").select("key"), "windows-twice")
    # All windows of an anchor overlap: the outermost bound what goes.
    many = windows.filter("only").join(again, "key").groupBy("_row", "off").agg(F.min("start").alias("start"), (F.max("start") + LENGTH).alias("end")).drop("off")
    return full.union(few).union(many)


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return list(zip(start[first].tolist(), reach[np.r_[first[1:] - 1, len(start) - 1]].tolist(), strict=True))


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            out = []
            for text, spans in zip(b.column(2), b.column(3), strict=True):
                data, gone = text.as_py().encode(), []
                if spans.is_valid and len(spans):
                    start, end = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    gone = merged(start, np.minimum(end, len(data)))
                edges = [0, *[x for g in gone for x in g], len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if gone else data
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], ["_row", "_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: _row, id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, if asked for)."""
    kind = dict(docs.dtypes)[id_col]
    texts = keyed(docs, _id=F.col(id_col), _t=F.coalesce(F.col(text_col), F.lit("")))
    # A document's spans are at most its anchors.
    spans = repeated(texts.select("_row", "_t")).groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = texts.join(spans, "_row", "left").select("_row", "_id", "_t", "spans").mapInArrow(_remove(with_text), f"_row long, _id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("_id", id_col)
