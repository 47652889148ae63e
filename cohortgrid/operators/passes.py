"""Passes over rows of arrays: sums per key, and exact order statistics of many groups and features by counting.

Each pass is summed within tasks in NumPy and then per key behind a shuffle of a row per
task and key; what reaches the driver is set by groups x features, never by rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts that a range is counted in, values of a range that are sorted instead of counted, and bytes of counters that a task holds.
PARTS, GATHERED, HELD = 256, 1024, 256 << 20
#: The place of a missing value: below that of any other.
LEAST = np.iinfo(np.int64).min

Groups = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


def _rows(found: dict[int, np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(kind))], ["key", "v"])


def _collected(found: DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(key, v) of a pass's result, in one job and as Arrow: toLocalIterator() would work its partitions off one after another, a job each."""
    for b in found.toArrow().to_batches():
        for key, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            yield key, v.values.to_numpy()


def summed(rows: DataFrame, part: Groups) -> dict[int, np.ndarray]:
    """part(batch) yields (key, array); the arrays' sums per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for key, sums in part(b) if b.num_rows else ():
                found[key] = found[key] + sums if key in found else sums.astype(float)
        yield _rows(found, pa.float64())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for key, sums in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                new = sums.values.to_numpy()
                found[key] = found[key] + new if key in found else new
        yield _rows(found, pa.float64())

    sums = rows.mapInArrow(run, "key int, v array<double>").repartition("key").mapInArrow(add, "key int, v array<double>")
    return dict(_collected(sums))


def ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; NaN is LEAST."""
    i = (x + 0.0).view(np.int64)
    return np.where(np.isnan(x), LEAST, np.where(i < 0, i ^ np.int64(2**63 - 1), i))


def valued(o: int) -> float:
    i = np.array([o], np.int64)
    return float(np.where(i < 0, i ^ np.int64(2**63 - 1), i).view(np.float64)[0])


def ranges(rows: DataFrame, groups: Groups) -> dict[int, np.ndarray]:
    """key -> 3 x features: how many values there are, the least and the greatest, as ordered() integers."""

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for key, x in groups(b) if b.num_rows else ():
                if len(x):
                    o, there = ordered(x), ~np.isnan(x)
                    new = np.stack([there.sum(0), np.where(there, o, np.iinfo(np.int64).max).min(0), o.max(0)])
                    found[key] = joined(found[key], new) if key in found else new
        yield _rows({k: v.ravel() for k, v in found.items()}, pa.int64())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                new = v.values.to_numpy().reshape(3, -1)
                found[key] = joined(found[key], new) if key in found else new
        yield _rows({k: v.ravel() for k, v in found.items()}, pa.int64())

    out = rows.mapInArrow(run, "key int, v array<long>").repartition("key").mapInArrow(add, "key int, v array<long>")
    return {key: v.reshape(3, -1) for key, v in _collected(out)}


class _Range:
    """Values from low to high (ordered integers), n of them, and which ranks among them are asked for: (the rank asked for, its place here)."""

    def __init__(self, low: int, high: int, n: int, ranks: list[tuple[int, int]]) -> None:
        self.low, self.high, self.n, self.ranks = low, high, n, ranks
        self.shift = max(0, (high - low).bit_length() - (PARTS.bit_length() - 1))


def order_statistics(rows: DataFrame, groups: Groups, ranks: Callable[[int], list[int]], seen: dict[int, np.ndarray] | None = None) -> dict[int, list[np.ndarray]]:
    """key -> for each feature its values at ranks(n), counted from 1 among its n values. groups(batch) yields (key, rows x features), NaN where there is no value.

    Each pass counts the values of every range that holds a sought rank in PARTS parts and goes on with the parts that hold
    them; ranges of at most GATHERED values are sorted at last. So a pass shuffles counts, and no group is ever in one place.
    """
    seen = ranges(rows, groups) if seen is None else seen
    found: dict[tuple[int, int], dict[int, int]] = {}
    todo: dict[tuple[int, int], list[_Range]] = {}
    for key, (n, low, high) in seen.items():
        for f in np.flatnonzero(n):
            todo[key, int(f)] = [_Range(int(low[f]), int(high[f]), int(n[f]), [(r, r) for r in ranks(int(n[f]))])]
    while todo:
        for slot, own in list(todo.items()):
            for x in own:
                if x.low == x.high:
                    found.setdefault(slot, {}).update({asked: x.low for asked, _ in x.ranks})
            todo[slot] = [x for x in own if x.low < x.high]
        todo = {slot: own for slot, own in todo.items() if own}
        large = {slot: [x for x in own if x.n > GATHERED] for slot, own in todo.items()}
        large = {slot: own for slot, own in large.items() if own}
        if not large:
            break
        for slot, new in _counted(rows, groups, large):
            todo[slot] = [x for x in todo[slot] if x.n <= GATHERED] + new
    for slot, asked, o in _sorted(rows, groups, todo) if todo else ():
        found.setdefault(slot, {})[asked] = o
    return {key: [np.array([valued(found[key, f][r]) for r in ranks(int(n))]) if n else np.zeros(0) for f, n in enumerate(seen[key][0])] for key in seen}


def _inside(v: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that lie in a range, and in which; ranges are sorted and apart."""
    at = np.searchsorted(lows, v, "right") - 1
    own = (at >= 0) & (v <= highs[at])
    return v[own], at[own]


def _slots(todo: dict[tuple[int, int], list[_Range]]) -> tuple[list, dict[int, list]]:
    """The slots (key, feature), and per key its (number of the slot, feature, lows, highs, shifts), ranges in order."""
    slots, by = list(todo), {}
    for n, (key, f) in enumerate(slots):
        own = todo[key, f]
        own.sort(key=lambda x: x.low)
        by.setdefault(key, []).append((n, f, np.array([x.low for x in own], np.int64), np.array([x.high for x in own], np.int64), np.array([x.shift for x in own], np.uint64)))
    return slots, by


def _counted(rows: DataFrame, groups: Groups, todo: dict[tuple[int, int], list[_Range]]) -> Iterator[tuple[tuple[int, int], list[_Range]]]:
    """For each slot the parts of its ranges that hold a sought rank, in as many passes as the counters need."""
    pieces: list[dict] = [{}]
    for slot in sorted(todo, key=lambda s: s[::-1]):
        if pieces[-1] and 8 * PARTS * (sum(map(len, pieces[-1].values())) + len(todo[slot])) > HELD:
            pieces.append({})
        pieces[-1][slot] = todo[slot]
    for piece in pieces:
        slots, by = _slots(piece)
        sought = [[[r for _, r in x.ranks] for x in piece[s]] for s in slots]

        def run(batches: Iterator[pa.RecordBatch], by=by) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for key, x in groups(b) if b.num_rows else ():
                    o = np.ascontiguousarray(ordered(x).T) if key in by else None
                    for n, f, lows, highs, shifts in by.get(key, ()):
                        v, at = _inside(o[f], lows, highs)
                        part = ((v - lows[at]).view(np.uint64) >> shifts[at]).astype(np.int64)
                        new = np.bincount(at * PARTS + part, minlength=len(lows) * PARTS)
                        held[n] = held[n] + new if n in held else new
            at = [np.flatnonzero(h) for h in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(at, pa.list_(pa.int64())), pa.array([h[a] for h, a in zip(held.values(), at, strict=True)], pa.list_(pa.int64()))], ["key", "at", "n"])

        def pick(batches: Iterator[pa.RecordBatch], sought=sought) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for key, at, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    own = held.setdefault(key, np.zeros(len(sought[key]) * PARTS, np.int64))
                    own[at.values.to_numpy()] += n.values.to_numpy()
            out = {}
            for key, counts in held.items():
                upto = counts.reshape(-1, PARTS).cumsum(1)
                picked = []
                for i, ranks in enumerate(sought[key]):
                    for r in ranks:
                        part = int(np.searchsorted(upto[i], r))
                        picked += [part, int(upto[i][part - 1]) if part else 0, int(counts[i * PARTS + part])]
                out[key] = picked
            yield _rows(out, pa.int64())

        found = rows.mapInArrow(run, "key int, at array<long>, n array<long>").repartition("key").mapInArrow(pick, "key int, v array<long>")
        for key, v in _collected(found):
            slot, picked, new = slots[key], iter(v.tolist()), {}
            for i, x in enumerate(piece[slot]):
                for asked, rank in x.ranks:
                    part, before, n = next(picked), next(picked), next(picked)
                    low = x.low + (part << x.shift)
                    new.setdefault((i, part), _Range(low, min(x.high, low + (1 << x.shift) - 1), n, [])).ranks.append((asked, rank - before))
            yield slot, list(new.values())


def _sorted(rows: DataFrame, groups: Groups, todo: dict[tuple[int, int], list[_Range]]) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(slot, rank asked for, ordered value) of ranges with at most GATHERED values."""
    slots, by = _slots(todo)
    sought = [[(x.low, x.high, [r for _, r in x.ranks]) for x in todo[s]] for s in slots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[int, np.ndarray] = {}
            for key, x in groups(b) if b.num_rows else ():
                o = np.ascontiguousarray(ordered(x).T) if key in by else None
                for n, f, lows, highs, _ in by.get(key, ()):
                    v, _ = _inside(o[f], lows, highs)
                    if len(v):
                        held[n] = v
            yield _rows(held, pa.int64())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(key, []).append(v.values.to_numpy())
        out = {}
        for key, parts in held.items():
            v = np.sort(np.concatenate(parts))
            out[key] = [int(v[np.searchsorted(v, low) + r - 1]) for low, _, ranks in sought[key] for r in ranks]
        yield _rows(out, pa.int64())

    for key, own in _collected(rows.mapInArrow(run, "key int, v array<long>").repartition("key").mapInArrow(pick, "key int, v array<long>")):
        slot, values = slots[key], iter(own.tolist())
        for x in todo[slot]:
            for asked, _ in x.ranks:
                yield slot, asked, next(values)
