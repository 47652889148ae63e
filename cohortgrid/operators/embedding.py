"""Principal components of rows that stay distributed, by a randomised block Krylov method.

rows: sample_id, x (array<double>, no missing values). A random block of directions is
multiplied by the rows' scatter matrix again and again, each time by one pass over blocks
of rows (X'(XQ), summed within tasks, then per task); every new block is made orthogonal
to the ones before. Within their span the scatter matrix is small and is solved on the
driver, and how far its vectors still are from the whole matrix's is known without another
pass, so that passes stop when that is small. The driver and each task hold features x
block numbers, never rows x anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .contracts import fail


@dataclass
class Components:
    """weights: features x k, of each column the largest number in size positive. variance and share (of all variance) per component."""

    mean: np.ndarray
    weights: np.ndarray
    variance: np.ndarray
    share: np.ndarray
    passes: int


def _total(rows: DataFrame, part, width: int) -> np.ndarray:
    """The sum over tasks of part(block of rows): a row per task is added up in two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += part(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["t"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += b.column(0).flatten().to_numpy().reshape(b.num_rows, width).sum(0) if b.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["t"])

    parts = rows.select("x").mapInArrow(run, "t array<double>")
    return np.sum([np.array(r["t"]) for r in parts.coalesce(16).mapInArrow(add, "t array<double>").collect()], axis=0)


def principal_components(rows: DataFrame, k: int, extra: int = 10, tolerance: float = 1e-8, most_passes: int = 40, seed: int = 0) -> Components:
    spark, first = rows.sparkSession, rows.first()
    if first is None:
        fail("no rows to embed")
    d = len(first["x"])
    sums = _total(rows, lambda x: np.concatenate([[len(x)], x.sum(0)]), 1 + d)
    n, mean = sums[0], sums[1:] / sums[0]
    if not np.isfinite(mean).all():
        fail("a missing value; impute first")
    if k > min(d, n):
        fail(f"{k} components of {d} features and {int(n)} rows")
    whole = _total(rows, lambda x: ((x - mean) ** 2).sum(0), d).sum()
    block = min(d, k + extra)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = np.random.default_rng(seed).normal(size=(d, block))
    for passes in range(1, most_passes + 1):
        for _ in range(2):  # twice, for the sake of rounding
            new = new - basis @ (basis.T @ new)
            new, r = np.linalg.qr(new)
            new = new[:, np.abs(np.diag(r)) > 1e-10 * max(np.abs(np.diag(r)).max(initial=0), 1e-300)]
        if new.shape[1]:
            sent = spark.sparkContext.broadcast(new)  # features x block
            image = np.hstack([image, _total(rows, lambda x, sent=sent: ((x - mean).T @ ((x - mean) @ sent.value)).ravel(), d * new.shape[1]).reshape(d, -1)])
            sent.destroy()
            basis = np.hstack([basis, new])
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        off = np.linalg.norm(image @ vectors - (basis @ vectors) * values, axis=0)
        if not new.shape[1] or basis.shape[1] >= d or (off <= tolerance * max(values[0], 1e-300)).all():
            break
        new = image[:, -new.shape[1] :]
    else:
        fail(f"components didn't settle in {most_passes} passes")
    weights = basis @ vectors
    weights = weights * np.sign(weights[np.abs(weights).argmax(0), range(k)])
    return Components(mean, weights, np.maximum(values, 0) / max(n - 1, 1), np.maximum(values, 0) / whole if whole > 0 else np.zeros(k), passes)


def project(rows: DataFrame, found: Components, *keep: str) -> DataFrame:
    """keep, component (from 0), score, share."""
    kinds, k = dict(rows.dtypes), found.weights.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(found)  # features x k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            if b.num_rows:
                scores = (b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) - own.mean) @ own.weights
                again = pa.array(np.repeat(np.arange(b.num_rows), k))
                yield pa.RecordBatch.from_arrays([*[c.take(again) for c in b.columns[1:]], pa.array(np.tile(np.arange(k, dtype=np.int32), b.num_rows)), pa.array(scores.ravel()), pa.array(np.tile(own.share, b.num_rows))], [*keep, "component", "score", "share"])

    return rows.select("x", *keep).mapInArrow(run, "".join(f"{c} {kinds[c]}, " for c in keep) + "component int, score double, share double")
