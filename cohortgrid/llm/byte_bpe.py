"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks of CHUNK code points that read OVERLAP further on.
Each chunk is pre-tokenised and its pieces encoded by itself, starting wherever
the cut fell. The pattern never looks back, so from any position where two
neighbouring chunks both begin a pre-token they agree; they are stitched at the
first such position of their overlap. Where an overlap has none (one pre-token
longer than the overlap), the document is encoded whole instead. Decoding
concatenates the tokens' bytes.

Scale: a text of up to LONG code points has its chunks encoded and stitched in
the task that reads it. Chunks of longer ones are spread over the tasks, and only
their ids and the pre-token ends of their overlaps are brought together, in
order, as a stream. Pre-tokens' ids are remembered in a bounded table. The file
of ranks is sent along by Spark (addFile).

Cases: null text counts as empty: no tokens, digests of nothing; repeated rows
each get their row; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache, reduce
from pathlib import PurePath

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, written

#: Code points a chunk advances, and how far it reads on into the next; code points from which a text's chunks are spread.
CHUNK, OVERLAP, LONG = 4_000, 400, 40_000
#: Chunks of a text that are cut off at once.
CUT = 64
#: What a pre-token's end may depend on behind it (the longest contraction).
LOOK = 4
#: Pre-tokens whose ids a worker remembers.
REMEMBER = 150_000

#: What encoding returns, with the input's own columns _row and _id.
OUT = "_row long, _id {}, n_tokens long, ids_sha256 string, decoded_sha256 string"
NAMES = ["_row", "_id", "n_tokens", "ids_sha256", "decoded_sha256"]


class Coder(dict):
    """Pre-token to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        """ranks_path: a local file."""
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, n in ranks.items():
            self.bytes_of[n] = piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) > REMEMBER:
            self.clear()
        ids = self.core._encode_single_piece(piece)
        self[piece] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def coder(ranks: str, pattern: str) -> Coder:
    """ranks: a file that addFile() has sent."""
    return Coder(SparkFiles.get(ranks), pattern)


def n_chunks(n: int) -> int:
    """Chunks of a text of n code points."""
    return max(1, -((OVERLAP - n) // CHUNK))


def coded(own: Coder, text: str) -> tuple[bytes, bytes, bytes, int]:
    """A chunk's ids; of the pre-tokens that end in its overlaps the ends (from the chunk's start) and the ids so far; where its last run of white space begins, as the text may go on with more."""
    pieces = own.split.findall(text)
    ids = [own[p] for p in pieces]
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)), dtype=np.int32)
    counts = np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)), dtype=np.int32) // 4
    near = (ends <= OVERLAP) | (ends >= CHUNK)
    return b"".join(ids), ends[near].astype("<i4").tobytes(), counts[near].astype("<i4").tobytes(), len(text.rstrip())


class Stitcher:
    """Takes a document's chunks in order."""

    def __init__(self, own: Coder) -> None:
        self.own, self.ids, self.decoded, self.n = own, hashlib.sha256(), hashlib.sha256(), 0
        self.start, self.held, self.failed = 0, None, False

    def _emit(self, stop: int | None) -> None:
        part = self.held[0][4 * self.start : None if stop is None else 4 * stop]
        self.ids.update(part)
        self.decoded.update(self.own.decode(part))
        self.n += len(part) // 4

    def feed(self, ids: bytes, ends: bytes, counts: bytes, upto: int) -> None:
        chunk = (ids, np.frombuffer(ends, "<i4"), np.frombuffer(counts, "<i4"), upto)
        if self.held is not None and not self.failed:
            # Ends in this chunk's count; the old chunk's last ends may be due to its cut.
            _, ends, counts, upto = self.held
            sure = (ends >= CHUNK) & (ends <= upto - LOOK)
            _, a, b = np.intersect1d(ends[sure] - CHUNK, chunk[1], assume_unique=True, return_indices=True)
            here = np.flatnonzero(sure & (ends == CHUNK))
            if len(here):  # both begin a pre-token where this chunk begins
                self._emit(int(counts[here[0]]))
                self.start = 0
            elif len(a):
                self._emit(int(counts[sure][a[0]]))
                self.start = int(chunk[2][b[0]])
            else:
                self.failed = True
        self.held = chunk

    def row(self) -> tuple:
        if self.failed:
            return None, None, None
        self._emit(None)
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


def whole(own: Coder, text: str) -> tuple:
    """Without chunks."""
    ids = own.encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()


def stitched(own: Coder, text: str) -> tuple:
    """All chunks of a text, and the text as a whole where they don't resynchronise."""
    doc = Stitcher(own)
    for k in range(n_chunks(len(text))):
        doc.feed(*coded(own, text[k * CHUNK : (k + 1) * CHUNK + OVERLAP]))
    return whole(own, text) if doc.failed else doc.row()


def _texts(encode, ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        for b in batches:
            out = [encode(own, x.as_py()) for x in b.column(2)]
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], NAMES)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's chunks in one walk over it, a few at a time."""
    for b in batches:
        for k in range(b.num_rows):
            text = b.column(2)[k].as_py()
            n = n_chunks(len(text))
            for first in range(0, n, CUT):
                at = range(first, min(first + CUT, n))
                chunks = pa.array([text[i * CHUNK : (i + 1) * CHUNK + OVERLAP] for i in at], pa.string())
                again = pa.array([k] * len(at), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(again), b.column(1).take(again), pa.array(at, pa.int32()), chunks], ["_row", "_id", "at", "chunk"])


def _chunks(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        for b in batches:
            out = [coded(own, x.as_py()) for x in b.column(3)]
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], ["_row", "_id", "at", "ids", "ends", "counts", "upto"])

    return run


def _stitch(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, doc, done, kind = coder(ranks, pattern), None, None, [], pa.int64()
        for b in batches:
            kind = b.schema.field(1).type
            for k in range(b.num_rows):
                row = (b.column(0)[k].as_py(), b.column(1)[k].as_py())
                if row != now:
                    if doc is not None:
                        done.append((*now, *doc.row()))
                    now, doc = row, Stitcher(own)
                doc.feed(*(b.column(c)[k].as_py() for c in range(3, 7)))
        if doc is not None:
            done.append((*now, *doc.row()))
        kinds = [pa.int64(), kind, pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], NAMES)

    return run


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256. ranks_path: a file that the driver can read."""
    docs.sparkSession.sparkContext.addFile(ranks_path)
    ranks, kind = PurePath(ranks_path).name, dict(docs.dtypes)[id_col]
    rows = keyed(docs, _id=F.col(id_col), _t=F.coalesce(F.col(text_col), F.lit("")))
    short, long = rows.filter(F.length("_t") <= LONG), rows.filter(F.length("_t") > LONG)
    chunks = long.mapInArrow(_cut, f"_row long, _id {kind}, at int, chunk string").repartition("_row", "at")
    parts = chunks.mapInArrow(_chunks(ranks, pattern), f"_row long, _id {kind}, at int, ids binary, ends binary, counts binary, upto long")
    ordered = parts.repartition("_row").sortWithinPartitions("_row", "at")
    spread = written(ordered.mapInArrow(_stitch(ranks, pattern), OUT.format(kind)), "bpe-long")
    again = spread.filter("n_tokens is null").select("_row")
    made = [short.mapInArrow(_texts(stitched, ranks, pattern), OUT.format(kind)), spread.filter("n_tokens is not null")]
    if not again.isEmpty():
        made.append(long.join(again, "_row", "left_semi").mapInArrow(_texts(whole, ranks, pattern), OUT.format(kind)))
    return reduce(DataFrame.unionAll, made).select(F.col("_id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
