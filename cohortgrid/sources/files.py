"""Small files that aren't tables: saved scores, configurations, sheets, tar listings, stores that are read back, models that are checked.

All are read through Spark's own readers, so any store that Spark reaches will do.
Archives of arrays and sheets are small and parsed one file at a time on the executors.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import close, fail, none_of, same_keys, unique_key


#: Bytes of a long name's or extended header's text at most.
MAX_HEADER = 1 << 20


def _parsed(spark: SparkSession, path: str, schema: str, rows_of) -> DataFrame:
    """Rows that rows_of(path, content) yields for each file, as tuples in the order of the schema."""
    kinds = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kinds)
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                rows = list(rows_of(file.as_py(), content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _npz_rows(file: str, content: bytes):
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        ids, classes, proba = (z[k] for k in ("sample_ids", "classes", "proba"))
        if proba.shape != (len(ids), len(classes)):
            raise ValueError(f"ERROR: {file}: scores of shape {proba.shape} for {len(ids)} samples and {len(classes)} classes")
        for i, c in zip(*(x.ravel() for x in np.indices(proba.shape)), strict=True):
            yield file, str(ids[i]), str(classes[c]), float(proba[i, c])


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Saved scores (npz with sample_ids, classes, proba): path, sample_id, class, p."""
    return _parsed(spark, path, "path string, sample_id string, class string, p double", _npz_rows)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "[" and text[-1:] == "]":
        return "[" + ", ".join(x.strip().strip("'\"") for x in text[1:-1].split(",")) + "]"
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A YAML file of nested mappings, scalars and lists: key (joined by dots, list items by number), value (text). Anchors, tags and block texts are refused."""

    def rows(file: str, content: bytes):
        stack: list[tuple[int, str]] = []
        items: dict[str, int] = {}
        for line in content.decode().splitlines():
            body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
            if not body.strip() or body.strip() == "---":
                continue
            depth, body = len(body) - len(body.lstrip()), body.strip()
            if re.search(r":\s*[|>&*!]", body) or body.startswith(("&", "*", "!", "{")):
                raise ValueError(f"ERROR: {file}: {body!r} isn't in the plain form that is read")
            dash = body.startswith("- ")
            while stack and (stack[-1][0] > depth or stack[-1][0] == depth and not (dash and not stack[-1][1].isdigit())):
                stack.pop()
            if dash:
                parent = ".".join(k for _, k in stack)
                items[parent] = items.get(parent, -1) + 1
                stack.append((depth, str(items[parent])))
                body = body[2:].strip()
                depth += 2
            key, colon, value = body.partition(":")
            if not colon or not (value == "" or value[0] == " "):
                yield file, ".".join(k for _, k in stack), _scalar(body)
                continue
            stack.append((depth, key.strip().strip("'\"")))
            if value.strip():
                yield file, ".".join(k for _, k in stack), _scalar(value)

    return _parsed(spark, path, "path string, key string, value string", rows)


def read_sheet(spark: SparkSession, path: str, columns: dict[int, str], header_rows: int = 1, sheet: int = 1) -> DataFrame:
    """An XLSX sheet by column position (from 0): row (from 1), and the columns as text, under the names given; header rows are left out."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def rows(file: str, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{ns}row"):
                number, cells = int(row.get("r")), {}
                if number <= header_rows:
                    continue
                for c in row.iter(f"{ns}c"):
                    at = 0
                    for letter in re.match("[A-Z]+", c.get("r")).group():
                        at = 26 * at + ord(letter) - 64
                    v = c.find(f"{ns}v")
                    text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    cells[at - 1] = text
                yield (number, *[cells.get(k) for k in columns])

    return _parsed(spark, path, "row int, " + ", ".join(f"`{c}` string" for c in columns.values()), rows)


def tar_entries(spark: SparkSession, path: str, allowed: str) -> DataFrame:
    """Entries of tar files: path, name, size, ok (a plain file whose name matches the whole pattern and stays inside the folder). Use refuse_entries() before anything is unpacked."""

    def rows(file: str, content: bytes):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                inside = not m.name.startswith("/") and ".." not in m.name.split("/")
                yield file, m.name, m.size, bool(m.isfile() and inside and re.fullmatch(allowed, m.name))

    return _parsed(spark, path, "path string, name string, size long, ok boolean", rows)


def walk_tar(read, length: int) -> Iterator[tuple[str, int, bool]]:
    """(name, size, whether it is a plain file) of a tar's entries, from its headers alone. read(position, n) gives bytes of it; what lies between headers is never read, but for long names."""
    at, name, size = 0, None, None
    while at + 512 <= length:
        header = read(at, 512)
        if not header.strip(b"\0"):
            return
        entry = tarfile.TarInfo.frombuf(header, "utf-8", "surrogateescape")
        at += 512
        if entry.type in (tarfile.GNUTYPE_LONGNAME, tarfile.XHDTYPE, tarfile.XGLTYPE, tarfile.GNUTYPE_LONGLINK):
            if entry.size > MAX_HEADER:
                raise ValueError(f"ERROR: a header of {entry.size} bytes")
            told = read(at, entry.size)
            if entry.type == tarfile.GNUTYPE_LONGNAME:
                name = told.rstrip(b"\0").decode("utf-8", "surrogateescape")
            elif entry.type == tarfile.XHDTYPE:
                while told.strip(b"\0"):
                    n = int(told[: told.index(b" ")])
                    key, _, value = told[told.index(b" ") + 1 : n - 1].decode("utf-8", "surrogateescape").partition("=")
                    name, size, told = value if key == "path" else name, int(value) if key == "size" else size, told[n:]
            at += -(-entry.size // 512) * 512
            continue
        own = entry.size if size is None else size
        if at + own > length:
            raise ValueError(f"ERROR: the archive ends inside {entry.name!r}")
        yield entry.name if name is None else name, own, entry.isfile()
        at, name, size = at + (-(-own // 512) * 512 if entry.isfile() else 0), None, None


def tar_index(spark: SparkSession, path: str, allowed: str) -> DataFrame:
    """tar_entries() of one tar of any size: headers are read one by one through the file system, not the members between them (binaryFile holds 2 GB at most). A row per entry is all that the driver holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream, utils = fs.open(p), spark._jvm.org.apache.commons.io.IOUtils

    def read(at: int, n: int) -> bytes:
        stream.seek(at)
        return bytes(utils.toByteArray(stream, n))

    try:
        found = list(walk_tar(read, fs.getFileStatus(p).getLen()))
    finally:
        stream.close()
    inside = lambda name: not name.startswith("/") and ".." not in name.split("/")
    rows = [(path, name, size, bool(plain and inside(name) and re.fullmatch(allowed, name))) for name, size, plain in found]
    return spark.createDataFrame(rows, "path string, name string, size long, ok boolean")


def refuse_entries(entries: DataFrame) -> DataFrame:
    none_of(entries.filter("not ok"), "an entry that isn't allowed")
    return entries


def export_by_key(annotation: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The annotation of the wanted keys; keys that repeat or are unknown fail."""
    unique_key(annotation, key)
    none_of(wanted.select(key).join(annotation.select(key), key, "left_anti"), f"a {key} without annotation")
    return wanted.select(key).join(annotation, key)


def write_store(cells: DataFrame, path: str, block: int = 64) -> None:
    """Cells as a store whose blocks of probes are folders, so that a range of probes reads its blocks only. The last block is read back and compared."""
    rows = cells.withColumn("block", F.floor(F.col("probe") / block).cast("int"))
    rows.repartition("block").sortWithinPartitions("probe", "sample_id").write.partitionBy("block").parquet(path)
    last = rows.agg(F.max("block")).first()[0]
    if last is None:
        return
    wrote, back = rows.filter(F.col("block") == last), cells.sparkSession.read.parquet(path).filter(F.col("block") == last)
    sums = [F.count(F.lit(1)), F.sum(F.xxhash64("sample_id", "probe", F.col("beta").cast("double")).cast("decimal(38,0)"))]
    if wrote.agg(*sums).first() != back.agg(*sums).first():
        fail(f"{path}: the last block doesn't read back as it was written")


def read_store(spark: SparkSession, path: str, low: int, high: int, block: int = 64, columns: list[str] = ()) -> DataFrame:
    """Cells of probes low to high (inclusive): folders of other blocks are not opened, other columns are not read, and probes are filtered in the scan."""
    df = spark.read.parquet(path).filter(F.col("block").between(low // block, high // block) & F.col("probe").between(low, high))
    return df.select(*columns) if columns else df.drop("block")


def open_lookups(rows: DataFrame, columns: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A store's two lookups (row, sample_id and col, probe), once both are unique, dense from 0 and hold the keys of the cells."""
    for lookup, index, key in ((rows, "row", "sample_id"), (columns, "col", "probe")):
        unique_key(lookup, key)
        unique_key(lookup, index)
        r = lookup.agg(F.min(index), F.max(index), F.count(F.lit(1))).first()
        if r[2] and (r[0] != 0 or r[1] != r[2] - 1):
            fail(f"{index} isn't dense from 0")
        same_keys(lookup, cells.select(key).distinct(), key)
    return rows, columns


def save_checked(model: DataFrame, path: str, scores_of, key: str, value: str, most: float = 1e-5) -> DataFrame:
    """Writes a fitted table, reads it again, and compares the scores that both give; returns the reread table."""
    model.write.mode("errorifexists").parquet(path)
    again = model.sparkSession.read.parquet(path)
    close(scores_of(model), scores_of(again), key, value, most)
    return again
