"""Information-theoretic sanitisation of personal data.

Protected entities are the base findings (e-mail and IP addresses, card and phone
numbers) and secrets: runs of SECRET letters and digits or more whose characters
carry BITS of information (length times the entropy of its characters), as keys
and tokens do and words don't. An entity counts by its value, by its attribute
(an e-mail's host, an address's network, a number's first six digits) and by its
kind, as most values stand in one document only. Terms are the words of four
letters or more up to WINDOW words around one. Over all documents, D of them:
n(t) hold the term, n(e) the entity, n(e,t) the term near the entity. With IC(e)
= log2(D / n(e)) and PMI(e,t) = log2(D n(e,t) / (n(e) n(t))), a term discloses the
entity if PMI >= DISCLOSES * IC and n(e,t) >= SUPPORT: it hardly occurs without
that entity. Such terms become further spans, of kind "term", as secrets are of
kind "secret"; sanitised() generalises base spans and secrets to their kind and
removes disclosing terms.

Scale: one pass over the text writes two narrow tables: findings per document,
and each task's document counts of terms, summed in the task (in blocks of
BLOCK) before any shuffle. Joins on (entity, term) read written tables, so Spark
can split an entity that a third of the documents hold. Searches take time in
proportion to the text: no pattern can start again and again inside one run.

Cases: null text counts as empty: no spans; terms and secrets inside another
span are left out; repeated rows each count and get their row; an empty table
gives no rows; other columns are not looked at. Documents without an entity have
no spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, keyed, written

# The kinds in the order of equal starts.
KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, TOLD = 4, 5

#: Words before and behind an entity; share of IC that PMI must reach; documents that must hold both.
WINDOW, DISCLOSES, SUPPORT = 8, 0.9, 3
#: Characters of a secret, and the bits they carry, at least.
SECRET, BITS = 20, 64
#: Terms a task counts before it passes the counts on.
BLOCK = 1_000_000

# Where a match can begin is narrowed so that failing costs no more than reading; the matches are those of the plain patterns.
EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]*+")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{4,}")
NEAR = re.compile(r"\S+")
RUN = re.compile(rf"[A-Za-z0-9]{{{SECRET},}}+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match has one @; what stands left of it runs back to the last match or the first other character."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL_RIGHT.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        # Nothing before this @ can be part of a later match, whose left side can't hold an @.
        done = m.end() if m else at + 1
        at = text.find("@", done)


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """start, kind number, end, normalised value."""
    found = [(s, 0, e, text[s:e].translate(LOWER)) for s, e in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end(), m.group()))
    for kind, pattern, low, high in ((2, CARD, 12, 19), (3, PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = "".join(DIGITS.findall(m.group()))
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                found.append((m.start(), kind, m.end(), digits))
    return sorted(found)


def information(run: str) -> float:
    """Bits: the run's length times the entropy of its characters."""
    return sum(n * log2(len(run) / n) for n in Counter(run).values())


def secrets(text: str, found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Runs of letters and digits, both in them, outside base spans; as entities() gives."""
    out = []
    for m in RUN.finditer(text):
        run = m.group()
        if not run.isalpha() and not run.isdigit() and information(run) >= BITS and not any(s < m.end() and m.start() < e for s, _, e, _ in found):
            out.append((m.start(), 4, m.end(), run))
    return out


def names(kind: int, value: str) -> list[str]:
    """What an entity counts as: its kind, its attribute and its value."""
    attribute = (value.rpartition("@")[2], value.rpartition(".")[0], value[:6], value[:6], "")[kind]
    return [KINDS[kind], *([f"{KINDS[kind]}~{attribute}"] if attribute else []), f"{KINDS[kind]}:{value}"]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def contexts(text: str, found: list[tuple[int, int, int, str]]) -> dict[tuple[str, str], list[tuple[int, int]]]:
    """(entity, term) to the places of the term near the entity; terms in spans are left out."""
    words = [(m.start(), m.end()) for m in NEAR.finditer(text)]
    ends = [e for _, e in words]
    reach = list(accumulate((e for _, _, e, _ in found), max))  # the furthest end of the spans so far
    starts = [s for s, _, _, _ in found]
    near: dict[tuple[str, str], dict[tuple[int, int], None]] = {}
    for s, kind, e, value in found:
        first, last = bisect_right(ends, s), bisect_left(ends, e)
        low, high = words[max(0, first - WINDOW)][0], words[min(len(words) - 1, last + WINDOW)][1]
        for m in TERM.finditer(text, low, high):
            before = bisect_left(starts, m.end())
            if not before or reach[before - 1] <= m.start():
                for name in names(kind, value):
                    near.setdefault((name, m.group().lower()), {})[m.span()] = None
    return {k: list(v) for k, v in near.items()}


SPANS = "array<struct<start:int,kind:int,end:int>>"
PLACES = "array<struct<entity:string,h:bigint,places:array<struct<start:int,end:int>>>>"
PASS = f"_row long, _id {{}}, n array<long>, found {SPANS}, base_sha256 string, near {PLACES}, h long, docs long"


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span, place = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]), pa.struct([("start", pa.int32()), ("end", pa.int32())])
    near_t = pa.list_(pa.struct([("entity", pa.string()), ("h", pa.int64()), ("places", pa.list_(place))]))
    kind, counts = pa.int64(), Counter()

    def rows(own: list[list], terms: list[tuple[int, int]]) -> pa.RecordBatch:
        kinds = [pa.int64(), kind, pa.list_(pa.int64()), pa.list_(span), pa.string(), near_t, pa.int64(), pa.int64()]
        all_rows = [*[(*r, None, None) for r in own], *[(None,) * 6 + t for t in terms]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in all_rows], t) for k, t in enumerate(kinds)], ["_row", "_id", "n", "found", "base_sha256", "near", "h", "docs"])

    def flush() -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        counts.clear()
        for k in range(0, len(items), 50_000):
            yield rows([], [(term_hash(t), n) for t, n in items[k : k + 50_000]])

    for b in batches:
        kind, own = b.schema.field(1).type, []
        for row, key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            text = value.as_py() or ""
            counts.update({t.lower() for t in TERM.findall(text)})
            found = entities(text)
            base = [(s, k, e) for s, k, e, _ in found]
            found = sorted(found + secrets(text, found))
            near = [(e, term_hash(t), [{"start": a, "end": z} for a, z in p]) for (e, t), p in contexts(text, found).items()] if found else []
            near += [(e, None, []) for e in sorted({n for _, k, _, v in found for n in names(k, v)})]
            own.append([row, key, [sum(k == n for _, k, _, _ in found) for n in range(TOLD)], [{"start": s, "kind": k, "end": e} for s, k, e, _ in found], hashlib.sha256(joined(base).encode()).hexdigest(), [dict(zip(("entity", "h", "places"), x, strict=True)) for x in near]])
            if len(counts) >= BLOCK:
                yield from flush()
        yield rows(own, [])
    yield from flush()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _row, id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, all_spans (start, kind number, end)."""
    kind = dict(docs.dtypes)[id_col]
    scanned = written(keyed(docs, _id=F.col(id_col), _t=F.col(text_col)).mapInArrow(_scan, PASS.format(kind)), "pii")
    found = scanned.filter("_row is not null")
    near = found.select("_row", F.inline("near"))
    # One row: the number of documents.
    total = found.agg(F.count(F.lit(1)).alias("d")).withColumn("one", F.lit(1))
    n_e = near.filter("h is null").groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    n_et = near.filter("h is not null").groupBy("entity", "h").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= SUPPORT)
    n_t = scanned.filter("docs is not null").select("h", "docs").groupBy("h").agg(F.sum("docs").alias("n_t"))
    known = written(n_et, "pii-pairs").join(n_t, "h").join(n_e, "entity").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    bits = F.log2(F.col("d") * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    telling = written(known.filter(bits >= DISCLOSES * F.log2(F.col("d") / F.col("n_e")) - 1e-9).filter("n_e < d").select("entity", "h"), "pii-telling")
    terms = near.filter("h is not null").join(telling, ["entity", "h"]).select("_row", F.inline("places")).select("_row", "start", F.lit(TOLD).alias("kind"), "end").distinct()
    terms = terms.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("terms"))
    spans = F.array_sort(F.concat("found", F.coalesce("terms", F.expr(f"cast(array() as {SPANS})"))))
    text = F.transform("all_spans", lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"], x["end"]))
    every = found.select("_row", "_id", "n", "found", "base_sha256").join(terms, "_row", "left").withColumn("all_spans", spans)
    return every.select(
        "_row", F.col("_id").alias(id_col), *[F.col("n")[k].alias(f"n_{KINDS[k]}") for k in range(BASE)], "base_sha256", F.array_join(text, ",").alias("spans"),
        F.col("n")[BASE].alias("n_secret"), (F.size("all_spans") - F.size("found")).alias("n_term"), "all_spans",
    )


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for value, spans in zip(b.column(1), b.column(2), strict=True):
            text, parts, at = value.as_py(), [], 0
            for x in spans.as_py():
                if x["start"] >= at:
                    parts += [text[at : x["start"]], f"[{KINDS[x['kind']].upper()}]" if x["kind"] < TOLD else ""]
                at = max(at, x["end"])
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["_row", "sanitised"])


def sanitised(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """docs: the stable() table that found was made of. _row, sanitised: base spans and secrets become [EMAIL], [IP], [CARD], [PHONE] or [SECRET], disclosing terms go."""
    texts = keyed(docs, _t=F.coalesce(F.col(text_col), F.lit("")))
    return texts.join(found.select("_row", "all_spans"), "_row").select("_row", "_t", "all_spans").mapInArrow(_replace, "_row long, sanitised string")
