"""Conversation structure repair: the cheapest edits that turn a conversation's roles into (s?(ua)+)?.

damage() makes faults by a hash of conversation and turn; repair() finds what is wrong
in any rows and the cheapest edits: keep (0), change the role to user or assistant (2),
delete (3), insert an empty turn of user or assistant (2); a truncated turn that stays
costs 1 more; blank and repeated turns must go. Of equally cheap edits the ones whose
initials (K, R, D, I) come first in ASCII are taken.

The grammar has four states, and from each a change or an insertion leads to one state
only, so an edit's initial determines it. The costs of all states to the end are
computed turn by turn from the back, for all conversations of about the same length at
once (NumPy arrays of turn x conversation x state); the edits are then traced forward
from the stored costs, again for all at once.

Scale: rows are dealt out by ranges of (conversation, turn, row), so a conversation
with a third of all rows is spread over many tasks. A task solves the conversations that
lie inside its range and cuts others, and very long ones, into blocks of at most
BLOCK_ROWS turns. A block's costs from every state to every state are a 4 x 4 matrix;
matrices are chained from the back (16 numbers a block), blocks are traced in parallel
from all four states, and one stream per conversation picks the traces that fit and
hashes the repaired turns, a block in memory at a time. That last hash is sequential by
its definition, so the cut conversations' texts pass one task each. First places of
equal turns come from pre-aggregated counts and a join, not from a window.

Cases: null role or text is one space, a null id or turn in the hash too; a null id is
a conversation of its own; null turns come first; rows with equal turns stay in the
order of the table (file and row); repeated rows are repeated turns; a conversation
that has lost all rows has zeros, no edits and the hash of the empty string; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, written

BLANK, REPEATED, TRUNCATED = 1, 2, 3
#: White space, as the contract lists it.
SPACE = " \t\n\v\f\r"
#: Turns and bytes of a block at most, and turns and bytes that are solved at once.
BLOCK_ROWS, BLOCK_BYTES, SOLVE_ROWS, SOLVE_BYTES = 4096, 4 << 20, 50_000, 16 << 20

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
NEVER = 1 << 40
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Role codes: 0 s, 1 u, 2 a, 3 any other.
#: Where a change of role or an insertion leads, by state.
NEXT = np.array([2, 2, 3, 2])
#: Where a kept turn leads, by state and role code; -1: nowhere.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Costs at the end of a conversation, by state.
END = np.array([0, 2 * INSERT, INSERT, 0])
LETTERS = np.frombuffer(b"DIKR", np.uint8)
NAMES = {2: "user", 3: "assistant"}


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, id (the row's place, twice, plus 1 for a copy), gone (dropped rows stay as marks, so that every conversation is known)."""
    kind = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.pmod(F.crc32(F.concat(kind("conv"), F.lit(":"), kind("turn"))), F.lit(20))
    rows = keyed(turns, conv=F.col(conv_col), turn=F.col(turn_col), role=kind(role_col), text=kind(text_col)).withColumn("_act", act)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), (F.col("_act") == 3).cast("int"))))
    is_ = lambda k: F.col("_act") == k
    return rows.select(
        "conv", "turn", F.when(is_(4), "user").otherwise(F.col("role")).alias("role"),
        F.when(is_(0) | is_(1), "").when(is_(2), F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_row") * 2 + F.col("_copy")).alias("id"), is_(0).alias("gone"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (as of damage()) with code (of the role's initial) and fault: the first of blank, repeated, truncated that holds, else 0."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumns({"_key": digest, "_at": F.struct("turn", "id")})
    several = rows.filter(~F.col("gone")).groupBy(F.col("conv").alias("_conv"), F.col("_key").alias("_same")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    met = rows.join(several, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("_key") == F.col("_same")), "left")
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(F.col("_n").isNotNull() & ~F.col("_at").eqNullSafe(F.col("_first")), REPEATED).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return met.select("conv", "turn", "id", "gone", code.alias("code"), fault.alias("fault"), "role", "text")


# The arrays: code and fault are turn x conversation, costs turn x conversation x state (x columns of ends).


def costs(code: np.ndarray, fault: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(T + 1) x B x 4 x E: the least cost from each state before turn t to the end; end: B x 4 x E, what the states cost there. Of a shorter conversation the places behind its turns hold its end."""
    out = np.empty((len(code) + 1, *end.shape), np.int64)
    out[-1] = end
    for t in range(len(code) - 1, -1, -1):
        after, cut = out[t + 1], (fault[t] == TRUNCATED).astype(np.int64)[:, None, None] * CUT
        to = KEPT[:, code[t]].T  # B x 4
        kept = np.where((to >= 0)[:, :, None], np.take_along_axis(after, np.maximum(to, 0)[:, :, None], 1), NEVER)
        stays = np.minimum(kept, after[:, NEXT] + REROLE) + cut
        must = np.isin(fault[t], (BLANK, REPEATED))[:, None, None]
        now = np.minimum(after + DELETE, np.where(must, NEVER, stays))
        now = np.minimum(np.minimum(now, now[:, NEXT] + INSERT), now[:, NEXT[NEXT]] + 2 * INSERT)
        out[t] = np.where((t < length)[:, None, None], np.minimum(now, NEVER), after)
    return out


def trace(cost: np.ndarray, code: np.ndarray, fault: np.ndarray, length: np.ndarray, which: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Edits and end states of runs: run r goes through conversation which[r] from state[r]; where last[r], it ends in a state that may end. cost: T + 1 x B x 4."""
    t, s, steps = np.zeros(len(which), np.int64), state.copy(), []
    n = length[which]
    while True:
        now = cost[t, which, s]
        active = (t < n) | (last & (now > 0))
        if not active.any():
            break
        inside, row = t < n, np.minimum(t, max(len(code) - 1, 0))
        after = cost[np.minimum(t + 1, len(cost) - 1), which]  # R x 4
        c, f = (code[row, which], fault[row, which]) if len(code) else (np.zeros_like(t), np.zeros_like(t))
        cut, to = (f == TRUNCATED) * CUT, KEPT[s, c]
        each = np.arange(len(s))
        delete = inside & (after[each, s] + DELETE == now)
        insert = ~delete & (cost[t, which, NEXT[s]] + INSERT == now)
        keep = ~delete & ~insert & inside & (f != BLANK) & (f != REPEATED) & (to >= 0) & (after[each, np.maximum(to, 0)] + cut == now)
        edit = np.where(delete, 0, np.where(insert, 1, np.where(keep, 2, 3)))
        steps.append(np.where(active, LETTERS[edit], 0).astype(np.uint8))
        s = np.where(active & ~delete, np.where(keep, to, NEXT[s]), s)
        t = t + (active & ~insert)
    if not steps:
        return [""] * len(which), s
    table = np.ascontiguousarray(np.stack(steps).T)
    return [r[: int((r != 0).sum())].tobytes().decode() for r in table], s


def buckets(lengths: list[int]) -> Iterator[list[int]]:
    """Indices of about equal lengths: at most half of an array's places are padding."""
    found: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        found.setdefault(n.bit_length(), []).append(k)
    yield from found.values()


def padded(parts: list[Block], pick: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(parts[k].codes) for k in pick], np.int64)
    code, fault = (np.zeros((int(length.max(initial=0)), len(pick)), np.int64) for _ in range(2))
    for b, k in enumerate(pick):
        code[: length[b], b], fault[: length[b], b] = parts[k].codes, parts[k].faults
    return code, fault, length


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> Iterator[str]:
    """The turns that the edits leave, as role:text."""
    at = 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            state = int(KEPT[state, "sua".index(roles[at][0])])
            yield f"{roles[at]}:{texts[at]}"
        else:
            state = int(NEXT[state])
            yield f"{NAMES[state]}:{texts[at] if letter == 'R' else ''}"
        at += letter != "I"


class Block:
    """Turns that follow each other in one conversation, with what is counted of them."""

    def __init__(self, conv, n: int = 0) -> None:
        self.conv, self.block, self.bytes = conv, n, 0
        self.turns, self.codes, self.faults, self.roles, self.texts = [], [], [], [], []

    def add(self, turn, code: int, fault: int, role: str, text: str) -> None:
        self.turns.append(turn), self.codes.append(code), self.faults.append(fault), self.roles.append(role), self.texts.append(text)
        self.bytes += len(role) + len(text)

    def counts(self) -> tuple:
        """blank, repeated, truncated, illegal, distinct turns; first and last turn that isn't null, first and last role code."""
        known = [t for t in self.turns if t is not None]
        distinct = sum(a != b for a, b in zip(known, [None, *known]))  # noqa: B905  rows come sorted
        ends = (known[0], known[-1]) if known else (None, None)
        return *[self.faults.count(k) for k in (BLANK, REPEATED, TRUNCATED)], sum(map(illegal, self.codes, self.codes[1:])), distinct, *ends, *((self.codes[0], self.codes[-1]) if self.codes else (None, None))


def illegal(a: int, b: int) -> bool:
    return (a, b) not in ((0, 1), (1, 2), (2, 1))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = "n_blank long, n_repeated long, n_truncated long, n_illegal long, n_turns long, low {turn}, high {turn}, first int, last int"
ROWS = "codes array<int>, faults array<int>, roles array<string>, texts array<string>"
KEY = "part int, block int"


def whole_results(parts: list[Block]) -> Iterator[tuple]:
    """conv and the RESULT of conversations that are one block each, all of a length at once."""
    for pick in buckets([len(p.codes) for p in parts]):
        code, fault, length = padded(parts, pick)
        n = len(pick)
        cost = costs(code, fault, length, np.broadcast_to(END[:, None], (n, 4, 1)))[..., 0]
        audits, _ = trace(cost, code, fault, length, np.arange(n), np.zeros(n, np.int64), np.ones(n, bool))
        for b, k in enumerate(pick):
            blank, repeat, cut, bad, distinct, low, high, _, _ = parts[k].counts()
            text = "\n".join(repaired(parts[k].roles, parts[k].texts, audits[b], 0))
            yield parts[k].conv, 0 if low is None else high - low + 1 - distinct, blank, repeat, cut, bad, int(cost[0, b, 0]), audits[b], hashlib.sha256(text.encode()).hexdigest()


def block_matrices(parts: list[Block]) -> Iterator[tuple[Block, list[int]]]:
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for pick in buckets([len(p.codes) for p in parts]):
        code, fault, length = padded(parts, pick)
        first = costs(code, fault, length, np.broadcast_to(unit, (len(pick), 4, 4)))[0]
        for b, k in enumerate(pick):
            yield parts[k], first[b].ravel().tolist()


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _solver(schema: pa.Schema, block_rows: int):
    """Rows in order -> whole conversations' results and the blocks of the others (see the module's text)."""
    n_whole, n_rest = 8, len(schema) - 9  # behind the conversation: its result, then what blocks have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_block, begun = TaskContext.get().partitionId(), 0, False
        whole, blocks, now, first = [], [], None, True

        def out(most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
            held = whole + blocks
            if not held or sum(len(p.codes) for p in held) + len(held) < most_rows and sum(p.bytes for p in held) < most_bytes:
                return
            if whole:
                yield _batch([(*r, *[None] * n_rest) for r in whole_results(whole)], schema)
            for p, matrix in block_matrices(blocks):
                yield _batch([(p.conv, *[None] * n_whole, part, p.block, matrix, *p.counts(), p.codes, p.faults, p.roles, p.texts)], schema)
            whole.clear(), blocks.clear()

        def close(ended: bool) -> None:
            """ended: the conversation has no row behind this block, here or in the next task."""
            nonlocal n_block
            if ended and now.block == 0 and not first:
                whole.append(now)
            else:
                now.block, n_block = n_block, n_block + 1
                blocks.append(now)

        for b in batches:
            for conv, turn, gone, code, fault, role, text in zip(*(b.column(k).to_pylist() for k in range(5)), b.column(5), b.column(6), strict=True):
                if not begun:
                    now, begun = Block(conv), True
                elif conv != now.conv:
                    close(True)
                    now, first = Block(conv), False
                    yield from out(SOLVE_ROWS, SOLVE_BYTES)
                elif len(now.codes) >= block_rows or now.bytes >= BLOCK_BYTES:
                    close(False)
                    now = Block(conv, 1)
                    yield from out(SOLVE_ROWS, SOLVE_BYTES)
                if not gone:
                    now.add(turn, code, fault, role.as_py(), text.as_py())
        if begun:
            close(False)
        yield from out(0, 0)

    return run


def _ends(schema: pa.Schema):
    """Matrices of a conversation's blocks, last first -> part, block, what each state costs behind the block, and whether it is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, behind, begun = None, END, False
        for b in batches:
            rows = []
            for conv, part, block, matrix in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                last = not begun or conv != now
                if last:
                    now, behind, begun = conv, END, True
                rows.append((part, block, behind.tolist(), last))
                behind = np.minimum((np.array(matrix).reshape(4, 4) + behind).min(1), NEVER)
            yield _batch(rows, schema)

    return run


def _tracer(schema: pa.Schema):
    """Blocks with their ends -> the same rows with the edits and end state from each of the four states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            for k in range(b.num_rows):
                part = Block(None)
                part.codes, part.faults = (b.column(names.index(c))[k].as_py() for c in ("codes", "faults"))
                code, fault, length = padded([part], [0])
                cost = costs(code, fault, length, np.array(b.column(names.index("behind"))[k].as_py())[None, :, None])[..., 0]
                last = np.full(4, b.column(names.index("is_last"))[k].as_py())
                audits, ends = trace(cost, code, fault, length, np.zeros(4, np.int64), np.arange(4), last)
                more = [pa.array([audits], pa.list_(pa.string())), pa.array([ends.tolist()], pa.list_(pa.int32())), pa.array([int(cost[0, 0, 0])], pa.int64())]
                kept = [b.column(names.index(f.name)).slice(k, 1) for f in list(schema)[:-3]]
                yield pa.RecordBatch.from_arrays([*kept, *more], schema=schema)

    return run


class _Reader:
    """One cut conversation, block by block in order."""

    def __init__(self, cost: int) -> None:
        self.cost, self.state, self.sums, self.audit, self.hash, self.begun = cost, 0, [0] * 5, [], hashlib.sha256(), False
        self.low = self.high = self.code = None

    def feed(self, counts: list, roles: list[str], texts: list[str], audits: list[str], ends: list[int]) -> None:
        *sums, low, high, first, last = counts
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]
        if first is not None:
            self.sums[3] += self.code is not None and illegal(self.code, first)
            self.code = last
        if low is not None:
            self.sums[4] -= self.high is not None and self.high == low
            self.low, self.high = low if self.low is None else self.low, high
        for turn in repaired(roles, texts, audits[self.state], self.state):
            self.hash.update(("\n" * self.begun + turn).encode())
            self.begun = True
        self.audit.append(audits[self.state])
        self.state = ends[self.state]

    def row(self) -> tuple:
        blank, repeat, cut, bad, distinct = self.sums
        return 0 if self.low is None else self.high - self.low + 1 - distinct, blank, repeat, cut, bad, self.cost, "".join(self.audit), self.hash.hexdigest()


def _reader(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for b in batches:
            for k in range(b.num_rows):
                conv, *counts, roles, texts, audits, ends, cost = (b.column(c)[k].as_py() for c in range(b.num_columns))
                if reader is None or conv != now:
                    if reader is not None:
                        yield _batch([(now, *reader.row())], schema)
                    now, reader = conv, _Reader(cost)
                reader.feed(counts, roles, texts, audits, ends)
        if reader is not None:
            yield _batch([(now, *reader.row())], schema)

    return run


def repair(rows: DataFrame, name: str = "conv_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per conversation of rows (as of damage()): its id under the name given, then RESULT."""
    kinds = dict(rows.dtypes)
    conv, turn = f"conv {kinds['conv']}", kinds["turn"]
    counts = COUNTS.format(turn=turn)
    ordered = with_faults(rows).repartitionByRange("conv", "turn", "id").sortWithinPartitions("conv", "turn", "id").select("conv", "turn", "gone", "code", "fault", "role", "text")
    ddl = f"{conv}, {RESULT}, {KEY}, matrix array<long>, {counts}, {ROWS}"
    solved = written(ordered.mapInArrow(_solver(_schema(ddl), block_rows), ddl), "turns")
    whole = solved.filter("part is null").select(F.col("conv").alias(name), *[c.split()[0] for c in RESULT.split(", ")])

    blocks = solved.filter("part is not null")
    ddl = f"{KEY}, behind array<long>, is_last boolean"
    chained = blocks.select("conv", "part", "block", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("block"))
    ends = chained.mapInArrow(_ends(_schema(ddl)), ddl)
    ddl = f"{conv}, {KEY}, {counts}, roles array<string>, texts array<string>, audits array<string>, ends array<int>, cost long"
    columns = [c.split()[0] for c in f"{conv}, {KEY}, {counts}, {ROWS}".split(", ")]
    traced = blocks.select(*columns).join(ends, ["part", "block"]).select(*columns, "behind", "is_last").mapInArrow(_tracer(_schema(ddl)), ddl)
    read = traced.repartition("conv").sortWithinPartitions("conv", "part", "block").drop("part", "block")
    ddl = f"{conv}, {RESULT}"
    return whole.unionByName(read.mapInArrow(_reader(_schema(ddl)), ddl).withColumnRenamed("conv", name))
