"""Conversation repair against a plain version that tries every edit."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from cohortgrid.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn int, role string, text string, part string, code int"
SPACE = " \t\n\v\f\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if act == 0:
            continue
        text = "" if act == 1 else "".join(c for c in text if c not in ".!?") if act == 2 else text
        yield from [(conv, turn, "user" if act == 4 else role, text)] * (1 + (act == 3))


def plain_version(rows):
    """Result per conversation, from rows in the order of the table."""
    convs = {r[0]: [] for r in rows}
    for r in damaged(rows):
        convs[r[0]].append(r)
    return {conv: one(sorted(own, key=lambda r: (r[1] is not None, r[1] or 0))) for conv, own in convs.items()}


def one(rows):
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.rstrip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials, n = [r[2][:1] for r in rows], len(rows)
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, audit, turns) of the cheapest way on; no more than two insertions in a row can pay."""
        found = [(0, "", ())] if i == n and state in ("", "a") else []
        def on(cost, letter, turn, then):
            found.append((cost + then[0], letter + then[1], turn + then[2]))
        new = "a" if state == "u" else "u"
        name = "assistant" if new == "a" else "user"
        if inserted < 3:
            on(2, "I", ((name + ":"),), best(i, new, inserted + 1))
        if i < n:
            on(3, "D", (), best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                on(2 + cut, "R", (f"{name}:{rows[i][3]}",), best(i + 1, new, 0))
                if (state, initials[i]) in legal:
                    on(cut, "K", (f"{rows[i][2]}:{rows[i][3]}",), best(i + 1, legal[state, initials[i]], 0))
        return min(found, default=(10**9, "~", ()))

    for i in range(n, 0, -50):  # fills the cache from the back, so that the recursion stays shallow
        [best(i, state, 0) for state in ("", "s", "u", "a")]
    cost, audit, turns = best(0, "", 0)
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905
    return gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], bad, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def conversations(n, seed, longest):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "no", "Why?", "", " \n", "ok! \t", None, "a. b", ".", "é…", "x" * 3000 + "."]
    for conv in range(n):
        for turn in range(rng.randrange(1, longest + 1)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "s", "Assistant"])
            text = rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(10**6)}{rng.choice('.!?x')}"
            rows.append((conv, rng.choice([turn, turn, turn, turn + rng.randrange(3), None]), role, text))
    return rows


def check(spark, rows, block_rows):
    table = spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA).coalesce(1)
    found = cr.repair(cr.damage(table), block_rows=block_rows).collect()
    assert len(found) == len({r[0] for r in rows})
    want = plain_version(rows)
    for r in found:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_like_the_plain_version(spark):
    check(spark, conversations(300, 1, 9), cr.BLOCK_ROWS)


@pytest.mark.parametrize("block_rows", [1, 7])
def test_long_conversations_in_blocks(spark, block_rows):
    rng = random.Random(3)
    rows = conversations(12, 2, 60)
    # One conversation with most rows, repeats among them, over all tasks; one without an id; one that the damage empties.
    rows += [(500, t // 2, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"n{t}.", f"n{t}"])) for t in range(400)]
    rows += [(None, None, None, None), (None, None, "user", "hi."), (None, None, "user", "hi.")]
    empty = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(empty, 0, "user", "gone.")]
    check(spark, rows, block_rows)


def test_empty_table(spark):
    assert cr.repair(cr.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_blocks_chain_to_the_costs_of_the_whole():
    rng = np.random.default_rng(0)
    code, fault = rng.integers(0, 4, (40, 5)), rng.integers(0, 4, (40, 5))
    full, end = np.full(5, 40), np.broadcast_to(cr.END[:, None], (5, 4, 1))
    want = cr.costs(code, fault, full, end)[0, :, :, 0]
    unit = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, cr.NEVER), (5, 4, 4))
    a, b = (cr.costs(code[s], fault[s], np.full(5, 20), unit)[0] for s in (slice(20), slice(20, 40)))
    behind = (b + cr.END).min(2)
    assert ((a + behind[:, None, :]).min(2) == want).all()
