"""Conversation repair against a plain search and a plain walk."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("cellweft.llm")

from cellweft.llm import conversation_repair as cr  # noqa: E402
from cellweft.llm.common import table  # noqa: E402
from cellweft.llm.queries import QUERIES  # noqa: E402

BLANK = " \t\n\x0b\x0c\r"
PREFIX = re.compile(r"s?(ua)*u?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = [" " if x is None else x for x in (role, text)]
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        f = zlib.crc32(key.encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * {0: 0, 3: 2}.get(f, 1)
    return out


def plain(rows):
    """One conversation: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha); rows of it after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    fault, seen = [], set()
    for _, _, role, text in rows:
        core = text.strip(BLANK)
        fault.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    # cheapest first, then the least list of edits: the first end that comes off the heap is the answer
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, initials, out = heapq.heappop(heap)
        state = (i, initials[-1:], initials[:1] if len(initials) < 2 else "")
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            break
        if state in done:
            continue
        done.add(state)
        ways = [("I", 3, i, r[0], (*out, r + ":")) for r in ("user", "assistant")]
        if i < len(rows):
            extra = 3 if fault[i] == "truncated" else 0
            ways.append(("D", 4, i + 1, "", out))
            if fault[i] not in ("blank", "duplicate"):
                ways.append(("K", extra, i + 1, rows[i][2][:1], (*out, rows[i][2] + ":" + rows[i][3])))
                ways += [("R", 3 + extra, i + 1, r[0], (*out, r + ":" + rows[i][3])) for r in ("user", "assistant")]
        for edit, more, at, initial, text in ways:
            if PREFIX.fullmatch(initials + initial) and initials + initial != "sa":
                heapq.heappush(heap, (cost + more, audit + edit, at, initials + initial, text))
    n = fault.count
    return gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def expected(rows):
    after = damaged(rows)
    return sorted(((c, *plain([r for r in after if r[0] == c])) for c in {r[0] for r in rows}), key=str)


@settings(max_examples=400, deadline=None)
@given(st.text("suaxSUAX-_D", max_size=9))
def test_search_is_optimal(rows):
    """Against all (cost, edits) of a plain pass that keeps the best per state."""
    live = {cr.START: (0, "")}

    def inserted(live):
        for _ in range(3):
            for q, (c, e) in list(live.items()):
                live[cr.OTHER[q]] = min(live.get(cr.OTHER[q], (10**9, "")), (c + 3, e + "I"))
        return live

    live = inserted(live)
    for row in rows:
        nxt = {}
        for q, (c, e) in live.items():
            for edit, more, to in cr.moves(row, q):
                nxt[to] = min(nxt.get(to, (10**9, "")), (c + more, e + edit))
        live = inserted(nxt)
    assert cr.search(rows, cr.START, cr.FINAL) == min(live[q] for q in cr.FINAL if q in live)


def test_known_repairs():
    assert cr.solve("") == (0, "")
    assert cr.solve("ua") == (0, "KK")
    assert cr.solve("s") == (4, "D")
    assert cr.solve("u") == (3, "KI")
    assert cr.solve("a") == (3, "IK")  # 3 either way from here: a deletion costs more
    assert cr.solve("uD") == (7, "KDI")
    assert cr.solve("UA") == (6, "KK")
    assert cr.solve("uu") == (3, "KR")
    assert cr.solve("uua") == (3, "KIKK")


def test_query(spark, sf_dir):
    got = sorted(map(tuple, QUERIES["op12_conversation_repair"](spark, sf_dir).collect()), key=str)
    rows = list(map(tuple, table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()))
    assert got == expected(rows)


@pytest.mark.parametrize("segment", [1, 7, 512])
def test_odd_rows(spark, segment):
    """Nulls in every column, ties, repeated rows, blanks of all kinds, roles of none and of other kinds, a long conversation."""
    rng = random.Random(segment)
    texts = [None, "", " \x0b\n", "Yes.", "No", "Why?\n", "a\tb! ", ".", "\u00a0", "\u65e5. ", "x" * 100_000]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(120)]
    rows += [(9, t, rng.choice(roles), rng.choice([f"Turn {t}.", f"turn {t}"])) for t in range(1500)] + [(10, 1, "user", "Same.")] * 700
    conv = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, cost int, digest string, copies int").repartition(5)
    got = cr.repair_conversations(cr.damage(conv), conv, segment)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_conversations(cr.damage(none), none).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    one = spark.createDataFrame([(lost, 1, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert list(map(tuple, cr.repair_conversations(cr.damage(one), one).collect())) == [(lost, 0, 0, 0, 0, 0, 0, "", cr.EMPTY_SHA)]
