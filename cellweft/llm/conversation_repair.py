"""Repair of conversations whose roles must read `(s?(ua)+)?`, at the least cost.

Rows are kept (free), given another role (3), or deleted (4; a must for blank and
duplicate rows), rows are inserted (3), and truncated rows that stay cost 3. Of the
cheapest ways that with the ASCII-least list of edits is taken.

The search is depth-first branch and bound over (row, state of the grammar): an explicit
stack; a lower bound for what the rest costs at least from each row and state, from a backward
pass that ignores the list of edits; an incumbent (cost, edits); and per node the best (cost, edits)
that reached it, which cuts off every worse prefix. It ends when no open node can beat
the incumbent.

A conversation of any length is cut into segments of rows. Each is solved from every
state it may be entered in to every state it may be left in, in any task; the segments of
a conversation are then composed in order. Only the digest of the repaired text, which is
sequential, reads a conversation in one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import materialize, table

SEGMENT = 512  # rows solved at once
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FINAL = (START, ASSISTANT)
#: By state: the state after a row of each initial that may follow. A row without an initial changes nothing.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: By state: the only user or assistant row that may follow, which is what an insertion or a new role gives.
OTHER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def letter(initial: str, truncated: bool, gone: bool) -> str:
    """A row as the search sees it: its initial (- for none, x for any other), upper case if truncated; D if it must go."""
    if gone:
        return "D"
    known = initial if initial in ("s", "u", "a") else "x" if initial else "-"
    return (known.upper() if known != "-" else "_") if truncated else known


def moves(row: str, state: int) -> list[tuple[str, int, int]]:
    """Edit, cost and next state of what can be done with a row."""
    out = [("D", DELETE, state)]
    if row != "D":
        extra = TRUNCATED if row == "_" or row.isupper() else 0
        after = state if row in "-_" else NEXT[state].get(row.lower())
        if after is not None:
            out.append(("K", KEEP + extra, after))
        out.append(("R", REROLE + extra, OTHER[state]))
    return out


_MOVES = {(row, q): moves(row, q) for row in "suaxSUAX-_D" for q in STATES}


def bounds(rows: str, goals: tuple[int, ...]) -> list[list[float]]:
    """By row and state: what the rest costs at least, edits aside, until the rows end in one of `goals`."""

    def with_insertions(cost: list[float]) -> list[float]:
        for _ in range(3):
            cost = [min(cost[q], INSERT + cost[OTHER[q]]) for q in STATES]
        return cost

    out = [with_insertions([0.0 if q in goals else float("inf") for q in STATES])]
    for row in reversed(rows):
        rest = out[-1]
        out.append(with_insertions([min(cost + rest[to] for _, cost, to in _MOVES[row, q]) for q in STATES]))
    out.reverse()
    return out


def search(rows: str, start: int, goals: tuple[int, ...], least: list[list[float]] | None = None) -> tuple[int, str] | None:
    """The cheapest edits from `start` to one of `goals`, the ASCII-least of equal ones; None if there are none."""
    least = least or bounds(rows, goals)
    if least[0][start] == float("inf"):
        return None
    best: tuple[float, str] = (float("inf"), "")
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, q, cost, edits = stack.pop()
        bound = cost + least[i][q]
        if bound > best[0] or (bound == best[0] and edits > best[1][: len(edits)]):
            continue
        seen = reached.get((i, q))
        if seen is not None and seen <= (cost, edits):
            continue
        reached[i, q] = (cost, edits)
        if i == len(rows) and q in goals:
            best = min(best, (cost, edits))
        ways = [(cost + INSERT, OTHER[q], i, "I")]
        if i < len(rows):
            ways += [(cost + c, to, i + 1, edit) for edit, c, to in _MOVES[rows[i], q]]
        # the most promising one comes off the stack first: the least bound, then the least edit
        ways = [w for w in ways if w[0] + least[w[2]][w[1]] <= best[0]]
        ways.sort(key=lambda w: (-w[0] - least[w[2]][w[1]], -ord(w[3])))
        stack += [(at, to, c, edits + edit) for c, to, at, edit in ways]
    return (int(best[0]), best[1])


@lru_cache(1 << 14)
def solve(rows: str) -> tuple[int, str]:
    """A whole conversation."""
    return search(rows, START, FINAL)


@lru_cache(1 << 10)
def solve_segment(rows: str) -> tuple[tuple[int | None, ...], tuple[str | None, ...]]:
    """Cost and edits from each state (outer) to each state (inner), None where there is no way."""
    least = [bounds(rows, (goal,)) for goal in STATES]
    found = [search(rows, q, (goal,), least[goal]) or (None, None) for q in STATES for goal in STATES]
    return tuple(f[0] for f in found), tuple(f[1] for f in found)


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def damage(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after faults chosen by crc32 of `conv_id:turn`; nulls count as one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = [F.coalesce(c, F.lit(" ")) for c in ("role", "text")]
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.array_repeat(F.lit(1), copies).alias("_copies"))
    return out.select("conv_id", "turn", "role", "text", F.explode("_copies")).drop("col")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")


def row_facts(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation and turn as one, without their text: copies, blank, truncated, first (of its role and text)."""
    core = F.rtrim("text", F.lit(BLANKS))
    narrow = rows.select("conv_id", "turn", "role", _digest(), (core == "").alias("blank"), (~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    narrow = narrow.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    narrow = materialize(narrow, "turns")
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))  # nulls first
    first = narrow.groupBy("conv_id", "role", "digest").agg(F.min(place)["turn"].alias("turn"))
    # joined with the turn in the key, so that a text said at every turn is no hot key
    a, b, keys = narrow.alias("a"), first.alias("b"), ("conv_id", "turn", "role", "digest")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return materialize(a.join(b, same, "left").select("a.*", F.col("b.role").isNotNull().alias("first")), "turns")


def fault_counts(facts: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated."""
    one = lambda c, n: F.sum(F.when(c, n).otherwise(0))
    blank, first = F.col("blank"), F.col("first")
    turns = facts.groupBy("conv_id", "turn").agg(
        one(blank, F.col("copies")).alias("blank"), one(~blank, F.col("copies") - F.when(first, 1).otherwise(0)).alias("duplicate"), one(~blank & first & F.col("truncated"), F.lit(1)).alias("truncated")
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


_PLACE = ["conv_id", "turn", "role", "digest"]
_SEGMENTS = "conv_id long, turn long, role string, digest binary, whole boolean, head string, tail string, illegal long, costs array<long>, edits array<string>"


def _orders() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in _PLACE]


def _segments(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Cuts a partition's sorted rows into segments of at most `most` and solves them.

    The first and the last conversation of a partition may go on in its neighbours, so they
    are solved for all states; those between are whole.
    """
    out: list[tuple] = []
    rows, initials, key, first_of = [], [], None, None  # of the open segment
    conv, cuts, convs = object(), 0, 0  # cuts: segments of the open conversation that are done

    def close(whole: bool) -> None:
        text = "".join(rows)
        cost, edits = solve(text) if whole else solve_segment(text)
        out.append((*key, whole, initials[0], initials[-1], illegal_pairs(initials), [cost] if whole else list(cost), [edits] if whole else list(edits)))
        rows.clear()
        initials.clear()

    for pdf in batches:
        for r in zip(*[pdf[c] for c in (*_PLACE, "copies", "first", "blank", "truncated")], strict=True):
            now = None if pd.isna(r[0]) else int(r[0])
            if convs == 0 or now != conv:
                if rows:
                    close(whole=convs > 1 and not cuts)
                conv, cuts, convs = now, 0, convs + 1
            for copy in range(int(r[4])):
                if len(rows) == most:
                    close(whole=False)
                    cuts += 1
                if not rows:
                    # copies cut off are told apart by the number of the cut, in front of the digest
                    first_of = bytes(r[3]) + copy.to_bytes(8, "big")
                    key = (now, None if pd.isna(r[1]) else int(r[1]), r[2], first_of)
                rows.append(letter(r[2][:1], bool(r[7]), bool(r[6]) or copy > 0 or not r[5]))
                initials.append(r[2][:1])
        if out:
            yield _frame(out)
            out = []
    if rows:
        close(whole=False)
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.strip().split()[0] for c in _SEGMENTS.split(",")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"conv_id": "Int64", "turn": "Int64"})


_REPAIRS = "conv_id long, illegal long, cost long, audit string"


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of a conversation in order, from the start to an end that the grammar allows.

    What all live states share of their edits is settled and put aside, so ties
    compare short strings only.
    """
    conv, begun, settled, live, tail, illegal = None, False, [], {}, "", 0

    def done() -> tuple:
        cost, edits = min(live[q] for q in FINAL if q in live)
        return conv, illegal, cost, "".join(settled) + edits

    for pdf in batches:
        out = []
        for now, head, last, pairs, costs, edits in zip(pdf["conv_id"], pdf["head"], pdf["tail"], pdf["illegal"], pdf["costs"], pdf["edits"], strict=True):
            now = None if pd.isna(now) else int(now)
            if not begun or now != conv:
                if begun:
                    out.append(done())
                conv, begun, settled, live, illegal = now, True, [], {START: (0, "")}, int(pairs)
            else:
                illegal += int(pairs) + (tail + head not in LEGAL)
            tail = last
            ways: dict[int, tuple[int, str]] = {}
            for q, (cost, before) in live.items():
                for to in STATES:
                    more, e = costs[4 * q + to], edits[4 * q + to]
                    if e is not None:
                        way = (cost + int(more), before + e)
                        ways[to] = min(ways.get(to, way), way)
            low, high = min(w[1] for w in ways.values()), max(w[1] for w in ways.values())
            n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
            settled.append(low[:n])
            live = {q: (c, e[n:]) for q, (c, e) in ways.items()}
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "illegal", "cost", "audit"]).astype({"conv_id": "Int64"})
    if begun:
        yield pd.DataFrame([done()], columns=["conv_id", "illegal", "cost", "audit"]).astype({"conv_id": "Int64"})


def plan_repairs(facts: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation: illegal, cost and audit."""
    ordered = facts.repartitionByRange(*_orders()).sortWithinPartitions(*_orders())
    segments = materialize(ordered.mapInPandas(lambda batches: _segments(batches, segment), _SEGMENTS), "segments")
    whole = segments.where("whole").select("conv_id", "illegal", F.col("costs")[0].alias("cost"), F.col("edits")[0].alias("audit"))
    cut = segments.where("not whole").repartition("conv_id").sortWithinPartitions(*_orders())
    return whole.unionByName(cut.mapInPandas(_compose, _REPAIRS))


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follows a conversation's edits through its rows and hashes what is left; a conversation's edits come before its rows."""
    conv, begun, edits, at, state, sha, empty = None, False, "", 0, START, None, True

    def emit(role: str, text: str) -> None:
        nonlocal empty
        sha.update((("" if empty else "\n") + role + ":" + text).encode())
        empty = False

    def insertions() -> None:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state = OTHER[state]
            emit(ROLE[state], "")
            at += 1

    for pdf in batches:
        out = []
        for now, planned, role, text in zip(pdf["conv_id"], pdf["planned"], pdf["role"], pdf["text"], strict=True):
            if planned:
                if begun:
                    insertions()
                    out.append((conv, sha.hexdigest()))
                conv, begun, edits, at, state, sha, empty = None if pd.isna(now) else int(now), True, text, 0, START, hashlib.sha256(), True
                continue
            insertions()
            edit, at = edits[at], at + 1
            if edit == "K":
                state = NEXT[state][role[:1]] if role else state
                emit(role, text)
            elif edit == "R":
                state = OTHER[state]
                emit(ROLE[state], text)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})
    if begun:
        insertions()
        yield pd.DataFrame([(conv, sha.hexdigest())], columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})


def repaired_digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Per conversation the SHA-256 of the repaired `role:text` rows, joined by line feeds."""
    texts = rows.select("conv_id", "turn", "role", "text", _digest(), F.lit(False).alias("planned"))
    plans = repairs.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"), F.lit(True).alias("planned"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("planned").desc(), *_orders()[1:]]
    both = texts.unionByName(plans).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "planned", "role", "text").mapInPandas(_apply, "conv_id long, repaired_sha256 string")


def repair_conversations(rows: DataFrame, all_ids: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `rows` has conv_id, turn, role, text without nulls in the last two; other columns are
    not looked at. Rows go by turn, nulls first; rows of one turn by role and digest of the text, so
    equal rows are adjacent. A null conv_id is a conversation. A row without a role
    gives no initial and may stay anywhere. `all_ids` (conv_id) adds conversations without
    rows, with zeros, an empty audit and the digest of an empty text. An empty table gives
    an empty one. Texts of any length are hashed and otherwise read in the JVM only.
    `segment`: rows solved at once; results do not depend on it.
    """
    facts = row_facts(rows)
    repairs = materialize(plan_repairs(facts, segment), "repairs")
    parts = [fault_counts(facts), repairs, repaired_digests(rows, repairs)] + ([all_ids.select("conv_id").distinct()] if all_ids is not None else [])
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    # each column comes from one part, so that a maximum joins them, null ids included
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(EMPTY_SHA)).alias("repaired_sha256")
    )


def op12_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return repair_conversations(damage(conversations), conversations.select(F.col("conv_id").cast("long").alias("conv_id")))
