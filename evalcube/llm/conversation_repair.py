"""Repair of the turn structure of conversations by alignment to a role grammar.

A sound conversation's role initials read ``(s?(ua)+)?``: an optional system turn,
then user and assistant by turns, or nothing. Each turn is kept (cost 0), given the
role user or assistant (2) or deleted (3), and empty user and assistant turns are
inserted (2); blank turns and duplicates must go, a truncated turn that stays
costs 1 more. The cheapest edits win, of equally cheap ones those whose initials
(D, I, K, R, in order) are least in ASCII.

Turns are aligned by Wagner-Fischer to the grammar string of each feasible
length. A target whose length alone costs more than the incumbent, the cheapest
alignment so far, is not feasible; within one, Ukkonen's band leaves out the cells
that no alignment within the incumbent's cost can pass. The cheapest targets are
traced back and their audits compared.

Long conversations: blocks of ``BLOCK`` turns are aligned on their own, from each
state of the grammar (nothing yet, after s, u or a) to each other. Every block's
alignment ends with a turn, so two audits of a block never are each other's
prefix, and cheapest, ASCII-least audits chain: of several ways into a state only
the cheapest of the least rank is kept. Rows are dealt by range, so one conversation
may span many tasks; each task chains the blocks of its segment, and the few
segments at the tasks' edges, a few strings each, are chained by conversation.

Defined cases: null role or text is one space; rows are taken by turn (null
first), role and text; repeated rows are duplicates; a null conversation id is
one conversation; an empty table gives no rows; further columns are not read.
An audit is one value, so it must fit in a row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partition_id, stage

BLOCK = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INF = 1 << 60

#: States: nothing yet, after s, after u, after a. Initial emitted on the way into each, and the states that follow.
START, S, U, A = range(4)
_NEXT = {START: U, S: U, U: A, A: U}
_LETTER = {S: "s", U: "u", A: "a"}
_ROLE = {"u": "user", "a": "assistant"}
_SPACE = " \t\n\v\f\r"
#: Inserts that end a conversation soundly from each state.
_FINISH = {START: "", S: "II", U: "I", A: ""}


def fault_of(text: str, seen: bool) -> str:
    """First fault of a turn: blank, duplicate, truncated or none."""
    core = text.strip(_SPACE)
    if not core:
        return "blank"
    if seen:
        return "duplicate"
    return "" if core[-1] in ".!?" else "truncated"


def _targets(entry: int, length: int):
    """Grammar strings of ``length`` initials from ``entry`` with the state each ends in."""
    if length == 0:
        yield "", entry
        return
    firsts = [_NEXT[entry]] + ([S] if entry == START else [])
    for first in firsts:
        state, out = first, [_LETTER[first]]
        for _ in range(length - 1):
            state = _NEXT[state]
            out.append(_LETTER[state])
        yield "".join(out), state


def _align(turns: list[tuple[str, int]], target: str, limit: int):
    """(cost, least audit) of the turns against one target, the last edit on a turn; None beyond ``limit``.

    ``turns`` are (initial, cost of staying or -1 if the turn must go). Only cells
    within Ukkonen's band are filled: what a cell's diagonal costs at least before
    and after it must stay within ``limit``.
    """
    n, m = len(turns), len(target)

    def least(i, j):  # cost of getting from (0, 0) to (i, j) and on to (n, m) by lengths alone
        d, e = j - i, (m - j) - (n - i)
        return (INSERT * d if d > 0 else -DELETE * d) + (INSERT * e if e > 0 else -DELETE * e)

    cost: list[dict[int, int]] = [{} for _ in range(n + 1)]
    cost[n] = {m: 0}
    for i in range(n - 1, -1, -1):
        initial, stay = turns[i]
        below, row = cost[i + 1], cost[i]
        for j in range(m, -1, -1):
            if least(i, j) > limit:
                continue
            best = below.get(j, INF) + DELETE
            if j < m:
                if stay >= 0 and (target[j] == initial or target[j] != "s"):
                    best = min(best, below.get(j + 1, INF) + stay + (KEEP if target[j] == initial else REROLE))
                if target[j] != "s":
                    best = min(best, row.get(j + 1, INF) + INSERT)
            if best < INF:
                row[j] = best
    total = cost[0].get(0, INF)
    if total > limit:
        return None
    i = j = 0
    out = []
    while i < n:  # at each cell the least initial that is on a cheapest path
        here = cost[i][j]
        initial, stay = turns[i]
        if here == cost[i + 1].get(j, INF) + DELETE:
            out.append("D")
            i += 1
        elif j < m and target[j] != "s" and here == cost[i].get(j + 1, INF) + INSERT:
            out.append("I")
            j += 1
        else:
            out.append("K" if target[j] == initial else "R")
            i, j = i + 1, j + 1
    return total, "".join(out)


def align_block(turns: list[tuple[str, int]], entry: int) -> dict[int, tuple[int, str]]:
    """For each state that can be reached: the cheapest, then least, (cost, audit) from ``entry``."""
    n, best = len(turns), {}
    # incumbents: every turn deleted, behind the inserts that lead to the state
    state, cost = entry, DELETE * n
    limit = {state: cost}
    for _ in range(2):
        state, cost = _NEXT[state], cost + INSERT
        limit[state] = min(limit.get(state, INF), cost)
    if entry == START:
        limit[S] = min((DELETE * (n - 1) + stay for initial, stay in turns if initial == "s" and stay >= 0), default=-1)
    gap = 0
    while min(INSERT, DELETE) * gap <= max(limit.values()):
        for m in ({n + gap, n - gap} if gap <= n else {n + gap}):
            alone = INSERT * (m - n) if m > n else DELETE * (n - m)
            for target, out in _targets(entry, m):
                if alone > limit.get(out, -1):
                    continue
                found = _align(turns, target, limit[out])
                if found is not None and (out not in best or found < best[out]):
                    best[out] = found
                    limit[out] = found[0]
        gap += 1
    return best


def chain(blocks, entry: int) -> dict[int, tuple[int, list[tuple[int, str]]]]:
    """Cheapest, least (cost, (state before, audit) of each block) from ``entry`` into each state.

    A block maps entry -> state -> (cost, audit).
    """
    now = {entry: (0, 0)}  # state -> (cost, rank of its audit so far)
    back = []
    for block in blocks:
        step = {}
        for y, (cost, rank) in now.items():
            for x, (c, audit) in block[y].items():
                key = (cost + c, rank, audit)
                if x not in step or key < step[x][0]:
                    step[x] = (key, y)
        order = sorted({key[1:] for key, _ in step.values()})
        now = {x: (key[0], order.index(key[1:])) for x, (key, _) in step.items()}
        back.append({x: (y, key[2]) for x, (key, y) in step.items()})
    out = {}
    for x, (cost, _) in now.items():
        parts, state = [], x
        for b in reversed(back):
            state, audit = b[state]
            parts.append((state, audit))
        out[x] = (cost, parts[::-1])
    return out


def finish(ways: dict[int, tuple[int, list[tuple[int, str]]]]) -> tuple[int, list[tuple[int, str]], str]:
    """(cost, states and audits, trailing inserts) of the cheapest, then least, sound end."""
    best = None
    for state, (cost, parts) in ways.items():
        end = _FINISH[state]
        key = (cost + INSERT * len(end), "".join(p for _, p in parts) + end)
        if best is None or key < best[0]:
            best = (key, parts, end)
    return best[0][0], best[1], best[2]


_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint"
_COUNT_NAMES = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]
_WAYS = "array<struct<entry:int,state:int,cost:bigint,audit:string>>"


class _Segment:
    """The turns of one conversation within a task, aligned block by block."""

    def __init__(self, conv, first: bool):
        self.conv, self.first = conv, first
        self.blocks, self.part = [], []
        self.c = dict.fromkeys(_COUNT_NAMES, 0) | {"low": None, "high": None}
        self.head = self.tail = self.head_turn = None
        self.entries = (START, S, U, A) if first else (START,)

    def add(self, turn, role: str, text: str, copies: int, fresh: bool) -> None:
        initial = role[:1]
        if self.head is None:
            self.head, self.head_turn = initial, turn
        elif self.tail + initial not in ("su", "ua", "au"):
            self.c["illegal"] += 1
        self.tail = initial
        if copies > 1 and initial + initial not in ("su", "ua", "au"):
            self.c["illegal"] += copies - 1
        if turn is not None:
            if self.c["high"] != turn:
                self.c["turns"] += 1
            self.c["low"] = turn if self.c["low"] is None else self.c["low"]
            self.c["high"] = turn
        fault = fault_of(text, not fresh)
        if fault:
            self.c[fault] += 1
        self._turn(initial, -1 if fault in ("blank", "duplicate") else (TRUNCATED if fault else 0))
        again = "blank" if fault == "blank" else "duplicate"
        self.c[again] += copies - 1
        for _ in range(copies - 1):
            self._turn(initial, -1)

    def _turn(self, initial: str, stay: int) -> None:
        self.part.append((initial, stay))
        if len(self.part) == BLOCK:
            self._close()

    def _close(self) -> None:
        if self.part:
            part, known = self.part, {}
            states = (START, S, U, A) if self.first or self.blocks else (START,)
            for y in states:
                known[y] = align_block(part, y)
            self.blocks.append(known)
            self.part = []

    def ways(self):
        self._close()
        out = []
        for y in self.entries:
            for x, (cost, parts) in chain(self.blocks, y).items():
                out.append({"entry": y, "state": x, "cost": cost, "audit": "".join(p for _, p in parts)})
        return out


def _segments(schema: pa.Schema):
    """Sorted turns -> the same turns with their segment, then one row for each segment."""

    def scan(batches):
        pid, k, seg = partition_id(), -1, None
        names = schema.names

        def close(last: bool):
            none = dict.fromkeys(names)
            return none | {"kind": 1, "pid": pid, "seg": k, "conv": seg.conv, "edge": seg.first or last, "head": seg.head, "tail": seg.tail,
                           "head_turn": seg.head_turn, "ways": seg.ways()} | seg.c

        for b in batches:
            done, numbers = [], []
            conv, turn, role, text, copies, fresh = (b.column(i).to_pylist() for i in range(6))
            for i in range(b.num_rows):
                if seg is None or seg.conv != conv[i]:
                    if seg is not None:
                        done.append(close(False))
                    k += 1
                    seg = _Segment(conv[i], k == 0)
                seg.add(turn[i], role[i], text[i], copies[i], fresh[i])
                numbers.append(k)
            n = b.num_rows
            given = dict(zip(["conv", "turn", "role", "text", "copies"], b.columns)) | {
                "kind": pa.array([0] * n, pa.int32()), "pid": pa.array([pid] * n, pa.int32()), "seg": pa.array(numbers, pa.int64())}
            yield pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if seg is not None:
            yield pa.RecordBatch.from_pylist([close(True)], schema=schema)
    return scan


def _join_edges(rows):
    """All segments of one conversation, in order -> its totals, and each segment's slice of the audit."""
    rows = sorted(rows, key=lambda r: (r["pid"], r["seg"]))
    blocks = []
    for r in rows:
        block: dict = {}
        for w in r["ways"]:
            block.setdefault(w["entry"], {})[w["state"]] = (w["cost"], w["audit"])
        blocks.append(block)
    cost, ways, end = finish(chain(blocks, START))
    parts = [p for _, p in ways]
    parts[-1] += end
    c = {n: sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated", "illegal", "turns")}
    high = None
    for a, r in enumerate(rows):
        if a and rows[a - 1]["tail"] + r["head"] not in ("su", "ua", "au"):
            c["illegal"] += 1
        if high is not None and r["head_turn"] == high:
            c["turns"] -= 1  # a turn number that the segments' border divides
        high = r["high"] if r["high"] is not None else high
    low = [r["low"] for r in rows if r["low"] is not None]
    c |= {"low": low[0] if low else None, "high": high}
    before = 0
    for a, r in enumerate(rows):
        last = a == len(rows) - 1
        yield {"conv": r["conv"], "pid": r["pid"], "seg": r["seg"], "slice": parts[a], "state": ways[a][0], "before": before, "cost": cost,
               "audit": "".join(parts) if last else None} | c
        before += sum(1 for x in parts[a] if x != "D")


def _finish_whole(schema: pa.Schema):
    """Segments that are whole conversations."""

    def scan(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([next(_join_edges([r])) for r in b.to_pylist()], schema=schema)
    return scan


def _finish_edges(schema: pa.Schema):
    """Segments at the edges of tasks, sorted by conversation; those of one conversation are as many as its tasks."""

    def scan(batches):
        held = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held and held[0]["conv"] != r["conv"]:
                    out += _join_edges(held)
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist(list(_join_edges(held)), schema=schema)
    return scan


def _apply(schema: pa.Schema):
    """A segment's slice of the audit, then its turns in order -> repaired turns."""

    def scan(batches):
        audit, at, end, pos, conv, state = "", 0, 0, 0, None, START

        def inserts(out):
            nonlocal at, pos, state
            while at < len(audit) and audit[at] == "I":
                state = _NEXT[state]
                out.append((conv, pos, _ROLE[_LETTER[state]], "I", ""))
                at, pos = at + 1, pos + 1

        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["kind"] == 0:
                    audit, at, pos, conv, state = r["slice"], 0, r["before"], r["conv"], r["state"]
                    end = len(audit.rstrip("I"))
                    continue
                for _ in range(r["copies"]):
                    inserts(out)
                    op, at = audit[at], at + 1
                    if op == "K":
                        state = S if r["role"][:1] == "s" else _NEXT[state]
                        out.append((conv, pos, r["role"], op, r["text"]))
                    elif op == "R":
                        state = _NEXT[state]
                        out.append((conv, pos, _ROLE[_LETTER[state]], op, r["text"]))
                    pos += op != "D"
                if at == end:
                    inserts(out)
            cols = list(zip(*out)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)
    return scan


def _arrow(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T
    return to_arrow_schema(T._parse_datatype_string(ddl))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns).

    Audits, one row for each conversation: conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit. Repaired turns: conv, pos (from 0), role, op, text.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    kind = dict(rows.dtypes)["conv"]
    # equal turns once with their number; the first turn that says a text is marked without a join
    told = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    firsts = (rows.groupBy("conv", "role", "text").agg(F.min(told).alias("t"))
              .select("conv", F.col("t.turn").alias("turn"), "role", "text", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("f")))
    flagged = (once.withColumn("f", F.lit(False)).unionByName(firsts).groupBy("conv", "turn", "role", "text")
               .agg(F.sum("n").alias("copies"), F.max("f").alias("fresh")))
    key = ["conv", "turn", "role", "text"]
    ddl = (f"kind int, pid int, seg bigint, conv {kind}, turn bigint, role string, text string, copies bigint, edge boolean, "
           f"head string, tail string, head_turn bigint, ways {_WAYS}, {_COUNTS}")
    cut = stage(flagged.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_segments(_arrow(ddl, spark)), ddl), "cr-segments")
    segments = cut.filter("kind = 1").select("conv", "pid", "seg", "edge", "head", "tail", "head_turn", "ways", *_COUNT_NAMES)
    joined_ddl = f"conv {kind}, pid int, seg bigint, slice string, state int, before bigint, cost bigint, audit string, {_COUNTS}"
    joined = _arrow(joined_ddl, spark)
    edges = segments.filter("edge").repartition("conv").sortWithinPartitions("conv", "pid", "seg")
    slices = stage(segments.filter("NOT edge").mapInArrow(_finish_whole(joined), joined_ddl)
                   .union(edges.mapInArrow(_finish_edges(joined), joined_ddl)), "cr-audits")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    audits = slices.filter("audit IS NOT NULL").select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    # the slice goes ahead of its segment's turns
    work = (cut.filter("kind = 0").select(F.lit(1).alias("kind"), "pid", "seg", "conv", "turn", "role", "text", "copies",
                                          F.lit(None).cast("string").alias("slice"), F.lit(None).cast("int").alias("state"),
                                          F.lit(None).cast("bigint").alias("before"))
            .union(slices.select(F.lit(0).alias("kind"), "pid", "seg", "conv", F.lit(None).cast("bigint"), F.lit(None).cast("string"),
                                 F.lit(None).cast("string"), F.lit(None).cast("bigint"), "slice", "state", "before")))
    place = ["pid", "seg", "kind", "turn", "role", "text"]
    out_ddl = f"conv {kind}, pos bigint, role string, op string, text string"
    fixed = (work.repartition("pid", "seg").sortWithinPartitions(*place)
             .mapInArrow(_apply(_arrow(out_ddl, spark)), out_ddl))
    return audits, fixed


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The rows with faults by crc32 of ``conv:turn`` modulo 20 (null: one space): dropped, emptied, unpunctuated, repeated, re-roled."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv_col), F.col(turn_col), text("role").alias("role"), text("text").alias("text"),
                       (F.crc32(F.concat_ws(":", text(conv_col), text(turn_col)).cast("binary")) % 20).alias("fault"))
    bad = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (rows.filter("fault <> 0").withColumn("text", bad)
            .withColumn("role", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")))
            .select(conv_col, turn_col, "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def _digests(schema: pa.Schema):
    """Repaired turns sorted by (conv, pos) -> sha256 of ``role:text`` joined by newlines; only the hash state is held."""

    def scan(batches):
        state, conv = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                line = f"{r['role']}:{r['text']}".encode()
                if state is None or r["conv"] != conv:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    state, conv = hashlib.sha256(line), r["conv"]
                else:
                    state.update(b"\n" + line)
            yield pa.RecordBatch.from_pylist([{"conv": c, "repaired_sha256": d} for c, d in out], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": state.hexdigest()}], schema=schema)
    return scan


def digests(fixed: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of every conversation with a repaired turn; a digest is sequential, so its turns pass one task as a stream."""
    ddl = f"conv {dict(fixed.dtypes)['conv']}, repaired_sha256 string"
    return (fixed.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "role", "text")
            .mapInArrow(_digests(_arrow(ddl, fixed.sparkSession)), ddl))


__all__ = ["repair", "damage", "digests", "align_block", "chain", "finish", "fault_of"]
