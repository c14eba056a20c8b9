"""Conversation structure repair, planned by divide and conquer.

A conversation is to read, by the first letters of its roles, ``(s?(ua)+)?``. Between
its rows the repaired text is in one of four states: nothing yet, after a system
turn, after a user's, after an assistant's. Forward and backward vectors of the
states' least costs meet in the middle; the cheapest crossing, of equal ones that with
the least audit, splits the conversation into two halves that are planned alike
(Hirschberg, 1975). So only the vectors and the audit are ever held, not a table of
rows by states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What edits cost, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"  # of the roles that lead to the states after START
FOLLOWS = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
LEGAL = ("su", "ua", "au")
TAIL = (0, 2 * INSERT, INSERT, 0)  # of inserts that end the conversation in each state
FINE, BLANK, DUPLICATE, CUT = range(4)
NEVER = 1 << 30

PLAN = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def next_state(state: int) -> int:
    """After an inserted or reroled turn, which is the user's unless a user's precedes."""
    return ASSISTANT if state == USER else USER


def _steps() -> list[list[list[tuple[int, int, str]]]]:
    """By kind of row (fault * 4 + initial) and state before it: the ways to deal with
    the row, as (cost, state after it, audit): inserts, then one edit of the row."""
    table = []
    for kind in range(16):
        fault, initial = divmod(kind, 4)
        extra = TRUNCATED if fault == CUT else 0
        from_states = []
        for before in range(4):
            ways = {}

            def offer(cost, after, audit):
                ways[after] = min(ways.get(after, (NEVER, "")), (cost, audit))

            state = before
            for inserts in range(3):  # more would come back to an earlier state
                lead, paid = "I" * inserts, INSERT * inserts
                offer(paid + DELETE, state, lead + "D")
                if fault not in (BLANK, DUPLICATE):
                    letter = INITIALS[initial] if initial < 3 else ""
                    if letter and state in FOLLOWS[letter]:
                        offer(paid + extra, initial + 1, lead + "K")
                    offer(paid + REROLE + extra, next_state(state), lead + "R")
                state = next_state(state)
            from_states.append(sorted((c, after, audit) for after, (c, audit) in ways.items()))
        table.append(from_states)
    return table


STEPS = _steps()


class Planner:
    """Cheapest repairs of conversations. Vectors are kept relative to their least
    cost; few different ones exist, so each step from one is worked out once."""

    def __init__(self):
        self.forward_steps: dict[tuple, tuple] = {}
        self.backward_steps: dict[tuple, tuple] = {}

    def forward(self, vector: tuple, kind: int) -> tuple:
        """``vector`` has a cost and a rank for each state: the order of the states' least
        audits. Audits of different states end with an edit of the same row, so none
        begins another and the order stays whatever follows."""
        found = self.forward_steps.get((vector, kind))
        if found is None:
            best = {}
            for before, (cost, rank) in enumerate(vector):
                if cost < NEVER:
                    for c, after, audit in STEPS[kind][before]:
                        way = (cost + c, rank, audit)
                        best[after] = min(best.get(after, way), way)
            least = min(way[0] for way in best.values())
            order = sorted(best, key=lambda after: best[after][1:])
            found = tuple(
                (best[s][0] - least, order.index(s)) if s in best else (NEVER, 0) for s in range(4)
            )
            self.forward_steps[vector, kind] = found
        return found

    def backward(self, kind: int, vector: tuple) -> tuple:
        found = self.backward_steps.get((vector, kind))
        if found is None:
            costs = [min(c + vector[after] for c, after, _ in STEPS[kind][before]) for before in range(4)]
            least = min(costs)
            found = tuple(min(c - least, NEVER) for c in costs)
            self.backward_steps[vector, kind] = found
        return found

    def crossing(self, kinds: bytes, lo: int, mid: int, hi: int, start: int, end: tuple) -> int:
        ahead = tuple((0 if s == start else NEVER, 0) for s in range(4))
        for kind in memoryview(kinds)[lo:mid]:
            ahead = self.forward(ahead, kind)
        for at in range(hi - 1, mid - 1, -1):
            end = self.backward(kinds[at], end)
        return min(range(4), key=lambda s: (ahead[s][0] + end[s], ahead[s][1]))

    def audit(self, kinds: bytes) -> str:
        """Of the cheapest edits the least audit, for rows of these kinds."""
        pieces, state = [], START
        open_parts = [(0, len(kinds), TAIL)] if kinds else []
        while open_parts:
            lo, hi, end = open_parts.pop()
            if hi - lo == 1:
                ways = STEPS[kinds[lo]][state]
                _, audit, state = min((c + end[after], audit, after) for c, after, audit in ways)
                pieces.append(audit)
                continue
            mid = (lo + hi) // 2
            meet = self.crossing(kinds, lo, mid, hi, state, end)
            open_parts.append((mid, hi, end))
            open_parts.append((lo, mid, tuple(0 if s == meet else NEVER for s in range(4))))
        return "".join(pieces) + "I" * (TAIL[state] // INSERT)


def audit_cost(kinds: bytes, audit: str) -> int:
    edits = np.frombuffer(audit.replace("I", "").encode(), np.uint8)
    left_cut = (edits != ord("D")) & (np.frombuffer(kinds, np.uint8) // 4 == CUT)
    counted = {"D": DELETE, "I": INSERT, "R": REROLE}
    return sum(audit.count(e) * c for e, c in counted.items()) + TRUNCATED * int(left_cut.sum())


# --- passes over conversations in order --------------------------------------------------------


class _Facts:
    """What is gathered of one conversation: a byte for each row, and its turns."""

    def __init__(self):
        self.kinds = bytearray()
        self.turns = self.least = self.last = None
        self.distinct = 0

    def add(self, kinds: np.ndarray, turns: np.ndarray) -> None:
        self.kinds += kinds.tobytes()
        if len(turns):
            if self.least is None:
                self.least = int(turns[0])
            self.distinct += int((turns[1:] != turns[:-1]).sum()) + (self.last != int(turns[0]))
            self.last = int(turns[-1])

    def plan(self, planner: Planner) -> tuple:
        kinds = bytes(self.kinds)
        faults, initials = np.divmod(np.frombuffer(kinds, np.uint8).astype(np.int64), 4)
        legal = {INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in LEGAL}
        illegal = ~np.isin(initials[:-1] * 4 + initials[1:], list(legal))
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.distinct
        audit = planner.audit(kinds)
        counts = [int((faults == f).sum()) for f in (BLANK, DUPLICATE, CUT)]
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)  # as a long wraps
        return (gaps, *counts, int(illegal.sum()), audit_cost(kinds, audit), audit)


_KEYS = ["unnamed", "conv"]


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    planner, facts, key, before = Planner(), None, None, None
    names = [*_KEYS, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds_of = [pa.bool_(), *[pa.int64()] * 7, pa.string()]
    done = []

    def packed():
        columns = list(zip(*done)) if done else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        unnamed, conv = (batch.column(k).to_numpy(zero_copy_only=False) for k in _KEYS)
        has_turn = batch.column("turn").is_valid().to_numpy(zero_copy_only=False)
        turn = batch.column("turn").fill_null(0).to_numpy()
        digest = np.array(batch.column("digest").to_pylist(), dtype=object)
        row = list(zip(unnamed.tolist(), conv.tolist(), has_turn.tolist(), turn.tolist(), digest))
        again = np.fromiter((a == b for a, b in zip(row, [before, *row[:-1]])), dtype=bool, count=len(row))
        before = row[-1]
        fault = batch.column("fault").to_numpy().astype(np.uint8)
        fault[again & (fault != BLANK)] = DUPLICATE
        kind = (fault * 4 + batch.column("initial").to_numpy()).astype(np.uint8)
        present = batch.column("present").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((unnamed[1:] != unnamed[:-1]) | (conv[1:] != conv[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if key != (unnamed[lo], conv[lo]):
                if facts:
                    done.append((*key, *facts.plan(planner)))
                key, facts = (bool(unnamed[lo]), int(conv[lo])), _Facts()
            here = np.zeros(batch.num_rows, dtype=bool)[lo:hi] | present[lo:hi]
            facts.add(kind[lo:hi][here], turn[lo:hi][here & has_turn[lo:hi]])
        yield packed()
        done = []
    if facts:
        done.append((*key, *facts.plan(planner)))
    yield packed()


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation's plan and then its turns, to the plan and then the
    turns as repaired."""
    key, audit, at, state, place, out = None, "", 0, START, 0, []
    names = [*_KEYS, "plan", "place", "edit", "role", "text"]
    plan_type = pa.struct(
        [pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [pa.field("audit", pa.string())]
    )
    kinds_of = [pa.bool_(), pa.int64(), plan_type, pa.int64(), *[pa.string()] * 3]

    def packed():
        columns = list(zip(*out)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of)], names=names)

    def turn(edit, role, text):
        nonlocal place
        out.append((*key, None, place, edit, role, text))
        place += 1

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            turn("I", "assistant" if state == USER else "user", "")
            state, at = next_state(state), at + 1

    for batch in batches:
        size = 0
        for i in range(batch.num_rows):
            plan, role, text = (batch.column(c)[i].as_py() for c in ("plan", "role", "text"))
            if plan is not None:
                if key is not None:
                    inserts()
                key = batch.column("unnamed")[i].as_py(), batch.column("conv")[i].as_py()
                audit, at, state, place = plan["audit"], 0, START, 0
                out.append((*key, plan, None, None, None, None))
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "R":
                role = "assistant" if state == USER else "user"
                state = next_state(state)
            elif edit == "K":
                state = INITIALS.index(role[0]) + 1
            if edit != "D":
                turn(edit, role, text)
            size += len(text)
            if size > 1 << 22:
                yield packed()
                out, size = [], 0
        yield packed()
        out = []
    if key is not None:
        inserts()
    yield packed()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of ``_edit``'s rows: its plan, and the SHA-256 of
    ``role:text`` lines, taken as the turns pass by."""
    head, sha, done = None, None, []

    def packed():
        unnamed, conv, plans, digests = zip(*done) if done else [()] * 4
        arrays = [pa.array(unnamed, pa.bool_()), pa.array(conv, pa.int64())]
        for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"):
            arrays.append(pa.array([p[c] for p in plans], pa.string() if c == "audit" else pa.int64()))
        arrays.append(pa.array(digests, pa.string()))
        names = [*_KEYS, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            plan = batch.column("plan")[i].as_py()
            if plan is not None:
                if head:
                    done.append((*head, sha.hexdigest()))
                head = batch.column("unnamed")[i].as_py(), batch.column("conv")[i].as_py(), plan
                sha, first = hashlib.sha256(), True
                continue
            line = f"{batch.column('role')[i].as_py()}:{batch.column('text')[i].as_py()}"
            sha.update((line if first else "\n" + line).encode())
            first = False
        yield packed()
        done = []
    if head:
        done.append((*head, sha.hexdigest()))
    yield packed()


# --- the operator --------------------------------------------------------------------------


def _rows(
    conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None
) -> DataFrame:
    conv = conversations[conv_col].cast("long")
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return conversations.select(
        conv.isNull().alias("unnamed"),
        F.coalesce(conv, F.lit(0)).cast("long").alias("conv"),
        conversations[turn_col].cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (F.lit(True) if present_col is None else F.coalesce(conversations[present_col], F.lit(False))).alias("present"),
    ).withColumn("digest", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))))


def _in_order(rows: DataFrame, *ahead: str) -> DataFrame:
    order = [*_KEYS, *ahead, F.col("turn").asc_nulls_first(), "digest"]
    return rows.repartition(*_KEYS).sortWithinPartitions(*order)


def _plans(rows: DataFrame) -> DataFrame:
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = rows.select(*_KEYS, "turn", "digest", "present", fault.alias("fault"), code.alias("initial"))
    order = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    repeated = (
        narrow.where("present")
        .groupBy(*_KEYS, "digest")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"))
        .where(F.col("first") < F.col("last"))
        .drop("last")
    )
    # rows of one turn are compared with the row before, when in order
    later = F.coalesce(order > F.col("first"), F.lit(False)) & (F.col("fault") != BLANK)
    marked = narrow.join(repeated, [*_KEYS, "digest"], "left").withColumn(
        "fault", F.when(later, DUPLICATE).otherwise(F.col("fault"))
    )
    return _in_order(marked.drop("first")).mapInArrow(_plan, f"unnamed boolean, conv long, {PLAN}")


def _edited(rows: DataFrame) -> DataFrame:
    plans = _plans(rows)
    plan = F.struct(*[c for c in plans.columns if c not in _KEYS]).alias("plan")
    heads = plans.select(*_KEYS, plan)
    union = heads.unionByName(rows.where("present").drop("present"), allowMissingColumns=True)
    ordered = _in_order(union.withColumn("is_turn", F.col("plan").isNull()), "is_turn")
    return ordered.select(*_KEYS, "plan", "role", "text").mapInArrow(
        _edit, f"unnamed boolean, conv long, plan struct<{PLAN}>, place long, edit string, role string, text string"
    )


def repaired_turns(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every repaired conversation,
    ``place`` counting from 0 and ``edit`` saying whether the turn was kept (K),
    given another role (R) or inserted (I). Rules as in ``repair_conversations``."""
    rows = _rows(conversations, conv_col, turn_col, role_col, text_col, None)
    turns = _edited(rows).where("plan is null")
    return turns.select(_named().alias("conv_id"), "place", "edit", "role", "text")


def _named() -> Column:
    return F.when(~F.col("unnamed"), F.col("conv"))


def repair_conversations(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present_col: str | None = None,
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), a row for each conversation.

    Rows count in the order of their turns, null turns first; rows of one turn in the
    order of the MD5 of role and text, so equal rows are neighbours. A row is blank if
    its text has nothing but blanks, else a duplicate if an earlier row has its role
    and text, else truncated if its text does not end in ``.``, ``!`` or ``?``. ``gaps``
    are turns missing between the least and the largest; ``illegal`` counts
    neighbours whose roles' first letters are not su, ua or au. ``cost`` is that of the
    cheapest edits after which the roles read ``(s?(ua)+)?``; ``audit`` has their first
    letters (keep, rerole, delete, insert), the least in ASCII of equally cheap ones;
    ``repaired_sha256`` is that of the repaired ``role:text`` lines.

    Rows are not gathered: two passes run over each conversation's rows in order, the
    first on a digest and a byte of each row, the second on the texts, hashing as they
    pass. What a task holds of a conversation is a byte a row, as the audit does.
    Its hash is a chain, so one conversation's texts do pass through one task.

    Null roles and texts count as one blank. Rows with a null conversation are one
    conversation with a null id. With ``present_col``, rows where it is not true only
    name their conversation; one with no other rows has zeros, an empty audit and the
    hash of the empty text. Other columns are ignored; an empty table gives an empty
    result.
    """
    rows = _rows(conversations, conv_col, turn_col, role_col, text_col, present_col)
    found = _edited(rows).mapInArrow(_digest, f"unnamed boolean, conv long, {PLAN}, repaired_sha256 string")
    return found.withColumn("conv_id", _named()).select(
        "conv_id", *[c for c in found.columns if c not in _KEYS]
    )


def damaged(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``conversations`` (conv_id, turn, role, text) with known damage, and
    ``present``: by the CRC-32 of ``conv_id:turn`` modulo 20, a row is dropped (0: it
    stays with ``present`` false, to name its conversation), emptied (1), loses
    its ``.``, ``!`` and ``?`` (2), is repeated (3) or becomes the user's (4). Nulls
    count as one blank in the checksum, and roles and texts become one."""
    blank = F.lit(" ")
    conv, turn, role, text = (conversations[c] for c in (conv_col, turn_col, role_col, text_col))
    name = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    lot = F.crc32(name.cast("binary")) % 20
    texts = F.coalesce(text, blank)
    copies = F.when(lot == 0, F.array(F.lit(False))).when(lot == 3, F.array(F.lit(True), F.lit(True)))
    return conversations.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.when(lot == 4, F.lit("user")).otherwise(F.coalesce(role, blank)).alias("role"),
        F.when(lot == 1, F.lit("")).when(lot == 2, F.regexp_replace(texts, "[.!?]", "")).otherwise(texts).alias("text"),
        F.explode(copies.otherwise(F.array(F.lit(True)))).alias("present"),
    )
