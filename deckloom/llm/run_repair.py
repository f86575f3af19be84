"""Structure repair of the messages of traced agent runs: the cheapest audited edits that make them well formed.

A run reads well if it has no messages, or one of the system at most and then user and assistant in turns. A dynamic program goes
through the messages of a run in order with one best edit history for each of four states. Histories are persistent: each
is the last node of a chain that shares its beginning with others, with binary-lifting ancestors and a rolling
hash of all edits so far. Histories of equal cost are told apart by their longest common prefix, found by lifting both while
hashes differ; that equal hashes mean equal edits is verified. What all histories that are left share is handed out at once, so
that a run of any length passes through a task in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import give_back

#: Costs of the edits: keep, rerole, delete, insert; and of leaving a message that breaks off.
KEEP, REROLE, DELETE, INSERT, BROKEN_OFF = 0, 2, 3, 2, 1
#: States: nothing yet, after the system's message, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that one more message by user or assistant leads to, and who that is.
NEXT = (USER, USER, ASSISTANT, USER)
SPEAKER = ("user", "user", "assistant", "user")
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What it costs at most to go on from the second state as from the first: a dearer history is dropped.
INSTEAD = {(START, SYSTEM): 2 * INSERT, (START, USER): INSERT + DELETE, (START, ASSISTANT): DELETE,
           (SYSTEM, START): 0, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 0,
           (USER, START): INSERT, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
           (ASSISTANT, START): 0, (ASSISTANT, SYSTEM): 2 * INSERT, (ASSISTANT, USER): INSERT}
#: Faults of a message.
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: Base and modulus of the rolling hash; messages between two looks at what all histories share.
BASE, MODULUS, LOOK = 1_000_003, (1 << 61) - 1, 64
_LEFT = " \t\n\x0b\x0c\r"
_EDITS = [("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
          ("given_role", pa.string()), ("fault", pa.string())]
_EDITS_DDL = "place long, edit string, turn long, role string, text string, given_role string, fault string"
_REPORT = [*[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
           ("repaired_sha256", pa.string())]
_REPORT_DDL = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class History:
    """The last edit of a chain of edits; ``up[j]`` is the edit 2^j before it."""

    __slots__ = ("up", "depth", "hash", "edit", "message")

    def __init__(self, before: History | None, edit: str = "", message: tuple | None = None, least: int = 0) -> None:
        self.edit, self.message = edit, message
        if before is None:
            self.up, self.depth, self.hash = [], 0, 0
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * BASE + ord(edit)) % MODULUS
        up, node, j = [before], before, 0
        # Nothing reaches back beyond the edits that were handed out.
        while j < len(node.up) and node.up[j].depth >= least:
            node = node.up[j]
            up.append(node)
            j += 1
        self.up = up


def _lifted(node: History, depth: int) -> History:
    while node.depth > depth:
        node = node.up[min((node.depth - depth).bit_length(), len(node.up)) - 1]
    return node


def _first_difference(a: History, b: History) -> tuple[str, str] | None:
    """The first edits in which two chains of one length differ, edit by edit back to what they share."""
    found = None
    while a is not b:
        if a.edit != b.edit:
            found = a.edit, b.edit
        a, b = a.up[0], b.up[0]
    return found


def precedes(a: History, b: History) -> bool:
    """Whether the edits of ``a`` come before those of ``b`` in ASCII order (a beginning comes before the whole)."""
    shorter = a.depth < b.depth
    depth = min(a.depth, b.depth)
    a, b = _lifted(a, depth), _lifted(b, depth)
    if a is b:
        return shorter
    if a.hash != b.hash:
        for j in range(min(len(a.up), len(b.up)) - 1, -1, -1):
            if j < len(a.up) and j < len(b.up) and a.up[j].hash != b.up[j].hash:
                a, b = a.up[j], b.up[j]
        # Here the hashes of all edits before agree: they are the longest common prefix, if no hashes collide.
        if _first_difference(a.up[0], b.up[0]) is None:
            return a.edit < b.edit
    different = _first_difference(a, b)
    return shorter if different is None else different[0] < different[1]


def _shared(a: History, b: History) -> History:
    """The last edit that two chains share."""
    depth = min(a.depth, b.depth)
    a, b = _lifted(a, depth), _lifted(b, depth)
    if a is b:
        return a
    for j in range(min(len(a.up), len(b.up)) - 1, -1, -1):
        if j < len(a.up) and j < len(b.up) and a.up[j] is not b.up[j]:
            a, b = a.up[j], b.up[j]
    return a.up[0]


class Repair:
    """The edits of one run: messages go in one by one, edits come out in order."""

    def __init__(self) -> None:
        self.root = History(None)
        self.front: list[tuple[int, History] | None] = [(0, self.root), None, None, None]
        self.state, self.seen = START, 0

    def _offer(self, front: list, state: int, cost: int, before: History, edit: str, message: tuple | None) -> None:
        held = front[state]
        if held is not None and held[0] < cost:
            return
        node = History(before, edit, message, self.root.depth)
        if held is None or cost < held[0] or precedes(node, held[1]):
            front[state] = cost, node

    def _inserted(self) -> list:
        front = list(self.front)
        for state, held in enumerate(self.front):
            if held is not None:
                self._offer(front, NEXT[state], held[0] + INSERT, held[1], "I", None)
        return front

    def add(self, message: tuple) -> list[tuple[str, tuple | None, str]]:
        """``message``: turn, role, text, fault. Returns the edits that are now certain."""
        _, role, _, fault = message
        front, now = self._inserted(), [None] * 4
        open_ = fault not in (BLANK, DUPLICATE)
        left = BROKEN_OFF if fault == TRUNCATED else 0
        for state, held in enumerate(front):
            if held is None:
                continue
            cost, before = held
            self._offer(now, state, cost + DELETE, before, "D", message)
            if open_:
                kept = KEPT.get((state, role[:1]))
                if kept is not None:
                    self._offer(now, kept, cost + KEEP + left, before, "K", message)
                self._offer(now, NEXT[state], cost + REROLE + left, before, "R", message)
        for (state, other), slack in INSTEAD.items():
            if now[state] is not None and now[other] is not None and now[state][0] > now[other][0] + slack:
                now[state] = None
        self.front = now
        self.seen += 1
        return self._hand_out(self._common()) if self.seen % LOOK == 0 else []

    def _common(self) -> History:
        alive = [held[1] for held in self.front if held is not None]
        node = alive[0]
        for other in alive[1:]:
            node = _shared(node, other)
        return node

    def _hand_out(self, upto: History) -> list[tuple[str, tuple | None, str]]:
        """Edits up to a node, with the role that each message has afterwards."""
        chain, node = [], upto
        while node is not self.root:
            chain.append(node)
            node = node.up[0]
        out = []
        for node in reversed(chain):
            role = node.message[1] if node.message else ""
            if node.edit == "K":
                self.state = KEPT[self.state, role[:1]]
            elif node.edit != "D":
                role, self.state = SPEAKER[self.state], NEXT[self.state]
            out.append((node.edit, node.message, role))
        self.root = upto
        upto.up = []
        return out

    def finish(self) -> list[tuple[str, tuple | None, str]]:
        front = self._inserted()
        best = front[START]
        if front[ASSISTANT] is not None and (best is None or front[ASSISTANT][0] < best[0] or (
                front[ASSISTANT][0] == best[0] and precedes(front[ASSISTANT][1], best[1]))):
            best = front[ASSISTANT]
        return self._hand_out(best[1])


def _edits_of(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Edit rows of one run from its message rows ``at, turn, role, text, trouble, first_at`` in order."""
    repair, place, before, any_rows = Repair(), 0, None, False

    def out(edits):
        nonlocal place
        for edit, message, role in edits:
            place += 1
            turn, given, text, fault = message or (None, None, "", None)
            yield place, edit, turn, role, text, given, fault

    for at, turn, role, text, trouble, first_at in rows:
        if role is None:
            continue
        any_rows = True
        again = first_at is not None and (at > first_at or before == (at, role, text))
        fault = BLANK if trouble == BLANK else DUPLICATE if again else trouble
        yield from out(repair.add((turn, role, text, fault)))
        before = at, role, text
    yield from out(repair.finish())
    if not any_rows:
        yield 0, None, None, None, None, None, None


def _batches(rows: Iterator[tuple], fields: list, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    kinds = [("trace_id", key_type), *fields]
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, (_, t) in enumerate(kinds)],
                                          names=[n for n, _ in kinds])

    for row in rows:
        held.append(row)
        size += 64 + len(row[5] or "") if fields is _EDITS else 256
        if size >= 4 << 20:
            yield batch()
            held, size = [], 0
            give_back()
    if held:
        yield batch()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for trace_id, own in groupby(rows, key=lambda r: r[0]):
        yield trace_id, (r[1:] for r in own)


def _trouble(text: Column) -> Column:
    ends = F.rtrim(text, F.lit(_LEFT))
    return F.when(ends == "", BLANK).when(~F.substring(ends, -1, 1).isin(".", "!", "?"), TRUNCATED)


def repair_messages(messages: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """The edits that repair each run, one row for each, in order: ``trace_id, place, edit, turn, role, text, given_role, fault``.

    ``messages``: ``trace_id, turn, role, text`` (more columns are left aside); ``traces``: ``trace_id`` of runs that are returned even without
    messages, as one row of place 0 and no edit. ``edit`` is K (kept), R (now spoken by user or assistant), D (deleted) or I (an empty
    message of user or assistant inserted); ``role`` and ``text`` are the message's afterwards, ``given_role`` its role before,
    ``fault`` is ``blank``, ``duplicate`` (role and text came before in the run), ``truncated`` (does not end in ``.``, ``!`` or ``?``) or null,
    the first that applies. Blank and duplicate messages are always deleted. The edits are the cheapest ones, among them those whose letters come
    first in ASCII order.

    Messages are taken by turn, a null turn first, those of one turn by role and text. Null roles and texts are single spaces, a null trace is
    a run of its own, repeated rows are duplicates, an empty table gives no rows. The order of a run is one stream through one
    task, as its edits are; a task holds no more than the messages that are still undecided. Which texts came
    before is found by a combining aggregate over all tasks. The rows of a run come in order, within one partition: store them with ``place``.
    """
    key_type = messages.schema["trace_id"].dataType
    at = F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 63)))
    role, text = (F.coalesce(F.col(n), F.lit(" ")).alias(n) for n in ("role", "text"))
    rows = messages.select("trace_id", at.alias("_at"), F.col("turn").cast("bigint").alias("turn"), role, text)
    keys = ["trace_id", "role", "_digest"]
    rows = rows.withColumn("_digest", F.sha2("text", 256))
    firsts = rows.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    same = F.col("rows.trace_id").eqNullSafe(F.col("firsts.trace_id"))
    for name in keys[1:]:
        same = same & (F.col(f"rows.{name}") == F.col(f"firsts.{name}"))
    known = rows.alias("rows").join(firsts.alias("firsts"), same, "left").select(
        "rows.trace_id", "rows._at", "rows.turn", "rows.role", "rows.text", _trouble(F.col("rows.text")).alias("_trouble"), "firsts._first")
    if traces is not None:
        empty = [F.lit(None).cast(t).alias(n) for n, t in known.dtypes[1:]]
        known = known.unionByName(traces.select("trace_id").distinct().select(F.col("trace_id").cast(key_type), *empty))
    ordered = known.repartition("trace_id").sortWithinPartitions("trace_id", "_at", "role", "text")
    arrow_type = _arrow_type(ordered)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((trace_id, *edit) for trace_id, own in _runs(batches) for edit in _edits_of(own)), _EDITS, arrow_type)

    return ordered.mapInArrow(edits, f"trace_id {key_type.simpleString()}, {_EDITS_DDL}")


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["trace_id"].dataType)


def _report_of(edits: Iterable[tuple]) -> tuple:
    """The facts of one run from its edits in order."""
    faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
    turns, least, most, last, illegal, cost = 0, None, None, None, 0, 0
    audit, digest, before, first = [], hashlib.sha256(), None, True
    for _, edit, turn, role, text, given, fault in edits:
        if edit is None:
            continue
        audit.append(edit)
        if edit != "I":
            if fault:
                faults[fault] += 1
            if before is not None and before + given[:1] not in ("su", "ua", "au"):
                illegal += 1
            before = given[:1]
            if turn is not None:
                turns += turn != last
                last, most = turn, turn
                least = turn if least is None else least
        cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (edit in "KR" and fault == TRUNCATED) * BROKEN_OFF
        if edit != "D":
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
    gaps = most - least + 1 - turns if turns else 0
    return gaps, *faults.values(), illegal, cost, "".join(audit), digest.hexdigest()


def repair_report(edits: DataFrame) -> DataFrame:
    """Facts of each run from its edits (a result of ``repair_messages``, straight from it or sorted within partitions again).

    ``trace_id``, ``gaps`` (turns between the first and last that no message has), messages that are ``blank``, ``duplicate`` and
    ``truncated``, ``illegal`` neighbours of roles, the ``cost`` of all edits, ``audit`` (their letters) and ``repaired_sha256`` (of the repaired
    messages as ``role:text`` lines). Null turns do not count; a run without messages has zeros, no letters and the digest of nothing.
    """
    key_type, arrow_type = edits.schema["trace_id"].dataType, _arrow_type(edits)

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((trace_id, *_report_of(own)) for trace_id, own in _runs(batches)), _REPORT, arrow_type)

    return edits.mapInArrow(reports, f"trace_id {key_type.simpleString()}, {_REPORT_DDL}")
