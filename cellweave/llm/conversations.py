"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

Roles are read by their initials and must spell ``(s?(ua)+)?``, so a conversation is in one of four states: nothing
said, only the system, a user's turn last, an assistant's turn last. A forward Viterbi pass over the rows of a
conversation carries, for each state, the least (cost, audit string); a row is kept, given another role or deleted,
and each layer is closed with at most two inserted turns, which lead from any state to any other of the last two.

Rows for that pass are small: they hold hashes (128 bits) for texts, and rows that are equal in all are one with a
number. They are dealt by ranges of (conversation, turn), so a conversation of any size is cut into pieces. A piece
that may start inside a conversation is solved from each state; pieces are then put together in order. Where two
audits end in one state after the same rows at the same cost, neither is a prefix of the other (the letters fix the
cost), so the least audit of a whole is made of least audits of its pieces. Only the last step, in which texts stream
past the audit of their conversation, takes a conversation in one task, with a batch of its rows at a time.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.exprs import TEXTS
from cellweave.plans.lineage import cut

#: States: nothing yet, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: White space (the characters 0x20 and 0x09 to 0x0D) and what ends a sentence.
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: An audit string is shortened by what all states share when it is longer than this.
LONG_AUDIT = 256
#: Rows of a task, about; small ones, without texts.
ROWS_A_TASK = 200_000

States = list[tuple[int, str] | None]


def _spoken(state: int) -> int:
    """The state after the next turn that isn't the system's."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The state after a turn of that initial; None if it may not come here."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _offer(states: States, at: int, cost: int, audit: str) -> None:
    if states[at] is None or (cost, audit) < states[at]:
        states[at] = (cost, audit)


def _closed(states: States) -> States:
    """``states`` with inserted turns where these are cheaper: a user's, an assistant's, or one of each."""
    for at in (NOTHING, SYSTEM, ASSISTANT):
        if states[at] is not None:
            _offer(states, USER, states[at][0] + INSERT_COST, states[at][1] + INSERT)
    if states[USER] is not None:
        _offer(states, ASSISTANT, states[USER][0] + INSERT_COST, states[USER][1] + INSERT)
    return states


def _pruned(states: States) -> States:
    """Without states that no cheapest conversation passes. What follows a state without a user's turn can follow an
    assistant's for no more (a system's turn deleted), or a user's with one turn inserted."""
    user, assistant = ((s[0] if s else None) for s in states[USER:])
    for at, more in ((NOTHING, DELETE_COST), (SYSTEM, 0)):
        bounds = [c + more + extra for c, extra in ((assistant, 0), (user, INSERT_COST)) if c is not None]
        if states[at] is not None and bounds and states[at][0] > min(bounds):
            states[at] = None
    return states


def _after(states: States, initial: str, forced: bool, truncated: bool) -> States:
    """The layer after one row, which must be deleted if ``forced``."""
    new: States = [None] * 4
    for at, s in enumerate(states):
        if s is None:
            continue
        cost, audit = s
        _offer(new, at, cost + DELETE_COST, audit + DELETE)
        if not forced:
            to = _kept(at, initial)
            if to is not None:
                _offer(new, to, cost + truncated * TRUNCATED_COST, audit + KEEP)
            _offer(new, _spoken(at), cost + REROLE_COST + truncated * TRUNCATED_COST, audit + REROLE)
    return _pruned(_closed(new))


def _deleted(states: States, n: int) -> States:
    """The layer after ``n`` rows that must be deleted: inserted turns come last, as D is less than I."""
    return _pruned(_closed([s and (s[0] + n * DELETE_COST, s[1] + DELETE * n) for s in states]))


class Path:
    """Least (cost, audit) of each state, from one start; what the audits of all states share is put aside."""

    def __init__(self, states: States):
        self.states, self.shared, self.size = states, [], 0

    def row(self, initial: str, blank: bool, first: bool, truncated: bool, n: int) -> None:
        """``n`` equal rows, of which only the first of a conversation's is no duplicate."""
        if not blank and first:
            self.states, n = _after(self.states, initial, False, truncated), n - 1
        if n:
            self.states = _deleted(self.states, n)
        longest = max(len(s[1]) for s in self.states if s)
        if longest > LONG_AUDIT + self.size:
            live = [s[1] for s in self.states if s]
            common = os.path.commonprefix(live)
            self.shared.append(common)
            self.states = [s and (s[0], s[1][len(common) :]) for s in self.states]
            self.size = max(len(a) for a in live) - len(common)

    def found(self) -> tuple[list[int | None], list[str | None]]:
        before = "".join(self.shared)
        return [s and s[0] for s in self.states], [s and before + s[1] for s in self.states]


def begun() -> States:
    """What may stand before the first row."""
    return _closed([(0, ""), None, None, None])


def joined(states: States, costs: list[int | None], audits: list[str | None]) -> States:
    """``states`` after a piece whose least costs and audits are given for each start and end, or for the begun conversation."""
    if len(costs) == 4:
        return [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    new: States = [None] * 4
    for start, s in enumerate(states):
        for end in range(4) if s else ():
            if costs[4 * start + end] is not None:
                _offer(new, end, s[0] + costs[4 * start + end], s[1] + audits[4 * start + end])
    return _pruned(new)


def ended(states: States) -> tuple[int, str]:
    """(cost, audit) of the whole: nothing said, or an assistant's turn last."""
    return min(s for s in (states[NOTHING], states[ASSISTANT]) if s)


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]


def usable_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn (bigint), role, text and copies (1 if there is no such column): null roles and texts are one space."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))


def faults(turns: DataFrame) -> DataFrame:
    """A row for equal rows of ``usable_turns``, without the text: conv_id, turn, role, h1, h2, n, blank, truncated,
    first (no row before has the same role and text)."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    stopped = F.substring(trimmed, -1, 1).isin(*STOPS)
    small = turns.filter("copies > 0").select("conv_id", "turn", "role", *_hashes(F.col("text")), "copies", (trimmed == "").alias("blank"), (~stopped).alias("truncated"))
    same = ["conv_id", "role", "h1", "h2"]
    # counted before the shuffle, so that a row that a third of the table repeats is one for each task
    runs = cut(small.groupBy("conv_id", "turn", "role", "h1", "h2").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")))
    again = runs.groupBy(*same).agg(F.min(F.struct("turn")).alias("least"), F.count(F.lit(1)).alias("runs")).filter("runs > 1")
    other = again.select(*[F.col(c).alias(f"o_{c}") for c in same], F.col("least.turn").alias("o_turn"))
    at = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in same]
    first = F.col("o_role").isNull() | F.col("turn").eqNullSafe(F.col("o_turn"))
    return runs.join(other, at[0] & at[1] & at[2] & at[3], "left").select("conv_id", "turn", "role", "h1", "h2", "n", "blank", "truncated", first.alias("first"))


#: What is known of a piece of a conversation.
PIECE = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), "bigint") | dict.fromkeys(("first_initial", "last_initial"), "string") | dict.fromkeys(("least", "most", "turns"), "bigint") | {"costs": "array<bigint>", "audits": "array<string>"}
PIECE_TYPE = f"struct<{', '.join(f'{k}: {t}' for k, t in PIECE.items())}>"


class _Piece:
    """The rows of one conversation that one task sees."""

    def __init__(self, conv_id, whole: bool):
        self.conv_id = conv_id
        self.paths = [Path(begun())] if whole else [Path([(0, "") if k == start else None for k in range(4)]) for start in range(4)]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_initial = self.last_initial = self.least = self.most = None

    def add(self, turn: int | None, role: str, n: int, blank: bool, truncated: bool, first: bool) -> None:
        initial = role[:1]
        if self.last_initial is not None:
            self.illegal += self.last_initial + initial not in ("su", "ua", "au")
        else:
            self.first_initial = initial
        self.illegal += n - 1  # equal initials side by side
        self.last_initial = initial
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if blank:
            self.blank += n
        else:
            self.duplicate += n - first
            self.truncated += first and truncated
        for p in self.paths:
            p.row(initial, blank, first, truncated, n)

    def row(self) -> dict:
        found = [p.found() for p in self.paths]
        return {k: getattr(self, k) for k in list(PIECE)[:9]} | {"costs": [c for f in found for c in f[0]], "audits": [a for f in found for a in f[1]]}


def _arrow_type(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}[kind]


_PIECE_ARROW = pa.struct([(k, _arrow_type(t)) for k, t in PIECE.items()])


def pieces(marked: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """conv_id, part (they are in order), piece of each conversation of ``faults``, dealt by ranges."""
    by = ["conv_id", "turn", "role", "h1", "h2"]
    kind = marked.schema["conv_id"].dataType.simpleString()
    marked = cut(marked)
    usual = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionByRange(max(usual, -(-marked.count() // rows_a_task)), *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, done = TaskContext.get().partitionId(), None, []

        def sent(rows: list[_Piece]) -> pa.RecordBatch:
            ids = pa.array([p.conv_id for p in rows], _arrow_type(kind))
            return pa.RecordBatch.from_arrays([ids, pa.array([part] * len(rows), pa.int32()), pa.array([p.row() for p in rows], _PIECE_ARROW)], ["conv_id", "part", "piece"])

        for b in batches:
            for conv, *row in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "blank", "truncated", "first")], strict=True):
                if now is None or conv != now.conv_id:
                    done += [now] if now else []
                    now = _Piece(conv, whole=now is not None)  # the first of a task may have begun in the one before
                now.add(*row)
            if len(done) >= TEXTS:
                yield sent(done)
                done = []
        if now:
            yield sent([*done, now])

    return dealt.select("conv_id", "turn", "role", "n", "blank", "truncated", "first").mapInArrow(run, f"conv_id {kind}, part int, piece {PIECE_TYPE}")


class _Whole:
    """A conversation while its pieces, and then its rows, stream past."""

    def __init__(self, conv_id):
        self.conv_id, self.states, self.last_initial, self.most = conv_id, begun(), None, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least, self.cost, self.audit = None, 0, ""
        self.at, self.state = 0, NOTHING

    def piece(self, p: dict) -> None:
        for k in self.counts:
            self.counts[k] += p[k]
        if self.last_initial is not None:
            self.counts["illegal"] += self.last_initial + p["first_initial"] not in ("su", "ua", "au")
        self.last_initial = p["last_initial"]
        if p["least"] is not None:
            self.counts["turns"] -= p["least"] == self.most
            self.least = p["least"] if self.least is None else self.least
            self.most = p["most"]
        self.states = joined(self.states, p["costs"], p["audits"])
        self.cost, self.audit = ended(self.states)

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.counts["turns"]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns inserted here."""
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at, self.state = self.at + 1, _spoken(self.state)
            yield INSERT, ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that a row, and what is inserted before it, become."""
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == KEEP:
            self.state = _kept(self.state, role[:1])
            yield edit, role, text
        elif edit == REROLE:
            self.state = _spoken(self.state)
            yield edit, ROLE[self.state], text


def _streamed(turns: DataFrame) -> DataFrame:
    """conv_id, kind (-1: a conversation, 0: its pieces in order, 1: its rows in order), part, piece, role, text, copies."""
    found = pieces(faults(turns))
    none = lambda kind: F.lit(None).cast(kind)
    wide = {"turn": "long", "h1": "long", "h2": "long", "part": "int", "piece": PIECE_TYPE, "role": "string", "text": "string", "copies": "long"}
    fill = lambda df, kind: df.select("conv_id", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else none(t).alias(c) for c, t in wide.items()])
    spoken = turns.filter("copies > 0").select("conv_id", "turn", "role", "text", "copies", *_hashes(F.col("text")))
    every = fill(turns.select("conv_id").distinct(), -1).unionByName(fill(found, 0)).unionByName(fill(spoken, 1))
    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "turn", "role", "h1", "h2")
    return ordered.select("conv_id", "kind", "piece", "role", "text", "copies")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Whole, Iterator[tuple[str, str, str]] | None]]:
    """Each conversation with the turns that come next; with None after the last."""
    now = None
    for b in (x.slice(at, TEXTS) for x in batches for at in range(0, x.num_rows, TEXTS)):
        for conv, kind, piece, role, text, copies in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if kind < 0:
                if now:
                    yield now, now.inserted()
                    yield now, None
                now = _Whole(conv)
            elif kind == 0:
                now.piece(piece)
            else:
                for _ in range(copies):
                    yield now, now.row(role, text)
    if now:
        yield now, now.inserted()
        yield now, None


def repair_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K: kept, R: given another role, I: inserted), role, text of the repaired conversations.

    See ``repair_summaries`` for what is repaired and how.
    """
    stream = _streamed(usable_turns(rows))
    kind = stream.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "place", "edit", "role", "text"]
    types = [_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        for whole, coming in _replayed(batches):
            if coming is None:
                place = 0
                continue
            for edit, role, text in coming:
                out.append((whole.conv_id, place, edit, role, text))
                place += 1
            if len(out) >= TEXTS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return stream.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def repair_summaries(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, and copies, the times a row stands there;
    0 only names the conversation): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first; equal turns by role and a hash of the text, equal rows side by side). Each
    row's first fault counts: blank, duplicate (role and text seen before), truncated (no stop at the end). Blank and
    duplicate rows are deleted. Null roles and texts are one space, so such a text is blank; an empty role has no
    initial and can't be kept. A null conv_id is a conversation of its own. A conversation without rows has zeros, an
    empty audit and the hash of nothing; an empty table gives no rows. Other columns don't matter.
    """
    stream = _streamed(usable_turns(rows))
    kind = stream.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, lines = [], hashlib.sha256(), 0
        for whole, coming in _replayed(batches):
            if coming is not None:
                for _, role, text in coming:
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
                continue
            counts = [whole.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")]
            out.append((whole.conv_id, whole.gaps, *counts, whole.cost, whole.audit, digest.hexdigest()))
            digest, lines = hashlib.sha256(), 0
            if len(out) >= TEXTS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return stream.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of ``conversations``: by the checksum of id and turn some rows are dropped (no
    copies), emptied, robbed of their stops, repeated, or made the user's. Nulls are one space."""
    space = F.lit(" ")
    lot = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.translate(F.coalesce("text", space), STOPS, "")).otherwise(F.coalesce("text", space))
    role = F.when(lot == 4, "user").otherwise(F.coalesce("role", space))
    copies = F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).cast("long")
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
