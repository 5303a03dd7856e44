import hashlib
import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from cellweave.llm import conversations
from tests.llm.helpers import CLASHING

LEGAL = re.compile(r"(s?(ua)+)?")
FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def marked(rows):
    """(role, text, fault) of a conversation's ordered rows."""
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def all_edits(rows):
    """(cost, audit, turns) of the cheapest, least edits of a conversation, from every combination of them."""
    between = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    choices = []
    for role, text, fault in marked(rows):
        own = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            cut = int(fault == "truncated")
            own += [("K", cut, (role, text))] + [("R", 2 + cut, (r, text)) for r in ("user", "assistant")]
        choices += [[("I" * len(b), 2 * len(b), b) for b in between], own]
    choices.append([("I" * len(b), 2 * len(b), b) for b in between])
    best = None
    for picked in itertools.product(*choices):
        cost, audit = sum(p[1] for p in picked), "".join(p[0] for p in picked)
        if best is not None and (cost, audit) > best[:2]:
            continue
        turns = []
        for k, p in enumerate(picked):
            turns += [(r, "") for r in p[2]] if k % 2 == 0 else [p[2]] if p[2] else []
        if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in turns)):
            best = (cost, audit, turns)
    return best


def told(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def test_repairs_equal_all_edits(spark):
    rng = np.random.default_rng(5)
    texts = ["Well.", "So what?", "cut off", "", " \t\r", "Well. ", "no\x85"]
    rows, want = [], {}
    for conv in range(160):
        talk = [(str(rng.choice(["user", "assistant", "system", "tool"], p=[0.4, 0.35, 0.15, 0.1])), str(rng.choice(texts))) for _ in range(int(rng.integers(1, 4)))]
        rows += [(conv, turn, role, text) for turn, (role, text) in enumerate(talk)]
        cost, audit, turns = all_edits(talk)
        faults = [f for *_, f in marked(talk)]
        initials = [r[0] for r, _ in talk]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        want[conv] = (0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, told(turns))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r[f] for f in FIELDS[1:]) for r in conversations.repair_summaries(frame.repartition(7)).collect()}
    assert got == want
    said = {}
    for r in conversations.repair_turns(frame).orderBy("conv_id", "place").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(told(said.get(c, [])) == w[-1] for c, w in want.items())


def test_a_long_conversation_is_solved_in_pieces(spark):
    """A conversation over all partitions has the result of one pass over its rows."""
    rng = np.random.default_rng(9)
    talk = [(str(rng.choice(["user", "assistant", "system"])), str(rng.choice(["Yes.", "cut", "", "No!", f"{k} words."], p=[0.05, 0.05, 0.05, 0.05, 0.8]))) for k in range(3000)]
    path, audits = conversations.Path(conversations.begun()), None
    for role, text, fault in marked(talk):
        path.row(role[0], fault == "blank", fault != "duplicate", fault == "truncated", 1)
    costs, audits = path.found()
    cost, audit = conversations.ended([None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)])
    turns, state, at = [], conversations.NOTHING, 0
    for letter in audit:
        role, text = talk[at] if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "K":
            state = conversations._kept(state, role[0])
            turns.append((role, text))
        elif letter in "RI":
            state = conversations._spoken(state)
            turns.append((conversations.ROLE[state], text))
    rows = [(1, k, r, t) for k, (r, t) in enumerate(talk)] + [(c, 0, "user", "Alone.") for c in (0, 2, 3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    dealt = conversations.pieces(conversations.faults(conversations.usable_turns(frame)))
    assert dealt.filter("conv_id = 1").count() > 1
    got = {r.conv_id: r for r in conversations.repair_summaries(frame).collect()}
    assert (got[1].cost, got[1].audit, got[1].repaired_sha256) == (cost, audit, told(turns))
    assert got[1].gaps == 0 and got[1].illegal == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(talk))
    assert LEGAL.fullmatch("".join(r[0] for r, _ in turns)) and got[0].audit == "KI"


def test_dropped_states_are_on_no_cheapest_path(monkeypatch):
    rng = np.random.default_rng(3)
    talks = [[(str(rng.choice(list("suax"))), bool(rng.random() < 0.3), bool(rng.random() < 0.8), bool(rng.random() < 0.3), int(rng.integers(1, 4))) for _ in range(12)] for _ in range(300)]

    def solve(talk):
        path = conversations.Path(conversations.begun())
        for row in talk:
            path.row(*row)
        costs, audits = path.found()
        return conversations.ended([None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)])

    pruned = [solve(t) for t in talks]
    monkeypatch.setattr(conversations, "LONG_AUDIT", 3)
    assert [solve(t) for t in talks] == pruned
    monkeypatch.setattr(conversations, "_pruned", lambda states: states)
    assert [solve(t) for t in talks] == pruned


def test_awkward_rows(spark):
    rows = [
        (1, 0, "user", None), (1, None, None, "Who."), (None, 4, "assistant", "Nobody."), (None, 2, "user", "Null."), (2, 3, "", "Empty role."),
        (3, 1, "user", "Hi. " * 50_000), (3, 9, "assistant", "Ho."), (3, 9, "assistant", "Ho."), (3, 5, "assistant", "Ho."), (4, None, "user", "A."), (4, None, "user", "A."),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert conversations.repair_summaries(frame.limit(0)).collect() == [] and conversations.repair_turns(frame.limit(0)).collect() == []
    got = {r.conv_id: tuple(r[f] for f in FIELDS[1:8]) for r in conversations.repair_summaries(frame).collect()}
    assert got == {
        1: (0, 1, 0, 0, 1, 6, "DD"),  # the row without a turn comes first
        None: (1, 0, 0, 0, 0, 0, "KK"),
        2: (0, 0, 0, 0, 0, 3, "D"),
        3: (6, 0, 2, 0, 2, 6, "KKDD"),
        4: (0, 0, 1, 0, 1, 5, "KDI"),
    }
    clashing = frame.select("*", *[F.lit(c).alias(c) for c in (*CLASHING, "kind", "part", "piece", "n", "h1", "h2") if c not in frame.columns])
    assert sorted(conversations.repair_summaries(clashing).collect(), key=repr) == sorted(conversations.repair_summaries(frame).collect(), key=repr)


def test_a_conversation_that_lost_its_rows(spark):
    import zlib

    conv = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turned = next(t for t in range(100) if zlib.crc32(f"{conv}:{t}".encode()) % 20 == 3)
    frame = spark.createDataFrame([(conv, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    row = conversations.repair_summaries(conversations.damaged(frame)).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    twice = spark.createDataFrame([(conv, turned, "user", "Twice.")], frame.schema)
    row = conversations.repair_summaries(conversations.damaged(twice)).first()
    assert (row.duplicate, row.audit, row.cost, row.illegal) == (1, "KDI", 5, 1)
