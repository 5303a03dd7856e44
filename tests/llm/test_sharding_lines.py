import random
import zlib
from collections import defaultdict

import pytest

from cellweave.llm import linededup, sharding
from tests.llm.helpers import AWKWARD, collected, documents
from tests.oracle import connect, differences


def shard_rows(frame):
    return [r.asDict() for r in frame.collect()]


@pytest.mark.parametrize("hot", [0, 700], ids=["even", "one text in a third of the rows"])
def test_shards_are_near_equal_and_slots_gapless(spark, hot):
    rng = random.Random(1)
    rows = [(i, f"text {i} " * rng.randint(1, 30)) for i in range(1400)] + [(5000 + i, "the same " * 25) for i in range(hot)]
    out = shard_rows(sharding.shard_documents(documents(spark, rows)))
    size = {i: len(t.encode()) + 1 for i, t in rows}
    assert {r["doc_id"]: r["size"] for r in out} == size and len(out) == len(rows)
    assert all(r["text_crc32"] == zlib.crc32(t.encode()) for r, (_, t) in zip(sorted(out, key=lambda r: r["doc_id"]), sorted(rows), strict=True))
    held, slots = defaultdict(int), defaultdict(list)
    for r in out:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(held) == set(range(8))
    fair = sum(size.values()) / 8
    assert max(abs(b - fair) for b in held.values()) <= 0.01 * fair + max(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_small_groups_stay_together(spark):
    rows = [(i, f"text number {i // 3} " * 20) for i in range(3000)]
    shards = defaultdict(set)
    for r in shard_rows(sharding.shard_documents(documents(spark, rows))):
        shards[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_sharding_awkward_and_empty(spark):
    out = shard_rows(sharding.shard_documents(documents(spark, AWKWARD)))
    assert len(out) == len(AWKWARD)
    assert next(r for r in out if r["doc_id"] == 1)["size"] == 1 and next(r for r in out if r["doc_id"] == 1)["text_crc32"] == 0
    assert sharding.shard_documents(documents(spark, [])).count() == 0
    two = shard_rows(sharding.shard_documents(documents(spark, [(1, "a"), (2, "b")]), shards=2))
    assert sorted(r["shard"] for r in two) == [0, 1]


def brute_dedup(rows):
    """Rows of (id, text), ids unique."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return sorted(((i, *v) for i, v in out.items()), key=repr)


def test_line_dedup_against_a_plain_pass(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " ", "long line of text", f"own {i}"]) for _ in range(rng.randint(1, 14)))) for i in range(120)]
    out = linededup.dedup_lines(documents(spark, rows), n_lines="lines", n_removed="gone")
    assert collected(out, "doc_id", "text", "lines", "gone") == brute_dedup(rows)


def test_line_dedup_keeps_columns_and_handles_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = collected(out, "doc_id", "text")
    assert (8, "a\nb\nc\nd") in rows
    assert [r for r in rows if r[0] != 8] == [r for r in collected(docs, "doc_id", "text") if r[0] != 8]
    same_id = documents(spark, [(1, "p\nq\nr"), (1, "p\nq\nr\ns"), (None, "p\nq\nr"), (2, "p\nq\nr\nz")])
    texts = [r.text for r in linededup.dedup_lines(same_id).collect()]
    assert sorted(texts) == sorted(["", "s", "p\nq\nr", "z"])
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_every_removed_line_remains_somewhere(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcdef") for _ in range(9))) for i in range(60)]
    left = {x for r in linededup.dedup_lines(documents(spark, rows)).collect() for x in r.text.split("\n")}
    assert {x for _, t in rows for x in t.split("\n")} <= left


def test_line_dedup_sql(spark, sf_dir):
    from cellweave.llm import queries

    assert differences(queries.op4_line_window_dedup(spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op4_line_window_dedup"]) == ""
