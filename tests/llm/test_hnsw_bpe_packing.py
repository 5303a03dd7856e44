import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from cellweave.llm import bpe, hnsw, packing
from tests.llm.helpers import AWKWARD, documents


def brute_nearest(vectors, queries, k):
    out = {}
    for q, v in queries.items():
        scored = sorted((-float(np.dot(np.array(x, float), np.array(v, float))), i) for i, x in vectors.items() if i != q and len(x) == len(v))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_scores_and_ranks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = {i: (centres[i % 12] * (i % 2) + rng.normal(size=16) * 0.7).astype(np.float32).tolist() for i in range(2500)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(hnsw.nearest_neighbours(frame, frame.filter("vec_id % 20 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(vectors, {i: v for i, v in vectors.items() if i % 20 == 0}, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) > 0.95
    for q, hits in got.items():
        assert [(-s, i) for i, s in hits] == sorted((-s, i) for i, s in hits)
        for i, s in hits:
            assert s == pytest.approx(np.dot(np.array(vectors[q], float), np.array(vectors[i], float)), abs=1e-12)


def test_ties_copies_and_unusable_vectors(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(40)] + [(40, [3.0, 0.0]), (40, [3.0, 0.0]), (41, None), (42, [0.0, 0.0]), (43, [1.0, None]), (44, [float("nan"), 1.0]), (45, [float("inf"), 1.0]), (None, [1.0, 1.0]), (46, [1.0, 1.0, 1.0]), (47, [-0.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    hits = defaultdict(list)
    for r in sorted(hnsw.nearest_neighbours(frame, frame, k=5).collect(), key=lambda r: (r.query_id, r.rank)):
        hits[r.query_id].append(r.vec_id)
    usable = {i: v for i, v in rows if i is not None and i not in range(41, 46)}
    assert dict(hits) == {q: [i for i, _ in h] for q, h in brute_nearest(usable, usable, 5).items() if h}
    assert hnsw.nearest_neighbours(frame.limit(0), frame.limit(0)).count() == 0


def test_vectors_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    clashing = frame.select("*", *[F.lit("x").alias(c) for c in ("ids", "dim", "shard", "kind", "query_id", "score", "rank")])
    ask = lambda v: sorted(map(tuple, hnsw.nearest_neighbours(v, v.filter("vec_id % 20 = 0"), k=5).collect()))
    got = ask(clashing)
    assert got == ask(frame) and len(got) == 30


@pytest.fixture(scope="module")
def encoding():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        file = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in file.split(b"\n") if x)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.ByteBpe(file, P.PATTERN), ranks


def odd_texts():
    rng = random.Random(1)
    letters = "ab c'st\n\t \x1c\x85  é漢字🙂١²ⅷ́'ll 12!?\x0b\r\x00​﻿"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * 3000, " " * 500 + "x", "<|endoftext|>"]


def test_encoder_equals_the_library_and_decodes_back(encoding):
    library, own, _ = encoding
    for t in odd_texts():
        packed = own.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(packed) == t.encode()


def test_perfect_hash_is_minimal_and_exact(encoding):
    _, own, ranks = encoding
    slots = {own.whole.slot(k) for k in ranks}
    assert slots == set(range(len(ranks)))
    assert own.whole.slot(b"certainly not a token here") == -1
    for n in (0, 1, 2, 7, 100):
        keys = [b"k%d" % i for i in range(n)]
        assert sorted(bpe.PerfectHash(keys).slot(k) for k in keys) == list(range(n))


def test_encoded_documents(spark, encoding):
    library, _, _ = encoding
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(odd_texts()[:80])]
    out = bpe.encode_documents(documents(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert bpe.encode_documents(documents(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 5, 4, 3, 1]), 10)
    assert fills.tolist() == [10, 10, 4] and sorted(zip(bins.tolist(), offsets.tolist(), strict=True)) == [(0, 0), (0, 6), (1, 0), (1, 5), (2, 0), (2, 3)]
    assert packing.best_fit(np.array([], int))[2].size == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def check_packing(rows, out, tokenizer, capacity):
    docs = defaultdict(list)
    for i, t in rows:
        docs[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    held, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = sorted((i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for i, all_ids in docs.items() if i is not None for ids in all_ids for p, s in enumerate(range(0, len(ids), capacity)) for part in [ids[s : s + capacity]])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id is not None) == want
    return len(held), sum(r.length for r in out)


@pytest.mark.parametrize("partitions", [1, 13])
def test_packing_is_valid_whole_and_tight(spark, tokenizer, partitions):
    rng = random.Random(2)
    rows = AWKWARD + [(100 + i, " ".join(rng.choice(["word", "Other,", "thing.", "é!", "x1", "<|endoftext|>", "a<|startoftext|>."]) for _ in range(rng.randint(0, 90)))) for i in range(500)]
    docs = documents(spark, rows).repartition(partitions)
    sequences, tokens = check_packing(rows, packing.pack_documents(docs, P.path("word_bpe_49k.json"), capacity=128, slack=1).collect(), tokenizer, 128)
    assert sequences <= 1.03 * -(-tokens // 128) + 1
    assert packing.pack_documents(documents(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_packing_where_nothing_fits_together(spark, tokenizer):
    rows = [(i, "word " * 69) for i in range(60)]
    out = packing.pack_documents(documents(spark, rows).repartition(5), P.path("word_bpe_49k.json"), capacity=128).collect()
    assert check_packing(rows, out, tokenizer, 128)[0] == 60


def test_merging_goes_on_while_bins_are_saved(spark, tokenizer):
    """Groups of a bounded size are dealt anew until none saves a bin: half-full bins pair up across all groups."""
    rows = [(i, "word " * 31) for i in range(90)]
    docs = documents(spark, rows).repartition(45)
    out = packing.pack_documents(docs, P.path("word_bpe_49k.json"), capacity=128, group_items=6, slack=1).collect()
    assert check_packing(rows, out, tokenizer, 128)[0] <= 25  # 23 is the least


def test_chunked_tokens_equal_the_library(tokenizer, monkeypatch):
    rng = random.Random(4)
    letters = "abAB c'st.,!?\n\t \x1c\x85  éÉ漢🙂١²́Σσ'll 12;:\x0b\r ​İ"
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        own = packing.Tokens(f.read())
    added = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "a", ".", " ", "Ab,"]
    special = ["".join(rng.choice(added) for _ in range(rng.randint(1, 8))) for _ in range(500)]
    assert tokenizer.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [3306, 49407, 1002]
    for t in ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + special + ["<|endoftext|> x<|startoftext|>.", "I'LL 's. it's! a.. " + "y" * 200, "", "ünïcödé Straße ŉ ªº ÷ ×é déjà. Ǆ ǆ œuvre, mañana! été?"]:
        assert np.frombuffer(own.encode(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
