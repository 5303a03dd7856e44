import random

import pytest
import xxhash

from cellweave.llm import similar, simhash
from tests.llm.helpers import AWKWARD, collected, documents


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else (" " if c in " \t\n\x0b\x0c\r" else c) for c in text or "").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints):
    """{index: smallest id}, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            ids[find(i)] = min(doc_id, ids.get(find(i), doc_id))
    return [ids.get(find(i)) for i in range(len(prints))]


def test_fingerprint_follows_its_definition():
    rng = random.Random(2)
    for _ in range(300):
        text = " ".join(rng.choice(["A", "b", "Ce", "É", "x́", "\n", "\t \x0b", "漢字"]) for _ in range(rng.randint(0, 700 if rng.random() < 0.05 else 12)))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("bucket", [1, 24])
def test_links_connect_what_all_pairs_connect(spark, bucket):
    """Clusters of close fingerprints, with chains and dense balls; bucket 1 sends every pair through balls."""
    rng = random.Random(7)
    prints = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            prints.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    rows = [(i, f) for i, f in enumerate(sorted(prints))]
    frame = spark.createDataFrame([(simhash._signed(f),) for _, f in rows], "fp long")
    number = {simhash._signed(f): i for i, f in rows}
    links = [(number[r.u], number[r.v]) for r in simhash.fingerprint_links(frame, len(rows), bucket).collect()]
    assert all(bin(rows[a][1] ^ rows[b][1]).count("1") <= 2 for a, b in links)
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert root == brute_groups(rows)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return [*((100 + i, t) for i, t in enumerate(texts)), *AWKWARD]


def test_whole_query_against_all_pairs(spark, corpus):
    got = collected(simhash.near_duplicate_groups(documents(spark, corpus)), "doc_id", "fingerprint", "component_id")
    prints = [(i, plain_fingerprint(t)) for i, t in corpus]
    want = sorted(((i, f"{f:016x}", g) for (i, f), g in zip(prints, brute_groups(prints), strict=True)), key=repr)
    assert got == want


def test_one_document_of_each_group_stays(spark, corpus):
    docs = documents(spark, corpus)
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    named = [(i, t) for i, t in corpus if i is not None]
    root = root_of_pairs([t or "" for _, t in named])
    first = {}
    for (i, _), r in zip(named, root, strict=True):
        first[r] = min(i, first.get(r, i))
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [*first.values(), None]))


def test_similar_texts_join_texts_with_a_changed_word(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    other = [f"u{rng.randrange(10**6)}" for _ in range(400)]
    changed = [*base[:200], "different", *base[201:]]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(other)), (4, " ".join(base) + " ")]
    kept = {r.doc_id for r in simhash.keep_one_of_each_group(documents(spark, rows)).collect()}
    assert 1 in kept and 3 in kept and 4 not in kept


def plain_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def root_of_pairs(texts):
    """For each text the smallest index that links of similarity 0.8 reach, by comparing all pairs."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if plain_similarity(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("bucket, max_ranked", [(1, 10**6), (24, 10**6), (2, 40)])
def test_groups_are_those_of_all_similar_pairs(spark, monkeypatch, bucket, max_ranked):
    """Changed, added and cut words, repeats, a passage that half of the texts share: exactly the groups of all pairs."""
    monkeypatch.setattr(similar.similar_components, "__defaults__", (bucket, max_ranked))
    monkeypatch.setattr(similar, "BLOCK", 8)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 160, 260]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            copy = copy[: len(copy) - rng.choice([0, 0, len(copy) // 8, len(copy) // 4])]
            texts.append(" ".join(passage + copy if g % 2 else copy))
    rng.shuffle(texts)
    for a in range(0, len(texts), 9):
        assert all((similar.similarity(texts[a].encode(), t.encode()) >= 0.8) == (plain_similarity(texts[a], t) >= 0.8) for t in texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows), bucket=bucket).collect()}
    assert got == dict(enumerate(root_of_pairs(texts))) and len(set(got.values())) < len(texts)


def test_similar_groups_of_awkward_texts(spark):
    """Null, empty and blank texts are one group; repeated rows stay; null ids are left out."""
    got = collected(simhash.similar_groups(documents(spark, AWKWARD)), "doc_id", "component_id")
    want = [(i, 1 if i in (2, 3) else i) for i, _ in AWKWARD if i is not None]
    assert got == sorted(want, key=repr)


def test_listed_shingles_meet_for_every_similar_pair():
    """Sets of every size, shared shingles wherever: at 0.8 or more a listed one is common and allows both sizes."""
    import numpy as np

    rng = np.random.default_rng(4)
    ranks = (7, np.unique(similar._codes(rng.integers(0, 300, 40).astype(np.uint64), 7).astype(np.int64)), rng.integers(25, 99, 40))
    ranks = (7, ranks[1], ranks[2][: len(ranks[1])])
    met = 0
    for _ in range(3000):
        pool = rng.permutation(300)[: rng.integers(1, 120)]
        a = np.sort(pool[rng.random(len(pool)) < 0.93]).astype(np.uint64)
        b = np.sort(pool[rng.random(len(pool)) < 0.93]).astype(np.uint64)
        both = len(np.intersect1d(a, b))
        if not len(a) or not len(b) or 5 * both < 4 * (len(a) + len(b) - both):
            continue
        met += 1
        of = [{int(h): abs(int(m)) for h, m in zip(*similar.listed(x, *ranks), strict=True)} for x in (a, b)]
        assert any(len(b) <= of[0][h] and len(a) <= of[1][h] for h in of[0].keys() & of[1].keys())
    assert met > 500


def test_counts_of_shingles_against_plain_counts(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(similar, "GATHERED", 300)
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    frame = documents(spark, list(enumerate(texts))).select(F.col("text").cast("binary").alias("text"))
    got = {r.code: r.n for r in similar.shingle_counts(frame, 5, 3).collect()}
    counts = {}
    for t in texts:
        for c in similar._codes(similar.hashes(t.encode()), 5).astype(np.int64).tolist():
            counts[c] = counts.get(c, 0) + 1
    assert got == {c: n for c, n in counts.items() if n > 3} and got


def test_equal_word_sets_of_different_order_are_not_copies(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(rng.sample(base, 120))) for i in range(40)]
    assert simhash.keep_one_of_each_group(documents(spark, rows)).count() == 40


@pytest.mark.parametrize("bucket", [1, 24])
def test_a_representative_does_not_stand_for_its_class(spark, bucket):
    """A and B are two orders of the same words, C is B with two neighbours swapped: B and C link though A is first."""
    rng = random.Random(15)
    words = [f"v{i}" for i in range(120)]
    b = rng.sample(words, 120)
    c = [*b[:60], b[61], b[60], *b[62:]]
    rows = [(1, " ".join(words)), (2, " ".join(b)), (3, " ".join(c))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows), bucket=bucket).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("a_round", [similar.PAIRS_A_ROUND, 500])
def test_large_classes_are_compared_whole(spark, monkeypatch, a_round):
    """Many pairs of copies in classes whose members share half their text, and one of a third: none but true pairs link."""
    monkeypatch.setattr(similar, "PAIRS_A_ROUND", a_round)
    rng = random.Random(16)
    common = [f"c{i}" for i in range(300)]
    texts = []
    for i in range(12):
        own = [f"x{i}_{rng.randrange(10**6)}" for _ in range(120)]
        changed = [*own[:30], "new", *own[31:]]
        texts += [" ".join(common + own), " ".join(common + changed)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows), bucket=2).collect()}
    root = root_of_pairs(texts)
    assert got == dict(enumerate(root)) and len(set(root)) == 12


def test_empty_table(spark):
    assert simhash.near_duplicate_groups(documents(spark, [])).count() == 0
    assert simhash.keep_one_of_each_group(documents(spark, [])).count() == 0


def test_equal_fingerprints_link_only_what_is_similar(spark):
    """A phrase that makes up most of the shingles decides the fingerprint; different remainders stay apart with bands."""
    rng = random.Random(18)
    rows = [(i, " ".join(["over"] * 260 + [f"x{rng.randrange(10**6)}" for _ in range(200)])) for i in range(5)]
    docs = documents(spark, rows)
    assert len({plain_fingerprint(t) for _, t in rows}) == 1
    assert len({r.component_id for r in simhash.near_duplicate_groups(docs).collect()}) == 1
    assert simhash.keep_one_of_each_group(docs).count() == 5


def test_templated_texts_are_told_apart_by_their_lists(spark, monkeypatch):
    """Pages of 30 slots of three phrases: every list is large and nothing is similar, but for two planted pairs."""
    rng = random.Random(3)
    slots = [[" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(8)) for _ in range(3)] for _ in range(30)]
    rows = [(i, [rng.choice(s) for s in slots]) for i in range(400)]
    for i, of in ((400, 3), (401, 7)):
        rows.append((i, [*rows[of][1][:-1], f"another end {i}"]))
    checked = []
    compared = similar._checked
    monkeypatch.setattr(similar, "_checked", lambda pairs, n, texts: checked.append(n) or compared(pairs, n, texts))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    assert got == {i: {400: 3, 401: 7}.get(i, i) for i in range(402)}
    assert sum(checked) < 6_000 < 402 * 401 // 2 // 10


def test_different_texts_of_one_id_stay(spark):
    rows = [(1, "one text of its own here"), (1, "something else altogether now"), (1, "one text of its own here"), (2, "one text of its own here")]
    kept = simhash.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted(rows[:2])


def test_rows_of_several_numbers_are_broadcast_up_to_fewer_of_them(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(similar, "BROADCAST_IDS", 200)
    wide = spark.range(100).select(F.col("id").alias("key"), F.lit(2).alias("members"), F.struct("id", F.lit(3).alias("n"), F.lit(4).alias("most")).alias("first"))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(similar.small(spark.range(200), 200))
    assert "broadcast" in plan(similar.small_table(wide, 40))
    assert "broadcast" not in plan(similar.small_table(wide, 41))
    assert "broadcast" not in plan(similar.small(spark.range(201), 201))


def test_groups_are_the_same_where_nothing_is_broadcast(spark, monkeypatch):
    rows = [(i, f"a passage that many of these texts have in common number {i % 7} and some words {i % 30} more at its end") for i in range(120)]
    docs = spark.createDataFrame([*rows, (500, None), (501, " ")], "doc_id long, text string")
    groups = lambda: sorted(map(tuple, simhash.similar_groups(docs, bucket=4).collect()))
    broadcast = groups()
    monkeypatch.setattr(similar, "BROADCAST_IDS", 0)
    assert groups() == broadcast
