import hashlib
import random
import re

from cellweave.llm import orderminhash, secrets
from tests.llm.helpers import AWKWARD, documents

TABLE, THRESHOLD = secrets.train(secrets.labelled_samples())
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    """(base, added), each sorted lists of (start, kind, end)."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    left = list(text)
    for s, _, e in base:
        left[s:e] = " " * (e - s)
    added = [(m.start(), 3, m.end()) for m in re.finditer(secrets.TOKEN, "".join(left)) if secrets.looks_random(m[0], TABLE, THRESHOLD)]
    return sorted(base), added


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def corpus():
    rng = random.Random(6)
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rand = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    parts = [
        lambda: "pass" + "word='" + rand(full, rng.randint(3, 9)) + "'",
        lambda: "API_KEY: " + rand(full + "./", rng.randint(4, 20)),
        lambda: "secret=token:" + rand("abc", 8),
        lambda: "AKIA" + rand("ABC123", rng.randint(10, 22)),
        lambda: rand("0123456789abcdef", rng.randint(20, 40)),
        lambda: rand(full, rng.randint(18, 60)),
        lambda: rng.choice(["é🙂", "plain words here", "request_handler_configuration", "\n", "donaudampfschifffahrtsgesellschaft", "src/module/component/loader"]),
    ]
    return [(i, " ".join(rng.choice(parts)() for _ in range(rng.randint(0, 12)))) for i in range(300)]


def test_scan_against_plain_python(spark):
    rows = corpus() + AWKWARD
    got = sorted((r.asDict() for r in secrets.scan_documents(documents(spark, rows)).collect()), key=lambda r: repr((r["doc_id"], r["spans"])))
    want = sorted(((i, *plain_spans(t)) for i, t in rows), key=lambda r: repr((r[0], listed(sorted(r[1] + r[2])))))
    assert len(got) == len(want)
    for g, (i, base, added) in zip(got, want, strict=True):
        assert g["doc_id"] == i
        assert [g["n_assign"], g["n_access"], g["n_hex"], g["n_markov"]] == [sum(k == x for _, k, _ in base) for x in range(3)] + [len(added)]
        assert g["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert g["spans"] == listed(sorted(base + added))


def test_short_runs_and_what_base_spans_leave_of_a_run(spark):
    key, hexes, other = "x7Qp2Lm9Vt4Zk8Rw", "0123456789abcdef" * 2, "Hq3Zk8RwB5nX1Ty6"
    texts = {
        f"a {key} b": [(2, 3, 18)],
        f"{key[:-1]} 4929157203846150 internationalise": [],  # too short, a number, a word
        f"{key}Z{hexes}Z{other}": [(0, 3, 17), (17, 2, 49), (49, 3, 66)],  # on both sides of a hexadecimal number
        f"é🙂{other}_token={key}": [(2, 3, 19), (19, 0, 41)],
        f"token={key}/{other}": [(0, 0, 39)],
    }
    texts = {t: s for t, s in texts.items()}
    got = {r.doc_id: r.spans for r in secrets.scan_documents(documents(spark, list(enumerate(texts)))).collect()}
    for i, (text, spans) in enumerate(texts.items()):
        assert got[i] == listed(spans) == listed(sorted(sum(plain_spans(text), []))), text


def test_short_random_runs_are_told_from_short_identifiers():
    rng = random.Random(41)
    caught = [secrets.looks_random("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)), TABLE, THRESHOLD) for n in (16, 17, 18, 19) for _ in range(500)]
    cut = [s[: rng.randint(16, 19)] for s, y in secrets.labelled_samples(3000, seed=78) if not y]
    assert sum(caught) / len(caught) > 0.97 and sum(secrets.looks_random(s, TABLE, THRESHOLD) for s in cut) / len(cut) < 0.005


def many_matches(n, seed=8):
    """A text of n strings, most of them matches of some kind, with characters of several bytes between them."""
    rng = random.Random(seed)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(28))
    mixed = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))
    make = [hexes, hexes, mixed, lambda: "token=" + mixed(), lambda: "AKIA" + "Q7" * 9, lambda: "é🙂", lambda: "plain " * 40]
    return " ".join(rng.choice(make)() for _ in range(n))


def test_texts_of_many_matches(spark):
    """Several blocks of running sums and of text; the same spans and masks as plain Python's."""
    rows = [(1, many_matches(1200)), (2, many_matches(129, 9)), (3, many_matches(1))]
    assert len(rows[0][1]) > 8 * secrets.BLOCK
    docs = documents(spark, rows)
    got = {r.doc_id: r.spans for r in secrets.scan_documents(docs).collect()}
    spans = {i: sorted(sum(plain_spans(t), [])) for i, t in rows}
    assert got == {i: listed(s) for i, s in spans.items()} and len(spans[1]) > 600
    for r in secrets.mask_secrets(docs).collect():
        done, at, text = "", 0, dict(rows)[r.doc_id]
        for s, _, e in spans[r.doc_id]:
            if s >= at:
                done, at = done + text[at:s] + secrets.MASK, e
            else:
                at = max(at, e)
        assert r.text == done + text[at:]


def test_cost_follows_the_number_of_matches_not_their_square(spark):
    """16,000 matches cost about the same in one text as over 80 texts."""
    import time

    hexes = lambda n, s: " ".join(f"{random.Random(s + i).getrandbits(128):032x}" for i in range(n))
    one = documents(spark, [(1, hexes(16_000, 0))])
    spread = documents(spark, [(i, hexes(200, 200 * i)) for i in range(80)]).coalesce(1)
    for run, column in ((secrets.scan_documents, "spans"), (secrets.mask_secrets, "text")):
        took = []
        for docs in (spread, one, spread, one):
            began = time.perf_counter()
            n = sum(r[0] for r in run(docs).selectExpr(f"length({column})").collect())
            took.append(time.perf_counter() - began)
            assert n > 100_000
        assert took[3] < 2 * took[2] + 1


def test_models_tell_unseen_random_strings_from_identifiers():
    unseen = secrets.labelled_samples(1500, seed=77)
    usable = [(s, y) for s, y in unseen if re.fullmatch(secrets.TOKEN, s)]
    caught = [secrets.looks_random(s, TABLE, THRESHOLD) for s, y in usable if y]
    wrong = [secrets.looks_random(s, TABLE, THRESHOLD) for s, y in usable if not y]
    assert sum(caught) / len(caught) > 0.99 and sum(wrong) / len(wrong) < 0.005


def test_masking_replaces_spans_and_keeps_columns(spark):
    rows = corpus() + AWKWARD
    docs = documents(spark, rows)
    out = secrets.mask_secrets(docs)
    assert out.columns == docs.columns

    def masked(text):
        if text is None:
            return None
        done, at = "", 0
        for s, _, e in sorted(sum(plain_spans(text), [])):
            if s >= at:
                done, at = done + text[at:s] + secrets.MASK, e
            else:
                at = max(at, e)
        return done + text[at:]

    assert sorted(map(repr, (r.text for r in out.collect()))) == sorted(repr(masked(t)) for _, t in rows)
    assert secrets.scan_documents(documents(spark, [])).count() == 0


def edited_texts(rows):
    texts = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    for t, following in zip(texts, texts[1:] + texts[:1], strict=True):
        q = len(t) // 4
        yield t, t[: len(t) - q] + following[:q], following


def test_edited_texts_and_likeness(spark):
    rng = random.Random(11)
    words = [f"tok{i}" for i in range(900)]
    rows = [(3 * i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(150)]
    rows += [*AWKWARD, (9000, rows[5][1]), (9001, rows[5][1])]
    got = sorted(orderminhash.fingerprint_documents(documents(spark, rows)).collect(), key=lambda r: repr((r.doc_id, r.edited_sha256)))
    ids = [i for i, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    want = sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, (t, e, _) in zip(ids, edited_texts(rows), strict=True)), key=lambda r: repr((r[0], r[2])))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == want
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[15] == prints[9000] == prints[9001] and prints[2] == prints[3] == "0" * 128
    for r in got:
        same = sum(r.fingerprint[8 * k : 8 * k + 8] == r.edited_fingerprint[8 * k : 8 * k + 8] for k in range(16)) / 16
        assert r.near_edited == same and 0 <= r.near_next <= 1
    long_ones = [r for r in got if r.n_chars > 400 and r.doc_id and r.doc_id < 440 and r.doc_id not in (5, 6)]
    assert sum(r.near_edited for r in long_ones) / len(long_ones) > 0.25
    assert next(r for r in got if r.doc_id == 9000).near_next == 1


def test_many_ranges_give_what_one_does(spark, monkeypatch):
    rows = [(i, f"alpha {i} beta {i * i} gamma delta epsilon {i % 7}") for i in range(97)] + [(50, "twice"), (None, "first")]
    one = sorted(map(repr, orderminhash.fingerprint_documents(documents(spark, rows)).collect()))
    monkeypatch.setattr(orderminhash, "RANGE_DOCUMENTS", 9)
    assert sorted(map(repr, orderminhash.fingerprint_documents(documents(spark, rows)).collect())) == one
    assert orderminhash.fingerprint_documents(documents(spark, [])).count() == 0
    only = orderminhash.fingerprint_documents(documents(spark, [(1, "abcdefgh")])).first()
    assert only.near_next == 1 and only.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_hundreds_of_ranges_give_what_one_does(spark, monkeypatch):
    """200 ranges and more, as 400,000 documents have: the shares to cut at must be a constant."""
    rows = [(7 * i - 900, f"alpha {i} beta {i * i} gamma delta epsilon {i % 7}") for i in range(460)] + [(None, "first")]
    one = sorted(map(repr, orderminhash.fingerprint_documents(documents(spark, rows)).collect()))
    monkeypatch.setattr(orderminhash, "RANGE_DOCUMENTS", 2)
    assert sorted(map(repr, orderminhash.fingerprint_documents(documents(spark, rows)).collect())) == one


def test_order_counts(spark):
    words = [f"w{i}" for i in range(60)]
    halves = words[30:] + words[:30]
    a, b = sorted(orderminhash.fingerprint_documents(documents(spark, [(1, " ".join(words)), (2, " ".join(halves))])).collect(), key=lambda r: r.doc_id)
    assert a.near_next < 1  # nearly the same k-mers, in another order


def test_a_repeated_phrase_does_not_stand_for_the_whole_text(spark):
    """A k-mer of small hash 64 times or more, before different remainders: every k-mer of both takes part."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    words = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("w"))
    phrase = [words.orderBy(F.shiftleft(F.xxhash64(*["w"] * 5), 24)).first().w] * 75
    rows = [(i, " ".join(phrase + [f"t{rng.randrange(10**6)}" for _ in range(400)])) for i in range(8)]
    got = orderminhash.fingerprint_documents(documents(spark, rows)).collect()
    assert len({r.fingerprint for r in got}) == len(rows)
    assert all(r.near_next < 0.5 and r.near_edited < 1 for r in got)


def test_signature_against_plain_python(spark):
    """Both minima of every order over all occurrence-numbered k-mers, with and without repeats."""
    from pyspark.sql import functions as F

    rng = random.Random(13)
    texts = [" ".join(rng.choice("abcd" if i % 2 else [f"w{j}" for j in range(5000)]) for _ in range(rng.choice([1, 4, 5, 6, 90, 700]))) for i in range(40)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.sig for r in frame.select("i", orderminhash.signature(F.col("text")).alias("sig")).collect()}
    kmers = [(i, p, re.findall(r"\S{1,8}", t)[p : p + 5]) for i, t in enumerate(texts) for p in range(max(1, len(re.findall(r"\S{1,8}", t)) - 4))]
    full = spark.createDataFrame([(i, p, w if len(w) == 5 else [" ".join(w)]) for i, p, w in kmers], "i int, p int, w array<string>")
    hashed = full.select("i", "p", F.when(F.size("w") == 5, F.xxhash64(*[F.get("w", F.lit(j)) for j in range(5)])).otherwise(F.xxhash64(F.get("w", F.lit(0)))).alias("h")).collect()
    seen, rows = {}, []
    for r in sorted(hashed, key=lambda r: (r.i, r.p)):
        k = (((r.h << 24) + (1 << 63)) % (1 << 64) - (1 << 63)) >> 24
        rows.append((r.i, r.p, k, seen.setdefault((r.i, k), 0)))
        seen[r.i, k] += 1
    numbered = spark.createDataFrame(rows, "i int, p int, k long, o int").select("i", "p", F.xxhash64("k", "o").alias("e")).collect()
    want = []
    for i in range(len(texts)):
        es = [r.e for r in sorted((r for r in numbered if r.i == i), key=lambda r: r.p)]
        for n, c in enumerate(orderminhash._constants()):
            two = sorted(sorted(range(len(es)), key=lambda j: ((es[j] ^ c) >> 24, j))[:2])
            want.append((i, n, es[two[0]], es[two[-1]]))
    for r in spark.createDataFrame(want, "i int, n int, a long, b long").select("i", "n", F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 32) - 1)).alias("x")).collect():
        assert got[r.i][r.n] == r.x
