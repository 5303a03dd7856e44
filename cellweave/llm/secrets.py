"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Two first-order character chains are trained from labelled samples, one from random strings and one from
identifiers and words. A token's log-likelihood ratio for each transition says which of them it
is likelier from; tokens above a threshold that no training identifier reaches are added as spans. Tokens are taken from
what the fixed patterns leave of the text.
All text work is DataFrame expressions; only the 80 x 80 table is made in Python, from the samples.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.exprs import let, number_array, running, unused

#: Fixed patterns of the base rules; the failing matches of ``assign`` use up text, the others' can't.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models judge: runs of characters that keys are written in. Runs shorter than ``LONG`` must hold letters and
#: digits, as a short number or word alone is too little to tell from a key.
TOKEN, LONG = r"[A-Za-z0-9+/_=-]{16,}", 20
KINDS = ("assign", "access", "hex", "markov")
MASK = "[SECRET]"
#: Code points of a block of text that masking cuts from.
BLOCK = 4096
_LOW, _SIDE = ord("+"), ord("z") - ord("+") + 1

_WORDS = (
    "about account action active address admin after agent array async back base batch block body buffer build cache call case "
    "change channel check child class client close code column comment common config connect content context control copy count "
    "create data date default delete depth device direct document domain driver editor element empty enable encode entry error event "
    "example export factory field file filter final first folder format frame function global group handle header height history "
    "image import index input instance interface internal invalid item key label language layer length library license limit line "
    "list load local lock login manager map master match memory merge message method model module monitor name network node "
    "number object offset option order output owner package page parent parse path pattern payload point policy pool position "
    "prefix process profile project property protocol provider public query queue random range reader record region register "
    "release remote report request resource response result return route rule sample schema scope search section select "
    "sender server service session setting shared signal simple size source stack start state status storage stream string style "
    "switch system table target task template test text thread time title total trace transaction type unit update upload user "
    "value vector version view virtual visible volume warning window worker writer"
).split()
_SYLLABLES = (
    "the er on an re he in ed nd ha at en es or ti te is ing it ar al st to nt tion ou and der die und sch ein ich ung che ge be "
    "ver ber keit lich heit zu auf que les des ment est aux eau eux pas dans ier pour con por los las cion ado mente ra do ja bo "
    "ga aci dad lle ez rr ie ue ter ach tz pf ss sp kr wei schaft isch tum igs wh sh ly ble of thr str ck ough est"
).split()


def labelled_samples(n: int = 6000, seed: int = 20) -> list[tuple[str, int]]:
    """(string, 1 if random else 0): a bounded training set, the same in every run."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789")
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for i in range(n):
        size = rng.randint(20, 64)
        letters = (*alphabets, full, full, full + "+/", full + "-_")[i % 8]
        out.append(("".join(rng.choice(letters) for _ in range(size)), 1))
        words = [rng.choice(_WORDS) for _ in range(rng.randint(3, 7))]
        shape = i % 6
        if shape == 0:
            text = "_".join(words)
        elif shape == 1:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif shape == 2:
            text = rng.choice(("-", "/")).join(words) + rng.choice(("", "-2", "/v1", "-2024-05-17", "/index", "=1"))
        elif shape == 3:
            text = "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(7, 14)))
            text = rng.choice((text, text.title(), text.upper()))
        elif shape == 4:
            text = "_".join(words).upper()
        else:
            text = rng.choice(("=" * 24, "-" * 30, "_" * 22, "2024-05-17-12-30-00-00", "a" * 21, "the" * 8, "0000000000000000000000", "1234567890" * 3)) if i % 4 == 0 else "/".join(w + str(rng.randint(0, 99)) for w in words)
        out.append((text, 0))
    return out


def train(samples: list[tuple[str, int]]) -> tuple[list[float], float]:
    """(flattened table of log ratios by transition, threshold of the mean ratio)."""
    counts = [[0.0] * (_SIDE * _SIDE) for _ in range(2)]
    usable = [(s, y) for s, y in samples if len(s) >= LONG and re.fullmatch(TOKEN, s)]
    for s, y in usable:
        for a, b in zip(s, s[1:], strict=False):
            counts[y][(ord(a) - _LOW) * _SIDE + ord(b) - _LOW] += 1
    table = [0.0] * (_SIDE * _SIDE)
    totals = [[sum(c[a * _SIDE : (a + 1) * _SIDE]) for a in range(_SIDE)] for c in counts]
    for a in range(_SIDE):
        for b in range(_SIDE):
            k = a * _SIDE + b
            p = [(counts[y][k] + 0.5) / (totals[y][a] + 0.5 * _SIDE) for y in (0, 1)]
            table[k] = round(math.log(p[1] / p[0]), 4)
    highest = max(mean_ratio(s, table) for s, y in usable if y == 0)
    return table, round(max(highest, 0.0) + 0.05, 4)


def mean_ratio(token: str, table: list[float]) -> float:
    """A token's mean log-likelihood ratio; the plain-Python form of what the expression computes."""
    codes = [ord(c) - _LOW for c in token]
    return sum(table[a * _SIDE + b] for a, b in zip(codes, codes[1:], strict=False)) / max(len(codes) - 1, 1)


def looks_random(token: str, table: list[float], threshold: float) -> bool:
    """Whether a run of the judged characters counts as a secret; the plain-Python form too."""
    mixed = re.search("[A-Za-z]", token) and re.search("[0-9]", token)
    return bool(len(token) >= LONG or mixed) and mean_ratio(token, table) > threshold


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, word>> of every match, in code points; ``word`` is the given group.

    The text between matches and the matches alternate, so running lengths give the places.
    """
    parts = [F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole")]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("word"))
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")

    def placed(p: Column) -> Column:
        steps = F.transform(p["whole"], lambda w, i: F.char_length(w) + F.char_length(F.get(p["between"], i)))

        def item(end: Column, i: Column) -> Column:
            return F.struct((end - F.char_length(F.get(p["whole"], i))).alias("start"), end.alias("end"), F.get(p["word" if group else "whole"], i).alias("word"))

        return F.transform(let(steps, lambda s: running(s, F.lit(0), lambda a, b: a + b)), item)

    return F.when(text.rlike(pattern), let(F.struct(*parts), placed)).otherwise(none)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``by(span, at)`` in place of each of the ``spans`` (sorted by start, may overlap), where ``at`` is the end
    of what the spans before it cover. Between spans the text is taken from blocks, as a place in a long text is found by
    counting from its beginning."""

    def joined(p: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            first, last = F.floor(begin / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
            of = lambda b: F.coalesce(F.get(p["blocks"], b), F.lit(""))
            head, tail = F.substring(of(first), begin - first * BLOCK + 1, F.lit(BLOCK)), F.substring(of(last), F.lit(1), end - last * BLOCK)
            middle = F.array_join(F.slice(p["blocks"], first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            return F.when(first == last, F.substring(of(first), begin - first * BLOCK + 1, end - begin)).otherwise(F.concat(head, middle, tail))

        def step(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(p["reached"], i - 1)).otherwise(F.lit(0))
            return F.concat(F.when(s["start"] > at, piece(at, s["start"])).otherwise(F.lit("")), by(s, at))

        return F.concat(F.array_join(F.transform(p["spans"], step), ""), piece(F.element_at(p["reached"], -1), F.char_length(text)))

    def parts(spans: Column) -> Column:
        reached = let(F.transform(spans, lambda s: s["end"]), lambda e: running(e, F.lit(0), lambda a, b: F.greatest(a, b)))
        return let(F.struct(spans.alias("spans"), reached.alias("reached"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks")), joined)

    return F.when(F.size(spans) > 0, parts(spans)).otherwise(text)


def scan_columns(text: Column, table: list[float], threshold: float) -> Column:
    """struct<base, added>: arrays of struct<start, kind, end>, each sorted by start, then kind."""
    assign = F.filter(_matches(text, ASSIGN, 2), lambda m: F.char_length(m["word"]) >= 6)
    fixed = F.array_sort(F.concat(*[_spans(m, k) for k, m in enumerate((assign, _matches(text, ACCESS), _matches(text, HEX)))]))
    ratios = number_array(table, "double")

    def random_like(m: Column) -> Column:
        codes = F.transform(F.split(m["word"], ""), lambda c: F.ascii(c) - _LOW)

        def mean(c: Column) -> Column:
            total = F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.get(ratios, F.get(c, i - 1) * _SIDE + F.get(c, i)))
            return total / (F.size(c) - 1)

        mixed = m["word"].rlike("[A-Za-z]") & m["word"].rlike("[0-9]")
        return ((F.char_length(m["word"]) >= LONG) | mixed) & (let(F.filter(codes, lambda c: c >= 0), mean) > threshold)

    def judged(base: Column) -> Column:
        blank = lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))
        tokens = let(_replaced(text, base, blank), lambda left: F.filter(_matches(left, TOKEN), random_like))
        return F.struct(base.alias("base"), _spans(tokens, 3).alias("added"))

    return let(fixed, judged)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for every row of ``docs``.

    A null text is an empty one and has no spans; repeated rows and null ids give a row each; an empty
    table gives an empty result. Spans count code points and end before ``end``. Other columns are not read.
    """
    table, threshold = train(labelled_samples())
    found = docs.select(F.col(id_col).alias("doc_id"), scan_columns(F.coalesce(F.col(text_col), F.lit("")), table, threshold).alias("f"))
    count = lambda kind: F.size(F.filter(F.col("f")["base"], lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("f")["base"]).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat(F.col("f")["base"], F.col("f")["added"]))).alias("spans"),
        F.size(F.col("f")["added"]).cast("long").alias("n_markov"),
    )


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mask``; overlapping spans by one mask.

    Null texts stay null; rows and other columns stay as they are.
    """
    table, threshold = train(labelled_samples())
    name = unused(docs, "__found")
    text = F.col(text_col)
    found = docs.withColumn(name, scan_columns(F.coalesce(text, F.lit("")), table, threshold))

    once = lambda s, at: F.when(s["start"] >= at, F.lit(mask)).otherwise(F.lit(""))
    every = F.array_sort(F.concat(F.col(name)["base"], F.col(name)["added"]))
    changed = let(every, lambda spans: _replaced(text, spans, once))
    return found.select(*[changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
