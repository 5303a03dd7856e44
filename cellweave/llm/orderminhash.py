"""Document fingerprints by Order MinHash (Marcais et al., Bioinformatics 2019).

A text is a sequence of tokens (at most eight non-blank characters each); its k-mers are five consecutive
tokens, numbered by occurrence over the whole text. For each of 16 orders of all the numbered k-mers, the
two smallest are taken, put back into text order and hashed together: an entry survives only if both the
k-mers and their order do, which is what makes the likeness follow edit distance. Texts without a repeated
k-mer need no sort; the others one, by k-mer, for the numbers.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.exprs import last_not_above, let, number_array

K, ENTRIES = 5, 16
#: Documents in one range of ids, and the most ranges there may be.
RANGE_DOCUMENTS, MAX_RANGES = 2000, 100_000
_POSITION_BITS = 24


def _constants() -> list[int]:
    rng = random.Random(64)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(ENTRIES)]


def signature(text: Column) -> Column:
    """array<bigint> of 16 entries (32 bits each); all zero for a text without tokens."""
    place = (1 << _POSITION_BITS) - 1

    def packed(tokens: Column) -> Column:
        n = F.size(tokens)
        each = F.transform(
            F.sequence(F.lit(0), n - K),
            lambda i: F.shiftleft(F.xxhash64(*[F.get(tokens, i + j) for j in range(K)]), _POSITION_BITS).bitwiseOR(i.cast("long")),
        )
        short = F.array(F.shiftleft(F.xxhash64(F.array_join(tokens, " ")), _POSITION_BITS))
        return F.when(n >= K, each).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))

    def kmer(x: Column) -> Column:
        return F.shiftright(x, _POSITION_BITS)

    def numbered(places: Column) -> Column:
        """struct<e, p>: the occurrence-numbered k-mers of the whole text, and their places (null: e is in text order)."""

        def runs(ordered: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (kmer(F.get(ordered, i)) != kmer(F.get(ordered, i - 1))))

            def items(at: Column) -> Column:
                each = F.transform(
                    at,
                    lambda begin, r: F.transform(
                        F.slice(ordered, begin + 1, F.coalesce(F.get(at, r + 1), F.size(ordered)) - begin),
                        lambda x, o: F.xxhash64(kmer(x), o),
                    ),
                )
                return F.struct(F.flatten(each).alias("e"), ordered.alias("p"))

            return let(starts, items)

        plain = F.struct(F.transform(places, lambda x: F.xxhash64(kmer(x), F.lit(0))).alias("e"), F.lit(None).cast("array<bigint>").alias("p"))
        return F.when(F.size(F.array_distinct(F.transform(places, kmer))) == F.size(places), plain).otherwise(let(F.sort_array(places), runs))

    def entry(items: Column, ranks: Column, constant: Column) -> Column:
        """The two smallest of one order: the first by a pass over all, the second by what is on either side of it."""

        def chosen(order: Column) -> Column:
            def pair(first: Column) -> Column:
                a = first.bitwiseAND(F.lit(place)).cast("int")
                before, after = F.slice(order, F.lit(1), a), F.slice(order, a + 2, F.size(order))
                b = F.least(F.array_min(before), F.array_min(after)).bitwiseAND(F.lit(place)).cast("int")
                return let(b, lambda b: hashed(a, F.coalesce(b, a)))

            def hashed(a: Column, b: Column) -> Column:
                at = lambda j: F.coalesce(F.get(items["p"], j).bitwiseAND(F.lit(place)), j.cast("long"))
                e = lambda j: F.get(items["e"], j)
                both = F.when(at(a) <= at(b), F.xxhash64(e(a), e(b))).otherwise(F.xxhash64(e(b), e(a)))
                return both.bitwiseAND(F.lit((1 << 32) - 1))

            return let(F.array_min(order), pair)

        return let(F.transform(ranks, lambda r: r.bitwiseXOR(constant)), chosen)

    def entries(items: Column) -> Column:
        constants = number_array([c & ~place for c in _constants()], "bigint")
        ranks = F.transform(items["e"], lambda e, i: e.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long")))
        orders = let(ranks, lambda r: F.transform(constants, lambda c: entry(items, r, c)))
        return F.when(F.size(items["e"]) > 0, orders).otherwise(F.array_repeat(F.lit(0).cast("long"), ENTRIES))

    tokens = F.regexp_extract_all(text, F.lit(r"\S{1,8}"), F.lit(0))
    return let(let(let(tokens, packed), numbered), entries)


def fingerprint_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries, 0 to 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x) / F.lit(float(ENTRIES))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is an empty one. Texts without tokens have the zero fingerprint and are alike. Documents
    are ordered by id, null ids first, equal ids by text; repeated rows follow one another. A single
    document follows itself. An empty table gives an empty result. Other columns are not read.

    The next document is found without a global sort: ids are cut into ranges at ids that occur, and the
    first document of each range is also sent to the end of the range before, and the very first
    to the end of the last. So every whole text is shuffled once.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    count, first = base.agg(F.count(F.lit(1)), F.min(key)).first()
    parts = int(min(MAX_RANGES, max(1, count // RANGE_DOCUMENTS)))
    cuts = [] if not count else [first]
    if parts > 1:
        shares = number_array([i / parts for i in range(1, parts)], "double")  # percentile_approx takes constants only
        cuts = sorted({first, *base.agg(F.percentile_approx(key, shares, 10 * parts)).first()[0]})
    bounds = number_array(cuts, "bigint")
    home = last_not_above([key], [bounds], len(cuts)) - 1
    last = max(len(cuts) - 1, 0)

    def places(r: Column) -> Column:
        here = F.struct(r.alias("range"), F.lit(0).alias("after"))
        there = F.struct(F.when(r == 0, F.lit(last)).otherwise(r - 1).alias("range"), F.lit(1).alias("after"))
        return F.when(F.get(bounds, r) == key, F.array(here, there)).otherwise(F.array(here))

    sent = base.withColumn("sig", signature(F.col("text"))).select("doc_id", "text", "sig", F.inline(let(home, places)))
    along = Window.partitionBy("range").orderBy("after", F.col("doc_id").asc_nulls_first(), "text")
    paired = sent.select("*", F.lead("text").over(along).alias("next_text"), F.lead("sig").over(along).alias("next_sig")).filter("after = 0")
    n, quarter = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = paired.select("doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)).alias("edited"))
    signed = edited.select("doc_id", "n_chars", "sig", "next_sig", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signature(F.col("edited")).alias("edited_sig"))
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("sig")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
