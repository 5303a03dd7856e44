"""Hierarchical best-fit packing of tokenised documents into sequences.

Each partition tokenises its documents, cuts the longer ones, and packs the pieces best-fit, longest
first. Bins that are nearly full are final; underfull bins become items of the next round, where fewer
and larger groups of them are packed best-fit again, until one group has held them all or groups of the
largest size, dealt anew, no longer save a bin. A group never has more than a fixed number of items.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.exprs import small_batches
from cellweave.plans.lineage import cut

CAPACITY = 2048
#: A bin with at most this many tokens free is final.
SLACK = 8
#: Items one task packs in a round, and how many groups merge into one at least.
GROUP_ITEMS, FAN_IN = 200_000, 8
#: Chunks of text in a generation of what a worker remembers; longer chunks are not remembered.
REMEMBERED, CHUNK_BYTES = 340_000, 48
#: Marks that form a token of their own between a letter and a blank.
MARKS = (b".", b",", b";", b":", b"!", b"?")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin of each item, offset in it, fill of each bin); sizes 1 to ``capacity``.

    The open bins are kept by free room, with one bit for each room that occurs, so the tightest
    bin that fits is the lowest set bit from the item's size on.
    """
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in own)}


_LETTERS = _byte_letters()


class Tokens:
    """Packed ids of whole texts. White space separates tokens in these vocabularies, so a text is
    encoded chunk by chunk between ASCII blanks, and chunks are remembered.

    Two generations are remembered: when the young one is full it becomes the old one, and what is still
    used moves over. A chunk of another case, or with one closing mark after a letter, is made from what is
    known of its lower-case letters: the vocabularies ignore case and keep marks apart. A chunk that may hold one
    of the vocabulary's added tokens goes to the library as it is.
    """

    def __init__(self, vocabulary: str, remembered: int | None = None):
        self.remembered = remembered or REMEMBERED
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("packed ids need 4-byte little-endian integers")
        # tokens that the library finds in the text as it stands, whatever they touch
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added_start = os.path.commonprefix(self.added) or b""
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks = dict(zip(MARKS, self._ids([m.decode() for m in MARKS]), strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of ASCII-lower-case chunks. One that normalising and splitting leave alone (only letters, in
        lower case and composed) goes to the merges at once, with its bytes as the letters that stand for them."""
        made, others, merge = {}, [], self.tokenizer.model.tokenize
        for w in words:
            if w.isalpha():
                made[w] = array("I", [t.id for t in merge(w.decode("ascii"))]).tobytes()
                continue
            s = w.decode("utf-8", "replace")
            if max(s) < "\u0250" and s.isalpha() and s == s.lower() and unicodedata.is_normalized("NFC", s):
                made[w] = array("I", [t.id for t in merge(w.decode("latin-1").translate(_LETTERS))]).tobytes()
            else:
                others.append(w)
        made.update(zip(others, self._ids([w.decode("utf-8", "replace") for w in others]), strict=True))
        return made

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that the young generation lacks; it gets all of them that are not long."""
        known, old, marks, start = self.known, self.old, self.marks, self.added_start
        here, plain = {}, {}
        for c in chunks:
            if c in old:
                here[c] = old[c]
                continue
            low = c.lower()
            if start in low and any(t in low for t in self.added):
                low = c  # of this case only, and with its mark
            elif low[-1:] in marks and low[-2:-1].isalpha():
                low = low[:-1]
            if low in plain:
                plain[low].append(c)
            else:
                plain[low] = [c]
        unknown = [w for w in plain if w not in known and w not in old]
        here.update(self._words(unknown))
        for w, forms in plain.items():
            ids = here[w] if w in here else known[w] if w in known else old[w]
            for c in forms:
                here[c] = ids if len(c) == len(w) else ids + marks[c[-1:]]
        if len(known) >= self.remembered:
            self.old, self.known = known, {}
        self.known.update(here)
        for c in here:
            if len(c) > CHUNK_BYTES:
                del self.known[c]
        return here

    def encode(self, text: bytes | None) -> bytes:
        chunks = text.split() if text else []
        known = self.known
        if missing := set(chunks).difference(known):
            here = self.learn(missing)
            return b"".join([known[c] if c in known else here[c] for c in chunks])
        return b"".join([known[c] for c in chunks])


_LOADED: dict[tuple[int, int | None], Tokens] = {}


def load(vocabulary: str, remembered: int | None = None) -> Tokens:
    key = hash(vocabulary), remembered
    if key not in _LOADED:
        _LOADED[key] = Tokens(vocabulary, remembered)
    return _LOADED[key]


_PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
_ROW = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())]


def local_bins(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, remembered: int | None = None) -> DataFrame:
    """Every piece with its bin in the first round; bin numbers hold the partition in their upper bits."""
    with open(vocabulary, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(file.value, remembered)
        base = TaskContext.get().partitionId() << 32
        ids, columns = [], [[] for _ in range(4)]
        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                packed = tokens.encode(text.as_py()) + b"\0\0\0\0"
                for p, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    ids.append(doc_id)
                    for c, x in zip(columns, (p, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(x)
        if not ids:
            return
        bins, offsets, fills = best_fit(np.array(columns[2], np.int64), capacity)
        numbers = [*columns, base + bins, offsets, fills[bins]]
        yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], ids[0].type), *[pa.array(x, t) for x, (_, t) in zip(numbers, _ROW, strict=True)]], ["doc_id", *[n for n, _ in _ROW]])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, _PIECES.format(rows.schema["doc_id"].dataType.simpleString()))


def _merge(open_bins: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """bin, fill -> bin, parent, shift, parent_fill: one round over ``groups`` groups of bounded size."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, sizes = table["bin"].to_numpy(), table["fill"].to_numpy()
        order = np.argsort(ids)
        ids, sizes = ids[order], sizes[order]
        bins, shifts, fills = best_fit(sizes, capacity)
        base = ((level << 24) | key[0].as_py()) << 32
        return pa.table([pa.array(ids), pa.array(base + bins), pa.array(shifts), pa.array(fills[bins])], ["bin", "parent", "shift", "parent_fill"])

    group = F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("group")
    return open_bins.groupBy(group).applyInArrow(run, "bin long, parent long, shift long, parent_fill long")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, slack: int = SLACK, remembered: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    A document is its tokens and then id 0; only one longer than ``capacity`` is cut. A null or blank
    text is the closing id alone. Repeated rows and null ids are packed like others; an empty table gives
    no rows. Other columns are not read. ``vocabulary`` is a path that the driver can open. ``remembered``: chunks in
    a generation of what workers remember (``REMEMBERED``), some 400 bytes each for both; fewer take longer.
    """
    with small_batches(docs.sparkSession):
        pieces = cut(local_bins(docs, vocabulary, id_col, text_col, capacity, remembered))
    placed = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", F.lit(0).alias("shift"))
    underfull = F.col("fill") < capacity - slack
    open_bins = pieces.filter(underfull).groupBy("bin").agg(F.max("fill").alias("fill"))
    moves, level = None, 1
    last, groups = open_bins.count(), max(1, pieces.rdd.getNumPartitions())
    while last > 1:
        fewest = -(-last // group_items)
        groups = max(min(groups // FAN_IN, last), fewest)
        step = cut(_merge(open_bins, groups, capacity, level))
        # moves: first-round bin -> the bin that holds it now, and how far its content moved
        if moves is None:
            moves = step.select("bin", F.col("parent").alias("sequence"), "shift")
        else:
            later = step.select(F.col("bin").alias("sequence"), "parent", F.col("shift").alias("more"))
            moves = cut(moves.join(later, "sequence", "left").select("bin", F.coalesce("parent", "sequence").alias("sequence"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")))
        open_bins = step.filter(F.col("parent_fill") < capacity - slack).groupBy(F.col("parent").alias("bin")).agg(F.max("parent_fill").alias("fill"))
        left = open_bins.count()
        if groups == 1 or groups == fewest and step.select("parent").distinct().count() == last:
            break
        last, level = left, level + 1
    if moves is None:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    joined = placed.drop("shift").join(moves, "bin", "left")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
