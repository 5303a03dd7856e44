"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

The vocabulary of ranks is a file with a base64 token and its rank on each line. Pre-tokens that are
tokens themselves are found by one probe of a minimal perfect hash (hash and displace: two displacements for
each bucket send every token to a slot of its own); others merge their bytes, lowest rank first, by a heap of
neighbouring pairs over a doubly linked list. Workers remember a bounded number of recent pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens a worker remembers (about 250 bytes each) before it starts anew.
REMEMBERED = 250_000
#: The largest prime below 2**32: hashes are taken modulo it first, so that no size of table repeats early.
PRIME = 4_294_967_291


class PerfectHash:
    """A minimal perfect hash of byte strings; ``slot`` gives -1 for strings outside the set."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        import xxhash

        self._hash = xxhash.xxh64_intdigest
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [self._hash(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        high = np.array([h >> 32 for h in hashes], dtype=np.uint64)
        low = np.array([h & 0xFFFFFFFF for h in hashes], dtype=np.uint64) | np.uint64(1)
        self.turn, self.shift = [0] * self.buckets, [0] * self.buckets
        free = np.ones(self.n, bool)
        slots = np.zeros(self.n, np.int64)
        s = 0

        def next_free(at: int) -> int:
            return at + int(np.argmax(free[at:]))

        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if not own:
                break
            if len(own) == 1:
                slots[own[0]] = s = next_free(s)
                self.turn[b], self.shift[b] = 0, (s - int(high[own[0]]) % PRIME) % self.n
                free[s] = False
                continue
            for trial in range(1 << 16):
                turn, base = divmod(trial, -(-self.n // 512))
                tried = np.arange(512 * base, 512 * base + 512, dtype=np.uint64)
                at = ((high[own] + np.uint64(turn) * low[own])[None, :] % np.uint64(PRIME) + tried[:, None]) % np.uint64(self.n)
                fits = free[at].all(axis=1)
                ordered = np.sort(at, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fits.any():
                    d = int(np.argmax(fits))
                    self.turn[b], self.shift[b], slots[own] = turn, 512 * base + d, at[d].astype(np.int64)
                    free[at[d]] = False
                    break
            else:
                raise ValueError("no displacement found; are there repeated keys?")
        self.keys: list[bytes] = [b""] * self.n
        self.order = slots
        for i, s in enumerate(slots.tolist()):
            self.keys[s] = keys[i]

    def slot(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = self._hash(key)
        b = h % self.buckets
        s = (((h >> 32) + self.turn[b] * ((h & 0xFFFFFFFF) | 1)) % PRIME + self.shift[b]) % self.n
        return s if self.keys[s] == key else -1


class ByteBpe:
    """Encoder and decoder for one vocabulary, without special tokens."""

    def __init__(self, file: bytes, pattern: str):
        import regex

        self.tokens: dict[int, bytes] = {}
        for line in file.split(b"\n"):
            if line.strip():
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        self.ranks = {t: r for r, t in self.tokens.items()}
        ranked = list(self.tokens.items())
        self.whole = PerfectHash([t for _, t in ranked])
        self.packed: list[bytes] = [b""] * len(ranked)
        for (rank, _), s in zip(ranked, self.whole.order.tolist(), strict=True):
            self.packed[s] = rank.to_bytes(4, "little")
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank (leftmost of equals) merges until none can."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # a piece is word[i:end[i]]; the next begins at end[i]
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            # stale unless the piece at i and its neighbour are still the ones that were seen
            if not alive[i] or end[i] >= stop or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def piece(self, text: str) -> bytes:
        """Packed ids (4 bytes each, little-endian) of a pre-token."""
        word = text.encode("utf-8")
        s = self.whole.slot(word)
        packed = self.packed[s] if s >= 0 else b"".join([i.to_bytes(4, "little") for i in self.merge(word)])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(word) <= 64:
            self.known[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        known, piece = self.known.get, self.piece
        return b"".join([known(p) or piece(p) for p in self.split(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def load(file: bytes, pattern: str) -> ByteBpe:
    """One encoder for each worker process and vocabulary."""
    key = (hashlib.sha256(file).hexdigest(), pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(file, pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, array<int>, if asked) for every row.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the bytes that the ids
    decode to. A null text is an empty one; repeated rows and null ids give a row each; an empty table
    gives an empty result. Other columns are not read. ``vocabulary`` is a path that the driver can open;
    its content (under 1 MB) is broadcast.
    """
    with open(vocabulary, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file.value, pattern)
        for b in batches:
            counts, ids, decoded, packed = [], [], [], []
            for text in b.column("text"):
                p = bpe.encode(text.as_py() or "")
                counts.append(len(p) // 4)
                ids.append(hashlib.sha256(p).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(p)).hexdigest())
                if with_ids:
                    packed.append(np.frombuffer(p, "<u4").astype(np.int32))
            arrays = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(packed, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
