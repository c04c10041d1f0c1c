"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split into pre-tokens by the vocabulary's pattern. Tier one: a minimal
perfect hash over the vocabulary's byte strings (one slot per string, no empty
slots) resolves every pre-token that is itself a token. Tier two: any other
pre-token starts as single bytes in a linked list; a heap yields the adjacent
pair whose joined bytes have the lowest rank, leftmost first, until no pair is
in the vocabulary. Work is done per Arrow batch: distinct pre-tokens are
resolved once and remembered in a memo of bounded size.

Defined cases: a null text is encoded like an empty one, to no ids; ids may be
null or repeat, each row is encoded by itself; a lone surrogate cannot occur in
Spark strings; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import ship_package

MEMO_WORDS = 300_000            # pre-tokens in each of a worker's two memos
BUCKET_KEYS = 4                 # keys per bucket of the perfect hash, on average


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _mix(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """64 bits of ``h`` stirred with the displacement ``d``."""
    x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """A minimal perfect hash by hash and displace: keys fall into small buckets;
    buckets, largest first, take the first displacement that sends all their
    keys to free slots. A lookup is two array reads and one comparison."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.m = max(1, n // BUCKET_KEYS)
        self.keys: list[bytes] = [b""] * n
        self.index = np.zeros(n, np.int64)
        self.shift = np.zeros(self.m, np.uint32)
        if not n:
            return
        h = self._hashes(keys)
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.m + 1))
        free = np.ones(n, bool)
        tries = np.arange(1, 65, dtype=np.uint64)
        for b in np.argsort(-np.diff(starts), kind="stable"):
            members = order[starts[b]:starts[b + 1]]
            if not len(members):
                break
            d = np.uint64(0)
            while True:
                slots = (_mix(h[members][None, :], (d + tries)[:, None]) % np.uint64(n)).astype(np.int64)
                good = free[slots].all(1)
                if len(members) > 1:
                    s = np.sort(slots, 1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    k = int(good.argmax())
                    break
                d += np.uint64(64)
            self.shift[b] = d + tries[k]
            free[slots[k]] = False
            for i, slot in zip(members, slots[k]):
                self.keys[slot] = keys[i]
                self.index[slot] = i

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(k) for k in keys), np.uint64, len(keys))

    def find(self, keys: list[bytes]) -> list[int]:
        """The index of each key in the list the hash was built from, or -1."""
        if not keys or not self.n:
            return [-1] * len(keys)
        h = self._hashes(keys)
        slots = (_mix(h, self.shift[(h % np.uint64(self.m)).astype(np.int64)]) % np.uint64(self.n)).astype(np.int64)
        own, index = self.keys, self.index[slots].tolist()
        return [i if own[s] == k else -1 for k, s, i in zip(keys, slots.tolist(), index)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token by heap merges over linked bytes."""
    n = len(piece)
    end = list(range(1, n + 1))                 # where the part that starts at i ends
    left = list(range(-1, n - 1))               # start of the part before, -1 at the front
    get = ranks.get
    heap = []
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapify(heap)
    dead = bytearray(n)
    while heap:
        r, i, stop = heappop(heap)
        j = end[i]
        if dead[i] or j >= n or end[j] != stop:
            continue                            # a part of the pair has changed since
        end[i] = stop
        dead[j] = 1
        if stop < n:
            left[stop] = i
            q = get(piece[i:end[stop]])
            if q is not None:
                heappush(heap, (q, i, end[stop]))
        p = left[i]
        if p >= 0:
            q = get(piece[p:stop])
            if q is not None:
                heappush(heap, (q, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


#: Characters on which the plain patterns below agree with the Unicode classes
#: of the vocabulary's pattern: ASCII without the separators 1C-1F, and Latin
#: letters.
_PLAIN = re.compile("[^\t-\r\x20-\x7eÀ-ÖØ-öø-ɏ]")
_NUMBER, _LETTER = r"\p{N}", r"\p{L}"


def plain_pattern(pattern: str) -> str:
    """The pattern for texts of plain characters only, in the standard library's
    syntax: its letters are word characters but digits and _, its numbers digits."""
    return (pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)")
            .replace(_LETTER, r"[^\W\d_]").replace(_NUMBER, r"[0-9]"))


class Encoder:
    """Encodes and decodes texts by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, perfect: PerfectHash | None = None):
        import regex

        self.ranks = ranks
        self.tokens = sorted(ranks, key=ranks.get)
        self.ids = [ranks[t] for t in self.tokens]
        self.perfect = perfect or PerfectHash(self.tokens)
        self.split_any = regex.compile(pattern).findall
        self.split_plain = re.compile(plain_pattern(pattern)).findall
        size = max(self.ids, default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.memo: dict[str, bytes] = {}        # words used since the last turn
        self.older: dict[str, bytes] = {}       # and those of the turn before

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if _PLAIN.search(text) else self.split_plain(text)

    def _learn(self, words: list[str]) -> None:
        """Put pre-tokens that are not in the memo there."""
        memo, older, ids, ranks = self.memo, self.older, self.ids, self.ranks
        memo.update((w, older[w]) for w in words if w in older)
        words = [w for w in words if w not in older]
        pieces = [w.encode("utf-8", "surrogatepass") for w in words]
        for word, piece, at in zip(words, pieces, self.perfect.find(pieces)):
            found = [ids[at]] if at >= 0 else merge_bytes(piece, ranks)
            memo[word] = pack(f"<{len(found)}I", *found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Texts
        are taken in runs, so that a run's words fit the memo."""
        out: list[bytes] = []
        for text in texts:
            parts = []
            words = self.split(text)
            for k in range(0, len(words), MEMO_WORDS // 2):
                some = words[k:k + MEMO_WORDS // 2]
                distinct = set(some)
                if len(self.memo) + len(distinct) > MEMO_WORDS:
                    self.memo, self.older = {}, self.memo
                memo = self.memo
                new = [w for w in distinct if w not in memo]
                if new:
                    self._learn(new)
                parts.append(b"".join(map(self.memo.__getitem__, some)))
            out.append(parts[0] if len(parts) == 1 else b"".join(parts))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, shared) -> Encoder:
    """The worker's encoder; kept between the tasks of a worker."""
    if key not in _ENCODERS:
        ranks, pattern, perfect = shared.value
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern, perfect)
    return _ENCODERS[key]


def share_vocabulary(spark, ranks_path: str, pattern: str):
    """(key, broadcast) of the vocabulary and its perfect hash. Its size is that
    of the rank file, whatever the data."""
    ship_package(spark)
    ranks = read_ranks(ranks_path)
    perfect = PerfectHash(sorted(ranks, key=ranks.get))
    key = hashlib.sha256(repr((ranks_path, pattern, len(ranks))).encode()).hexdigest()
    return key, spark.sparkContext.broadcast((ranks, pattern, perfect))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>): the token ids of each whole text."""
    key, shared = share_vocabulary(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        enc = _encoder(key, shared)
        for batch in batches:
            flat = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0] + [len(x) // 4 for x in flat]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(flat), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)],
                                             ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes: the bytes that the ids of each row stand for."""
    key, shared = share_vocabulary(encoded.sparkSession, ranks_path, pattern)

    def run(batches):
        enc = _encoder(key, shared)
        for batch in batches:
            out = [enc.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids again, in one pass: doc_id,
    n_tokens, ids_sha256 and decoded_sha256."""
    key, shared = share_vocabulary(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        enc = _encoder(key, shared)
        for batch in batches:
            ids = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                 pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
