"""Packing of tokenised documents into fixed windows, online and in bounded space.

Each partition keeps a fixed number of open windows. What a document has beyond
whole windows goes into the open window it fits best; when none fits and no
further window may be opened, the fullest one is topped up with a cut of the
piece and emitted. At the end of a partition its open windows are left over;
leftovers of MERGE_PARTITIONS partitions at a time are merged, the emptiest into
the gaps of the fullest, and the one partial window that remains is split at
powers of two, which need no padding. No task holds more than its open windows,
or the leftovers of MERGE_PARTITIONS partitions.

A document is its ids and the end id. Ids are those of the ``tokenizers`` file
whose ranks and added tokens are given (the same vocabulary); without added
tokens, special strings in a text are ordinary text. Defined cases: a null text is an empty one, that is, the end id
alone; null or repeated ids are separate documents; an empty table gives no
pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.rank_tokens import encode, library, share_ranks
from vitrine.llm.shared import cut

WINDOW = 1024
OPEN_WINDOWS = 64
MERGE_PARTITIONS = 64
END_ID = 0

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")


class Piece:
    """A run of a document's ids: the document, its place there, the ids' bytes."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id, start: int, doc_tokens: int, ids: bytes):
        self.doc_id, self.start, self.doc_tokens, self.ids = doc_id, start, doc_tokens, ids

    def __len__(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:4 * n]),
                Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[4 * n:]))


class Window:
    __slots__ = ("free", "pieces", "sequence")

    def __init__(self, sequence: int, size: int, pieces: list[Piece] | None = None):
        self.sequence, self.pieces = sequence, pieces or []
        self.free = size - sum(map(len, self.pieces))

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.free -= len(piece)


class OpenWindows:
    """At most ``count`` windows that still have room, by room."""

    def __init__(self, size: int, count: int, first_sequence: int):
        self.size, self.count, self.next = size, count, first_sequence
        self.windows: list[tuple[int, int, Window]] = []        # (free, sequence, window), sorted

    def _new(self) -> Window:
        self.next += 1
        return Window(self.next - 1, self.size)

    def add(self, piece: Piece) -> list[Window]:
        """Place a piece; returns the windows that are full now."""
        done: list[Window] = []
        while len(piece) >= self.size:
            full = self._new()
            head, piece = piece.split(self.size)
            full.put(head)
            done.append(full)
        while len(piece):
            at = bisect_left(self.windows, (len(piece),))
            if at < len(self.windows):                          # the least room that suffices
                _, _, w = self.windows.pop(at)
            elif len(self.windows) < self.count:
                w = self._new()
            else:                                               # none fits: the fullest goes
                _, _, w = self.windows.pop(0)
                head, piece = piece.split(w.free)
                w.put(head)
                done.append(w)
                continue
            w.put(piece)
            if w.free:
                insort(self.windows, (w.free, w.sequence, w))
            else:
                done.append(w)
            break
        return done

    def rest(self) -> list[Window]:
        return [w for _, _, w in self.windows]


def merge_windows(windows: list[Window], size: int, spare: int) -> list[Window]:
    """Full windows and the last partial one, split at powers of two. The
    emptiest windows fill the gaps of the fullest; ``spare`` is the first
    sequence number for the parts of the split."""
    order = sorted(windows, key=lambda w: (w.free, w.sequence))
    done: list[Window] = []
    i, j = 0, len(order) - 1
    while i < j:
        full, donor = order[i], order[j]
        while full.free and donor.pieces:
            piece = donor.pieces.pop()
            donor.free += len(piece)
            if len(piece) > full.free:
                keep, piece = piece.split(len(piece) - full.free)
                donor.put(keep)
            full.put(piece)
        if not donor.pieces:
            j -= 1
        if not full.free:
            done.append(full)
            i += 1
    if i == j and order[i].pieces:
        done += powers_of_two(order[i], size, spare)
    return done


def powers_of_two(window: Window, size: int, spare: int) -> list[Window]:
    """The window's pieces in windows of powers of two, largest first."""
    left, out, pieces = sum(map(len, window.pieces)), [], list(window.pieces)
    while left:
        part = Window(spare + len(out), 1 << (left.bit_length() - 1))
        while part.free:
            piece = pieces.pop(0)
            if len(piece) > part.free:
                piece, tail = piece.split(part.free)
                pieces.insert(0, tail)
            part.put(piece)
        out.append(part)
        left -= sum(map(len, part.pieces))
    return out


def _rows(windows: list[Window], with_ids: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(8)]
    for w in windows:
        offset = 0
        for p in w.pieces:
            for c, v in zip(cols, (p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, w.sequence, offset,
                                   p.ids if with_ids else None)):
                c.append(v)
            offset += len(p)
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      [x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID,
         added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    key, shared = share_ranks(docs.sparkSession, ranks_path, pattern, added)
    end = np.array([end_id], "<u4").tobytes()

    def fill(batches):
        encoding = library(key, shared)[0]
        space = OpenWindows(window, open_windows, TaskContext.get().partitionId() << 32)
        for batch in batches:
            done: list[Window] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(encoding, text or "", added=True).astype("<u4").tobytes() + end
                done += space.add(Piece(doc_id, 0, len(ids) // 4, ids))
                if len(done) >= 4096:
                    yield _rows(done, False)
                    done = []
            yield _rows(done, False)
        yield _rows(space.rest(), True)

    def merge(batches):
        parts: dict[int, dict[int, list]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                parts.setdefault(r["part"], {}).setdefault(r["sequence_id"], []).append(r)
        for part, found in sorted(parts.items()):
            windows = [Window(s, window, [Piece(r["doc_id"], r["start"], r["doc_tokens"], r["ids"])
                                          for r in sorted(rows, key=lambda r: r["offset"])])
                       for s, rows in found.items()]
            yield _rows(merge_windows(windows, window, (1 << 62) | (part << 16)), False)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(rows.mapInArrow(fill, PIECES))
    left = pieces.where(F.col("ids").isNotNull()).withColumn(
        "part", F.shiftright("sequence_id", 32).bitwiseAND((1 << 30) - 1).cast("long"))
    left = left.withColumn("part", F.floor(F.col("part") / MERGE_PARTITIONS))
    merged = left.repartition("part").mapInArrow(merge, PIECES)
    return pieces.where(F.col("ids").isNull()).unionByName(merged).drop("ids")
