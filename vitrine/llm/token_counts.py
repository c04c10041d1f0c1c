"""Token counts of a document's sections by offset-mapped attribution.

Each whole text is encoded once. The byte lengths of its tokens give their
character spans, and an interval join by binary search assigns the tokens to
the sections. A token that crosses a boundary goes by an explicit rule:

- ``start``: to the section that holds its first character;
- ``end``: to the section that holds its last character;
- ``most``: to the section with most of its characters, the earlier on a tie.

A token that starts or ends within a character (a byte token) counts as covering
that character. Tokens outside all sections are counted under section -1.

Sections are spans (start, end) of code points, ascending and disjoint; by
default the lines of the text, each with its line feed. Defined cases: a null
text has no tokens and, like an empty one, one empty line; ids may be null or
repeat, each row counts by itself; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.rank_tokens import encode, library, share_ranks

RULES = ("start", "end", "most")


def token_spans(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (first, last) that each token covers; ``data`` is the text in
    UTF-8, ``sizes`` the tokens' byte lengths."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer(data, np.uint8)
    if len(raw) and raw.max() < 0x80:
        return starts, ends - 1
    at = np.cumsum((raw & 0xC0) != 0x80) - 1             # code point of each byte
    return at[starts], at[ends - 1]


def line_starts(data: bytes) -> np.ndarray:
    """Code points at which lines start."""
    raw = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(raw == 10)
    if len(raw) and raw.max() >= 0x80:
        breaks = (np.cumsum((raw & 0xC0) != 0x80) - 1)[breaks]
    return np.concatenate(([0], breaks + 1))


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token, -1 for none. Sections are [start, end)."""
    def holding(point):
        k = np.searchsorted(starts, point, "right") - 1
        # empty sections share their start with the next one; the last at a point holds it
        return np.where((k >= 0) & (point < ends[np.maximum(k, 0)]), k, -1) if len(starts) else np.full(len(point), -1)

    if rule == "end":
        return holding(last)
    if rule == "start" or not len(starts):
        return holding(first)
    best, most = np.full(len(first), -1), np.zeros(len(first), np.int64)
    k = np.maximum(np.searchsorted(starts, first, "right") - 1, 0)
    todo = np.ones(len(first), bool)
    while todo.any():
        inside = np.minimum(ends[k], last + 1) - np.maximum(starts[k], first)
        better = todo & (inside > most)
        best[better], most[better] = k[better], inside[better]
        todo &= (k + 1 < len(starts))
        k = np.minimum(k + 1, len(starts) - 1)
        todo &= starts[k] <= last
    return best


def count(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
          sections_col: str | None = None, rule: str = "start") -> DataFrame:
    """One row per section: doc_id, section (from 0), start, end, n_tokens,
    doc_tokens; and one with section -1 where tokens lie outside all sections.
    ``sections_col``: array<struct<start: long, end: long>>; lines if None."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    key, shared = share_ranks(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        encoding, sizes = library(key, shared)
        for batch in batches:
            ids_out, parts = [], []
            texts = batch.column(1).to_pylist()
            own = batch.column(2).to_pylist() if sections_col else [None] * len(texts)
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), texts, own):
                data = (text or "").encode()
                tokens = encode(encoding, text or "")
                first, last = token_spans(data, sizes[tokens])
                if sections_col:
                    starts = np.array([s["start"] for s in spans or ()], np.int64)
                    ends = np.array([s["end"] for s in spans or ()], np.int64)
                else:
                    starts = line_starts(data)
                    ends = np.append(starts[1:], len(text or ""))
                to = attribute(first, last, starts, ends, rule)
                n = np.bincount(to + 1, minlength=len(starts) + 1)
                section = np.arange(-1, len(starts))
                s, e = np.append(-1, starts), np.append(-1, ends)
                if not n[0]:
                    section, s, e, n = section[1:], s[1:], e[1:], n[1:]
                ids_out += [doc_id] * len(n)
                parts.append((section, s, e, n, np.full(len(n), len(tokens))))
            cols = [np.concatenate(c).astype(np.int64) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids_out, pa.int64()), *map(pa.array, cols)],
                                             ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *([F.col(sections_col).alias("sections")] if sections_col else []))
    return rows.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, doc_tokens long")
