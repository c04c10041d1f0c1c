"""Periodic runs in the words of a text: stretches that repeat a period at least
four times, found through Lyndon arrays.

Every run has, under one order of the words or its reverse, a Lyndon root: the
longest Lyndon word at its place is one period of the run. The first phase of
Baier's suffix sorter gives these words directly: groups of positions are taken
from the highest down, and each position found next on the left of a group's
members is extended by the group's word and moves to a new group right above its
own; when a group is taken, its word is the longest Lyndon word of its members.
Both orders are sorted so. Roots whose next words match one period on are
extended left and right as far as the words agree (LCE, compared in blocks of
doubling size) and are runs if they are long enough.

Only stretches that can hold such a run are sorted: every window of 4 words of a
run with period q and length L >= max(6, 4q) recurs in the run q words before or
after, and 4q <= L. So windows that recur in the text at a distance of a quarter
of their stretch or less are kept, until nothing changes. Windows are compared by a
64-bit hash, which can only keep too many. Nothing else is left out.

Defined cases: a null text has no words: no run, four nulls, hashes of the
empty string. Repeated rows give a row each; a null id stays null. Extra columns are
ignored; an empty table gives an empty result. One text is held by one task,
at about a hundred bytes a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import let
from vitrine.session import ship_package

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Words of a window. By MIN_LENGTH and MIN_EXPONENT every window of a run recurs in it.
WINDOW = 4
#: Words of all texts that are searched for windows at a time; a longer text is searched by itself.
PIECE_WORDS = 1 << 19
#: Rounds of narrowing stretches; more would only save time.
ROUNDS = 32


def lyndon_lengths(s: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each position."""
    n = len(s)
    initial: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        initial.setdefault(c, []).append(i)
    members = [initial[c] for c in sorted(initial)]
    size = [len(m) for m in members]                # members that have not moved on
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    length = [1] * n
    left, right = list(range(-1, n)), list(range(1, n + 2))    # of the positions not taken yet; n and -1 are ends
    top = len(members) - 1
    above[top:] = [-1]
    while top >= 0:
        g, own = top, members[top]
        if size[g]:
            if size[g] != len(own):
                own = [i for i in own if group[i] == g]
            span = length[own[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            last, times = -1, 0
            for i in own:                           # ascending, so left[i] is not of this group
                j, k = left[i], right[i]
                left[k] = j
                if j >= 0:
                    right[j] = k
                    if j == last:
                        times += 1
                        continue
                    if last >= 0:
                        moved.setdefault((group[last], times), []).append(last)
                    last, times = j, 1
            if last >= 0:
                moved.setdefault((group[last], times), []).append(last)
            # of one group, the positions that were met most often end up highest
            for (h, times), some in sorted(moved.items(), reverse=True):
                for j in some:
                    length[j] += times * span
                if size[h] == len(some):            # all that is left of the group moves: it stays where it is
                    members[h] = some
                    continue
                new, up = len(members), above[h]
                members.append(some)
                size.append(len(some))
                size[h] -= len(some)
                below.append(h)
                above.append(up)
                above[h] = new
                if up >= 0:
                    below[up] = new
                for j in some:
                    group[j] = new
        top = below[g]
    return length


def agreement(s: np.ndarray, i: int, j: int, step: int) -> int:
    """LCE: how many words from i and j > i on agree, to the right (step 1) or left (step -1)."""
    found, block = 0, 16
    while True:
        if step > 0:
            a, b = s[i + found:i + found + block], s[j + found:j + found + block]
            a = a[:len(b)]
        else:
            stop = i - found + 1
            block_now = min(block, max(stop, 0))
            a, b = s[stop - block_now:stop][::-1], s[j - found + 1 - block_now:j - found + 1][::-1]
        differ = a != b
        if differ.any():
            return found + int(differ.argmax())
        found += len(a)
        if len(a) < block:
            return found
        block *= 2


def runs_between(s: np.ndarray, first: int, end: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``s`` that lie in s[first:end]."""
    part = s[first:end]
    _, ranks = np.unique(part, return_inverse=True)
    found: set[tuple[int, int, int]] = set()
    for order in (ranks, ranks.max() - ranks):
        q = np.array(lyndon_lengths(order.tolist()))
        i = np.flatnonzero((q * MIN_EXPONENT <= len(part)) & (np.arange(len(part)) + q + WINDOW <= len(part)))
        for t in range(WINDOW):
            i = i[part[i + t] == part[i + q[i] + t]]
        i = i[np.argsort(q[i], kind="stable")]
        period, done = 0, -1
        for at, p in zip((i + first).tolist(), q[i].tolist()):
            if p == period and at < done:
                continue
            stop = at + p + agreement(s, at, at + p, 1)
            start = at - agreement(s, at - 1, at + p - 1, -1)
            period, done = p, stop - p
            if stop - start >= max(MIN_LENGTH, MIN_EXPONENT * p):
                found.add((start, stop - start, p))
    return found


def stretches(s: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words that can hold a run; ``text`` is the text of each word."""
    n = len(s) - WINDOW + 1
    if n <= 0:
        return []
    key = text[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for t in range(WINDOW):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + s[t:n + t].astype(np.uint64)
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    gap = np.where(same, order[1:] - order[:-1], n + WINDOW)
    near = np.full(n, n + WINDOW)
    near[order[:-1]] = gap
    near[order[1:]] = np.minimum(near[order[1:]], gap)
    at = np.flatnonzero((near < n + WINDOW) & (text[:n] == text[WINDOW - 1:]))
    for _ in range(ROUNDS):
        cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])) + 1
        bounds = np.concatenate([[0], cut, [len(at)]])
        words = np.diff(bounds) + WINDOW - 1
        keep = near[at] * MIN_EXPONENT <= np.repeat(np.where(words >= MIN_LENGTH, words, 0), np.diff(bounds))
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return []
    return [(int(at[a]), int(at[b - 1]) + WINDOW) for a, b in zip(bounds[:-1], bounds[1:])]


def texts_runs(ids: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    k = 0
    while k < len(ids):
        j, size = k, 0
        while j < len(ids) and (j == k or size + len(ids[j]) <= PIECE_WORDS):
            size += len(ids[j])
            j += 1
        text = np.repeat(np.arange(k, j), [len(x) for x in ids[k:j]])
        offset = np.cumsum([0] + [len(x) for x in ids[k:j]])
        for first, end in stretches(np.concatenate(ids[k:j]), text):
            own = int(text[first])
            base = int(offset[own - k])
            out[own] += runs_between(ids[own], first - base, end - base)
        k = j
    return [sorted(set(x), key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, each run cut down to its first period."""
    if runs:
        level = np.zeros(len(words) + 1, np.int64)
        for start, size, q in runs:
            level[start + q] += 1
            level[start + size] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(level[:-1]) == 0).tolist()]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batches(batches):
    for batch in batches:
        words = [(t or b"").split() for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        vocabulary: dict[bytes, int] = {}
        for w in words:
            for x in set(w):
                vocabulary.setdefault(x, len(vocabulary))
        ids = [np.fromiter(map(vocabulary.__getitem__, w), np.int64, len(w)) for w in words]
        found = texts_runs(ids)
        yield pa.RecordBatch.from_arrays([
            batch.column(0),
            pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in found], pa.list_(_RUN)),
            pa.array([collapsed(w, x) for w, x in zip(words, found)], pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
            ["doc_id", "runs", "collapsed"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and
    collapsed (the text's words with each run cut down to its first period)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_batches, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Per text: n_runs, the longest run and its exponent in thousandths, and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                       (-F.col("best.period")).alias("period"),
                       F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def planted(text: Column, seed: Column) -> Column:
    """``text`` with a known repetition: for seeds divisible by 10 all words from
    word a on repeat the next p words; the words are joined by spaces. Any other
    seed, null too, leaves the text as it is."""
    g = F.floor(seed / 10)

    def rewrite(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.array(a, p)
        return let(at, lambda x: F.array_join(F.transform(words, lambda w, i: F.when(i < x[0], w).otherwise(
            F.get(words, (x[0] + (i - x[0]) % x[1]).cast("int")))), " "))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(seed % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, rewrite(w)).otherwise(F.lit("")))).otherwise(text)
