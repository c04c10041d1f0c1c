"""Divergence of sources: how far the words of each (language, source) group lie
from those of the other sources of its language, in exact integers.

Terms are counted in numpy, a batch of whole texts at a time, on their UTF-8
bytes. Length-bucketed packing: a term of up to 8 bytes is one unsigned 64-bit
word, one of up to 16 bytes two words, and both buckets are sorted by radix (16
bits a pass, least significant first, stable) and counted by runs. Longer terms
lie in buckets of doubling widths that are sorted as bytes. Only the runs, (group, term,
occurrences, documents), leave the task; Spark adds them up, keeps the terms of
each language, and deals the kept terms over the tasks that compare sources.

The comparison reads each kept term once with its counts in all sources of the
language and adds to a matrix of sources by sources, in blocks of BLOCK
sources; no pair of sources is ever a row before it is a sum. The groups are held
by each task: the answer has their square.

Defined cases: null text, language and source are ''. Every row is a document
of its own, repeated ids too. A group without terms has all its counts 0. A language
without kept terms gives pairs of value 0 and no terms. One source alone gives
no pairs. Extra columns are ignored; an empty table gives an empty result. Exact for up to 2 x 10^14
occurrences.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.shared import written
from vitrine.session import ship_package

#: Bytes of text that are counted at a time; a longer text is counted by itself.
PIECE = 4 << 20
#: Sources of a language that are compared with so many others in one matrix.
BLOCK = 256
#: Numbers of all matrices of a task; over it, the sums so far are sent on.
MATRIX_NUMBERS = 1 << 23
SCALE = 1_000_000_000

_BYTE = np.arange(256)
IS_TERM = (_BYTE >= 0x80) | ((_BYTE | 0x20) >= 0x61) & ((_BYTE | 0x20) <= 0x7A) & (_BYTE >= 0x41)
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)


def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length, text number) of the terms of the texts in ``data``
    (bytes); text i ends before byte ``ends[i]``."""
    inside = IS_TERM[data]
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside
    cuts = ends[ends < len(data)]
    starts_new = np.zeros(len(data) + 1, bool)
    starts_new[cuts] = True
    first = np.flatnonzero(inside & (~after[:-1] | starts_new[:-1]))
    before = np.zeros(len(data) + 1, bool)
    before[:-1] = inside
    last = np.flatnonzero(inside & (~before[1:] | starts_new[1:]))
    return first, last - first + 1, np.searchsorted(ends, first, "right")


def words_at(data: bytes, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ``length`` (0 to 8) bytes from ``at`` on as big-endian 64-bit words, zeros behind."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        own = (at & 7) == k
        out[own] = np.frombuffer(data, ">u8", (len(data) - k) // 8, k)[at[own] >> 3]
    shift = (8 * (8 - length)).astype(np.uint64)
    return np.where(length > 0, (out >> np.minimum(shift, 63)) << np.minimum(shift, 63), 0).astype(np.uint64)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by unsigned keys, the least significant key first, 16 bits a pass."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for low in range(0, key.dtype.itemsize * 8, 16):
            digit = ((key >> np.array(low, key.dtype)) & np.array(0xFFFF, key.dtype)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(columns: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index, rows, distinct documents) of the runs of equal columns in
    sorted rows, where the documents of a run ascend."""
    change = np.zeros(len(doc), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(change)
    rows = np.diff(np.append(first, len(doc)))
    change[1:] |= doc[1:] != doc[:-1]
    return first, rows, np.add.reduceat(change, first) if len(first) else rows


def count_terms(data: np.ndarray, ends: np.ndarray, group: np.ndarray):
    """Yields (group, hi, lo, long terms, occurrences, documents) for each length
    bucket of the texts in ``data``; ``group`` is the group of each text."""
    first, length, doc = spans(data, ends)
    own = group.astype(np.uint32)[doc]
    low = LOWER[data].tobytes()
    padded = low + bytes(24 - len(low) % 8)
    for pick, n_words in ((length <= 8, 1), ((length > 8) & (length <= 16), 2)):
        at, size, g, d = first[pick], length[pick], own[pick], doc[pick]
        if not len(at):
            continue
        hi = words_at(padded, at, np.minimum(size, 8))
        lo = words_at(padded, at + 8, size - 8) if n_words == 2 else np.zeros(len(at), np.uint64)
        order = radix_order([g, lo, hi] if n_words == 2 else [g, hi])
        g, hi, lo, d = g[order], hi[order], lo[order], d[order]
        start, n, docs = runs([hi, lo, g], d)
        yield g[start], hi[start].view(np.int64), lo[start].view(np.int64), None, n, docs
    width = 32
    while width < 2 * (length.max() if len(length) else 0):
        pick = np.flatnonzero((length > max(16, width // 2)) & (length <= width))
        if len(pick):
            terms = np.array([low[a:a + m] for a, m in zip(first[pick].tolist(), length[pick].tolist())], f"S{width}")
            order = radix_order([own[pick]])
            order = order[np.argsort(terms[order], kind="stable")]
            terms, g = terms[order], own[pick][order]
            start, n, docs = runs([terms, g], doc[pick][order])
            yield g[start], None, None, terms[start].tolist(), n, docs
        width *= 2


COUNTS = "lang string, source string, hi long, lo long, tail string, n long, docs long"


def _count_batches(batches):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("hi", pa.int64()), ("lo", pa.int64()),
                        ("tail", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        if not len(texts):
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            continue
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        names: dict[tuple[str, str], int] = {}
        group = np.array([names.setdefault(pair, len(names)) for pair in
                          zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])
        langs, sources = (pa.array([pair[k] for pair in names], pa.string()) for k in (0, 1))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
            for g, hi, lo, tail, n, docs in count_terms(data[offsets[i]:offsets[j]], offsets[i + 1:j + 1] - offsets[i], group[i:j]):
                none = pa.array(np.zeros(len(g), np.int64))
                ids = pa.array(g.astype(np.int64))
                yield pa.RecordBatch.from_arrays([
                    langs.take(ids), sources.take(ids), none if hi is None else pa.array(hi), none if lo is None else pa.array(lo),
                    pa.array([""] * len(g) if tail is None else tail, pa.binary()).cast(pa.string()),
                    pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], schema=schema)
            i = j


def term_text() -> Column:
    """The term of packed words (hi, lo) or of a long term (tail)."""
    digits = F.concat(F.hex("hi"), F.when(F.col("lo") != 0, F.hex("lo")).otherwise(F.lit("")))
    packed = F.decode(F.unhex(F.regexp_replace(digits, "(00)+$", "")), "UTF-8")
    return F.when(F.col("tail") != "", F.col("tail")).otherwise(packed)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exactly, for totals up to 2 x 10^14."""
    a, b = 31_250, 32_000                       # SCALE in two factors, so that products fit 64 bits
    q, r = np.divmod((count + 2) * a, total)
    return 1 + q * b + r * b // total


def _share(count: str, total: str, kept: str) -> Column:
    return F.expr(f"1 + (cast({count} + 2 as decimal(20, 0)) * {SCALE}) div ({total} + 2 * {kept})")


def _compare(shared):
    """mapInArrow function over (lang, row block, column block, [(source, n)]): sums of each two sources."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def sums(matrices):
        for (lang, i, j), m in matrices.items():
            names = shared.value[lang][0]
            x, y = np.indices(m.shape)
            pick = (x + i * BLOCK) < (y + j * BLOCK)
            a, b = (x[pick] + i * BLOCK).tolist(), (y[pick] + j * BLOCK).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(a), pa.string()), pa.array([names[k] for k in a], pa.string()),
                pa.array([names[k] for k in b], pa.string()), pa.array(m[pick])], schema=schema)

    def run(batches):
        matrices: dict[tuple[str, int, int], np.ndarray] = {}
        index: dict[str, dict[str, int]] = {}
        for batch in batches:
            rows = defaultdict(list)
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                rows[key].append(k)
            counts = batch.column(3)
            for (lang, i, j), own in rows.items():
                names, totals = shared.value[lang]
                at = index.setdefault(lang, {s: k for k, s in enumerate(names)})
                m = matrices.setdefault((lang, i, j), np.zeros(
                    (len(names[i * BLOCK:(i + 1) * BLOCK]), len(names[j * BLOCK:(j + 1) * BLOCK])), np.int64))
                for k in range(0, len(own), 256):
                    some = own[k:k + 256]
                    grid = np.zeros((len(some), len(names)), np.int64)
                    for line, row in enumerate(some):
                        for pair in counts[row].as_py():
                            grid[line, at[pair["source"]]] = pair["n"]
                    left, right = (share(grid[:, s], totals[s]) for s in (
                        slice(i * BLOCK, (i + 1) * BLOCK), slice(j * BLOCK, (j + 1) * BLOCK)))
                    for a in range(left.shape[1]):
                        p = left[:, a:a + 1]
                        m[a] += ((p - right) ** 2 // (p + right)).sum(0)
            if sum(m.size for m in matrices.values()) > MATRIX_NUMBERS:
                yield from sums(matrices)
                matrices.clear()
        yield from sums(matrices)

    return run


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: for each group
    its divergence from every other source of the language, and the ``top`` terms
    that are more frequent in it than in the language, by divergence."""
    spark = docs.sparkSession
    ship_package(spark)
    clean = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in
                          ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    term, group = ["lang", "hi", "lo", "tail"], ["lang", "source"]
    counts = (clean.mapInArrow(_count_batches, COUNTS).groupBy("source", *term)
              .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = written(counts.groupBy(*term).agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"),
                                              F.collect_list(F.struct("source", "n")).alias("counts"))
                    .where(F.col("docs") >= min_docs).drop("docs"), "terms")
    each = terms.select(*term, F.col("n").alias("lang_n"), F.inline("counts"))
    stats = written(clean.select(*group).distinct()
                    .join(each.groupBy(*group).agg(F.sum("n").alias("total")), group, "left")
                    .join(terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("kept")), "lang", "left")
                    .fillna(0, ["total", "lang_total", "kept"]), "groups")

    held: dict[str, tuple[list[str], np.ndarray]] = {}
    for r in sorted(stats.select(*group, (F.col("total") + 2 * F.col("kept")).alias("t")).collect()):
        held.setdefault(r["lang"], ([], []))[0].append(r["source"])
        held[r["lang"]][1].append(r["t"])
    shared = spark.sparkContext.broadcast({k: (names, np.array(t, np.int64)) for k, (names, t) in held.items()})
    blocks = stats.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    tiles = blocks.select("lang", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), "blocks").select(
        "lang", "i", F.explode(F.expr("sequence(i, blocks - 1)")).alias("j"))
    sums = (terms.select("lang", "counts").join(F.broadcast(tiles), "lang").select("lang", "i", "j", "counts")
            .mapInArrow(_compare(shared), "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = (stats.select(*group).join(stats.select("lang", F.col("source").alias("item")), "lang")
              .where("source <> item"))
    pairs = (others.join(both, ["lang", "source", "item"], "left")
             .select(*group, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))

    found = (each.join(stats, group).withColumn("p", _share("n", "total", "kept"))
             .withColumn("q", _share("lang_n", "lang_total", "kept")).where("p > q")
             .select(*group, F.lit("term").alias("part"), term_text().alias("item"),
                     F.expr("((p - q) * (p - q)) div (p + q)").alias("value")))
    by = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    return (pairs.withColumn("rank", F.row_number().over(by))
            .unionByName(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)))
