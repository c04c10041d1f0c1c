"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits (even) have a common variant within
radius / 2 bits of both. So every distinct fingerprint emits all its variants
within half the radius, variants are shuffled, and fingerprints that share one
are linked; any two that meet are within the radius of each other, which is
verified once more. What is shuffled is the leading bits of the variants with
the fingerprint: a task that gets a prefix lists the variants under it. A prefix
with more than CHUNK_VARIANTS variants is extended by further bits, so a task
lists a bounded number of them however many fingerprints lie close together. The
members of a variant are linked in a chain, not in pairs, and each task sends on
only a spanning star of what its links join; connected components do the rest.

Texts are lower-cased (A-Z only), words are ``[^\\x20\\x09-\\x0D]+``, shingles of
``width`` words are joined by a space (a shorter text is one shingle), and a bit
is 1 if set in over half of the shingles' XXH64 values (seed 42). Defined cases:
a null text has no words; no words give fingerprint zero, linked like any other;
a null id is never the smallest of its component, and a component of null ids
only has a null id; repeated rows share a component; an empty table gives an
empty result; extra columns are ignored by ``link`` and returned as they are by
``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import components, cut, flag_in, lookup, row_hash
from vitrine.session import ship_package

WIDTH = 4
RADIUS = 4
SEED = 42
CHUNK_VARIANTS = 1_500_000      # variants a task lists at a time, and of one prefix
EXTEND_BITS = 8                 # by which a prefix with more variants grows
CHUNK_HASHES = 200_000          # shingle hashes a task holds beside one text's
TASK_BYTES = 64 << 20           # what a task emits
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], SEED)
            for a, b in zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``hashes``; ``sizes`` are the runs' lengths.
    Bits are summed in byte lanes, 255 values at a time."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    ends = np.cumsum(sizes)
    pieces = -(-sizes // 255)
    first = np.repeat(ends - sizes, pieces)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    bounds, runs = first + 255 * within, np.cumsum(pieces) - pieces
    half = sizes[:, None]
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, bounds)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), runs, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > half[:, 0]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """The fingerprint as a long (the 64 bits, signed)."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        out, runs = [], []
        for text in texts:
            runs.append(np.array(shingle_hashes(text, width), np.uint64))
            if len(runs) == 64 or sum(map(len, runs)) >= CHUNK_HASHES:
                out.append(majority_bits(np.concatenate(runs), np.array([len(x) for x in runs])))
                runs = []
        if runs:
            out.append(majority_bits(np.concatenate(runs), np.array([len(x) for x in runs])))
        return pd.Series(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64))

    return run(text)


def masks(bits: int, most: int) -> np.ndarray:
    """All masks over the low ``bits`` bits with at most ``most`` of them set."""
    layer = {0}
    found = set(layer)
    for _ in range(most):
        layer = {m | 1 << b for m in layer for b in range(bits)}
        found |= layer
    return np.array(sorted(found), np.uint64)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while True:
            again = new[new]
            if (again == new).all():
                break
            new = again
        if (new == root).all():
            return root
        root = new


def met(prefixes: np.ndarray, fps: np.ndarray, prefix_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller, larger fingerprint) between those that share a variant
    under one of their prefixes: a spanning star for each group they join."""
    low_bits = 64 - prefix_bits
    half = radius // 2
    own, at = np.unique(fps, return_inverse=True)
    left = half - _popcount(prefixes ^ (fps >> np.uint64(low_bits)))
    base = (prefixes << np.uint64(low_bits)) | (fps & np.uint64((1 << low_bits) - 1))
    variants, owners = [], []
    for d in range(half + 1):
        rows = np.flatnonzero(left == d)
        if len(rows):
            m = masks(low_bits, d)
            variants.append((base[rows][:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(at[rows], len(m)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, o = v[order], o[order]
    same = v[1:] == v[:-1]
    pairs = np.unique(np.minimum(o[1:], o[:-1])[same] * len(own) + np.maximum(o[1:], o[:-1])[same])
    a, b = pairs // len(own), pairs % len(own)
    near = _popcount(own[a] ^ own[b]) <= radius
    a, b = a[near & (a != b)], b[near & (a != b)]
    root = local_roots(len(own), a, b)
    moved = np.flatnonzero(root != np.arange(len(own)))
    return own[root[moved]], own[moved]


def _volumes(bits: int, half: int) -> list[int]:
    """How many masks over ``bits`` bits have at most 0, 1, ... ``half`` of them set."""
    return [sum(math.comb(bits, k) for k in range(d + 1)) for d in range(half + 1)]


def _hot(counts: DataFrame, prefix_bits: int, half: int, most: int) -> np.ndarray:
    """The prefixes with over ``most`` variants; ``counts`` (own, n) has the
    number of fingerprints by their own leading bits. At most (variants / most)
    prefixes are hot."""
    around, volumes = masks(prefix_bits, half), np.array(_volumes(64 - prefix_bits, half))
    each = volumes[half - _popcount(around)]
    # a prefix has at most the largest count near it times the variants of a fingerprint
    if not counts.where(F.col("n") * F.lit(int(each.sum())) > most).take(1):
        return np.zeros(0, np.uint64)

    def weigh(batches):
        for batch in batches:
            own, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for k in range(0, len(own), 4096):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((own[k:k + 4096, None] ^ around[None, :]).ravel().view(np.int64)),
                     pa.array((n[k:k + 4096, None] * each[None, :]).ravel())], ["prefix", "n"])

    return _prefixes(counts.mapInArrow(weigh, "prefix long, n long"), most)


def _prefixes(weights: DataFrame, most: int) -> np.ndarray:
    rows = weights.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("prefix").collect()
    return np.sort(np.array([r.prefix for r in rows], np.int64).view(np.uint64))


def links(fps: DataFrame, radius: int = RADIUS, most: int = CHUNK_VARIANTS) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps`` (fp: long) whose
    components are those of all pairs within ``radius`` bits. ``most``: variants
    of a prefix, above which it is extended."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: variants meet half-way")
    n = fps.count()
    prefix_bits = min(32, max(12, math.ceil(math.log2(max(n, 1))) - 2))
    half, low_bits = radius // 2, 64 - prefix_bits
    around = masks(prefix_bits, half)
    ship_package(fps.sparkSession)
    counts = cut(fps.groupBy(F.shiftrightunsigned("fp", low_bits).alias("own")).agg(F.count(F.lit(1)).alias("n")))
    hot = _hot(counts, prefix_bits, half, most)

    def emit(batches, want_hot: bool, hot=hot, low_bits=low_bits):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 4096):
                some = fp[k:k + 4096]
                prefixes = ((some >> np.uint64(low_bits))[:, None] ^ around[None, :]).ravel()
                owners = np.repeat(some, len(around))
                if len(hot):
                    take = np.isin(prefixes, hot) == want_hot
                    prefixes, owners = prefixes[take], owners[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefixes.view(np.int64)), pa.array(owners.view(np.int64))], ["prefix", "fp"])

    def longer(bits: int, step: int):
        """Rows of prefixes of ``bits`` bits as rows of prefixes longer by ``step``."""
        low = 64 - bits - step

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    prefixes, fp = (part.column(k).to_numpy().view(np.uint64) for k in (0, 1))
                    left = half - _popcount(prefixes ^ (fp >> np.uint64(low + step)))
                    own = (prefixes << np.uint64(step)) | ((fp >> np.uint64(low)) & np.uint64((1 << step) - 1))
                    for d in range(half + 1):
                        rows = np.flatnonzero(left == d)
                        m = masks(step, d)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array((own[rows][:, None] ^ m[None, :]).ravel().view(np.int64)),
                             pa.array(np.repeat(fp[rows], len(m)).view(np.int64))], ["prefix", "fp"])
        return run

    def collided(rows: DataFrame, bits: int) -> DataFrame:
        volumes = np.array(_volumes(64 - bits, half))

        def variants(rows):
            prefixes, fp = rows.view(np.uint64)
            return volumes[half - _popcount(prefixes ^ (fp >> np.uint64(64 - bits)))]

        def done(rows):
            a, b = met(rows[0].view(np.uint64), rows[1].view(np.uint64), bits, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def whole_prefixes(rows):
            """Parts of whole prefixes, of about CHUNK_VARIANTS at most."""
            first = np.flatnonzero(np.diff(rows[0], prepend=~rows[0][:1]))
            before = np.concatenate(([0], np.cumsum(variants(rows))))
            at, end = 0, rows.shape[1]
            ends = np.append(first[1:], end)
            while at < end:
                fit = ends[(ends > at) & (before[ends] - before[at] <= CHUNK_VARIANTS)]
                to = int(fit[-1] if len(fit) else ends[ends > at][0])
                yield done(rows[:, at:to])
                at = to

        def run(batches):
            kept: list[np.ndarray] = []
            size = 0
            for batch in batches:                                   # sorted by prefix
                if not batch.num_rows:
                    continue
                kept.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
                size += int(variants(kept[-1]).sum())
                if size >= CHUNK_VARIANTS:
                    rows = np.concatenate(kept, axis=1)
                    whole = int(np.searchsorted(rows[0], rows[0][-1]))     # the last prefix may go on
                    if whole:
                        yield from whole_prefixes(rows[:, :whole])
                    kept = [rows[:, whole:]]
                    size = int(variants(kept[0]).sum())
            if kept:
                yield from whole_prefixes(np.concatenate(kept, axis=1))

        return rows.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "a long, b long")

    # a task emits len(around) rows of about 24 bytes for each it reads
    tasks = max(12, math.ceil(n * len(around) * 24 / TASK_BYTES))
    dealt = fps.select("fp").repartition(tasks)
    found = collided(dealt.mapInArrow(lambda b: emit(b, False), "prefix long, fp long"), prefix_bits)
    rows = dealt.mapInArrow(lambda b: emit(b, True), "prefix long, fp long") if len(hot) else None
    bits = prefix_bits
    while len(hot):
        step = min(EXTEND_BITS, 64 - bits)
        rows = cut(rows.mapInArrow(longer(bits, step), "prefix long, fp long"))
        bits += step
        hot = np.zeros(0, np.uint64)
        if bits < 64:                       # at 64 bits a prefix is one variant
            volumes = F.array(*[F.lit(v) for v in _volumes(64 - bits, half)])
            flipped = F.bit_count(F.col("prefix").bitwiseXOR(F.shiftrightunsigned("fp", 64 - bits)))
            hot = _prefixes(rows.select("prefix", F.element_at(volumes, (half + 1 - flipped).cast("int")).alias("n")), most)
        if not len(hot):
            found = found.unionByName(collided(rows, bits))
            break
        names = F.broadcast(fps.sparkSession.createDataFrame([(x,) for x in hot.view(np.int64).tolist()], "prefix long"))
        found = found.unionByName(collided(rows.join(names, "prefix", "left_anti"), bits))
        rows = rows.join(names, "prefix", "left_semi")
    return found.distinct()


def classes(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``rows`` (fp); root names the
    component."""
    fps = cut(rows.select("fp").distinct())
    labels = components(links(fps, radius))
    return cut(fps.join(labels, fps["fp"] == labels["node"], "left")
               .select("fp", F.coalesce("root", "fp").alias("root")))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
         radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (the
    smallest doc_id of its component)."""
    ship_package(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
               .select("doc_id", fingerprint(F.col("t"), width).alias("fp")))
    of = classes(rows, radius)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(of, "fp")
    least = cut(least)
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = cut(lookup(least, "root", ids, "inner").select("fp", "component_id"))
    return lookup(rows, "fp", ids, "inner").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
             radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id
    (a null id last). Fingerprints are computed once; whole documents are then
    found by hashes of their texts. Those alone in their component pass straight
    through; for the others a partial aggregate keeps one per component and task."""
    ship_package(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    whole = F.coalesce(text, F.lit(""))
    names = [F.xxhash64(whole).alias("k"), F.sha2(whole, 256).alias("sha")]
    slim = cut(docs.select(*names, fingerprint(text, width).alias("fp")))
    sizes = slim.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    of = cut(classes(slim, radius).join(sizes, "fp"))
    shared = of.groupBy("root").agg(F.sum("n").alias("n")).where("n > 1").select("root")
    many = cut(lookup(of.select("fp", "root"), "root", shared, "inner").select("fp", "root"))
    texts = cut(lookup(slim, "fp", many, "inner").select("k", "sha", "root").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").alias("id"), row_hash(docs).alias("tie"), *names)
    rows = flag_in(rows, "k", texts)
    found = rows.where("__maybe").join(texts.select("sha", "root"), "sha", "left")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("tie"))
    one = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min_by("row", order).alias("row"))
    alone = rows.where(~F.col("__maybe")).select("row.*").unionByName(found.where(F.col("root").isNull()).select("row.*"))
    return alone.unionByName(one.select("row.*"))
