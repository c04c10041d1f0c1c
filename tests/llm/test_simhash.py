import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vitrine.llm import simhash
from vitrine.llm.shared import components


def brute_fingerprint(text, width=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    n, root = len(ids), list(range(len(ids)))
    for _ in range(n):
        old = list(root)
        for i in range(n):
            for j in range(n):
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    root[i] = min(root[i], root[j])
        if old == root:
            break
    known = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            known[r] = min(known.get(r, ids[i]), ids[i])
    return [known.get(r) for r in root]


def test_fingerprints_and_components(spark):
    r = random.Random(3)
    vocabulary = [f"W{i}é" for i in range(400)]
    texts = [None, "", " \n", "one", "One", "a b c", "a b c d", "x\x1cy z"]
    for _ in range(12):
        words = [r.choice(vocabulary) for _ in range(r.randrange(30, 600))]
        texts.append(" ".join(words))
        for _ in range(r.randrange(4)):
            words = list(words)
            words[r.randrange(len(words))] = "changed"
            texts.append("  ".join(words))
    rows = [(i * 7 % 101, t, "k") for i, t in enumerate(texts)] + [(None, texts[9], "n"), (5, texts[9], "n"),
                                                                  (None, "lone words here " * 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    want_fp = [brute_fingerprint(t) for _, t, _ in rows]
    want = sorted(zip([str(x[0]) for x in rows], [f"{f:016x}" for f in want_fp],
                      map(str, brute_components([x[0] for x in rows], want_fp, 4))))
    got = sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in simhash.link(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(c, f if c is None else 0) for c, f in
                                zip(brute_components([x[0] for x in rows], want_fp, 4), want_fp)})
    assert simhash.link(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_join_all_pairs(spark, radius):
    r = random.Random(radius)
    fps = set()
    for _ in range(20):
        c = r.getrandbits(64)
        fps |= {c} | {c ^ sum({1 << r.randrange(64) for _ in range(r.randrange(1, 6))}) for _ in range(12)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {x.node: x.root for x in components(simhash.links(df, radius)).collect()}
    ids = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = brute_components(ids, fps, radius)
    groups = {}
    for i, w in zip(ids, want):
        groups.setdefault(w, set()).add(got.get(i, i))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_hot_prefixes_are_split(spark):
    """One family under a few prefixes: they are extended, and links stay."""
    r = random.Random(6)
    center = r.getrandbits(64)
    fps = sorted({center ^ sum({1 << r.randrange(52) for _ in range(3)}) for _ in range(300)}
                 | {r.getrandbits(64) for _ in range(30)})
    ids = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(i,) for i in ids], "fp long")
    rows = simhash.links(df, 4, most=3000)
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") >= 4            # the short prefixes, and longer ones
    n = df.count()
    counts = df.groupBy(F.shiftrightunsigned("fp", 52).alias("own")).agg(F.count(F.lit(1)).alias("n"))
    assert n > 300 and len(simhash._hot(counts, 12, 2, 3000)) > 1
    found = [tuple(x) for x in rows.collect()]
    got = {x.node: x.root for x in components(spark.createDataFrame(found, "a long, b long")).collect()}
    groups = {}
    for i, w in zip(ids, brute_components(ids, fps, 4)):
        groups.setdefault(w, set()).add(got.get(i, i))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_long_chains(spark):
    r = random.Random(1)
    names = list(range(300))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(299) if i != 150] + [(1000, 1000), (7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    left, right = set(names[:151]), set(names[151:])
    assert {x.node: x.root for x in got} == {n: min(s) for s in (left, right) for n in s}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
