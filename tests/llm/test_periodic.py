import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm import periodic
from vitrine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute_runs(s):
    """All runs by their definition: each period by itself, smallest first."""
    n, found = len(s), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(a == i and b == j + q - i for a, b in found):
                found[i, j + q - i] = q
            i = j
    return sorted((a, b, q) for (a, b), q in found.items())


def brute(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    kept = [w for i, w in enumerate(words) if not any(a + q <= i < a + m for a, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(kept)))


def of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_lyndon_lengths_end_at_the_next_smaller_suffix():
    rng = random.Random(3)
    for _ in range(3000):
        s = [rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.randrange(1, 25))]
        want = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]
        assert periodic.lyndon_lengths(s) == want, s
    assert periodic.lyndon_lengths([]) == []


def near_periodic(rng):
    s = []
    while rng.random() < 0.85:
        unit = [rng.randrange(rng.choice((2, 3, 40))) for _ in range(rng.randrange(1, 9))]
        s += (unit * rng.randrange(1, 8))[:rng.randrange(1, 60)]
    return s


def test_runs_like_brute_force():
    rng = random.Random(5)
    some = 0
    for _ in range(400):
        texts = [near_periodic(rng) for _ in range(8)]
        got = periodic.texts_runs([np.array(t, np.int64) for t in texts])
        want = [sorted(brute_runs(t), key=lambda r: (r[0], r[2])) for t in texts]
        assert got == want
        some += sum(map(len, want))
    assert some > 1000


def test_no_window_filter_gives_the_same_runs():
    rng = random.Random(6)
    for _ in range(300):
        s = np.array(near_periodic(rng) or [1], np.int64)
        assert sorted(periodic.runs_between(s, 0, len(s))) == brute_runs(s.tolist())


def test_texts_of_many_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE_WORDS", 10)
    texts = [np.array([1, 2] * n, np.int64) for n in (0, 1, 4, 20, 3)]
    assert periodic.texts_runs(texts) == [[], [], [(0, 8, 2)], [(0, 40, 2)], []]


ODD = ([(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "a " * 5), (5, "a " * 6), (6, "x y " * 4 + "z"), (None, "a b " * 9), (7, "é é " * 7),
        (8, "same\nline here\n" * 30), (8, "same\nline here\n" * 30), (9, " ".join(f"w{i % 100}" for i in range(2_000))),
        (10, "a b a b a b a b b a b b a b b a b b a a a a a a")] + [(100 + i, " ".join(f"v{k * k % 37}" for k in range(i * 3))) for i in range(60)])


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"runs": F.lit("x"), "a.b": F.lit(1)})
    got = of(periodic.digest(periodic.find(df.repartition(3))))
    assert got == sorted((brute(i, t, plant=False) for i, t in ODD), key=str)
    assert periodic.digest(periodic.find(df.limit(0))).count() == 0


def test_planted_repetitions(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = of(periodic.digest(periodic.find(df.select("doc_id", periodic.planted(F.col("text"), seed).alias("text")))))
    assert got == sorted((brute(i, t) for i, t in ODD), key=str)


def test_query_like_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where(F.length("text") < 6000).collect()
    want = {r[0]: brute(*r) for r in rows}
    got = {r[0]: r for r in of(QUERIES["op13_periodic_runs"](spark, SF))}
    assert len(got) == 200 and {i: got[i] for i in want} == want and sum(r[1] > 0 for r in want.values()) > 5


def test_a_long_text_in_linear_time():
    words = np.arange(400_000) % 50_000
    words[200_000:] = np.arange(200_000) % 7
    assert periodic.texts_runs([words]) == [[(0, 200_007, 50_000), (200_000, 200_000, 7)]]
