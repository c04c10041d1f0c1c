"""Fuzzy matching: the distance and the completeness of the deletion
neighbourhood candidates (every pair within k edits shares a variant)."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.functions.fuzzy import MAX_EDITS, edit_distance


def damerau_levenshtein(a, b):
    """The unrestricted distance by its full table."""
    la, lb = len(a), len(b)
    inf = la + lb
    h = [[0] * (lb + 2) for _ in range(la + 2)]
    h[0][0] = inf
    for i in range(la + 1):
        h[i + 1][0], h[i + 1][1] = inf, i
    for j in range(lb + 1):
        h[0][j + 1], h[1][j + 1] = inf, j
    last = {}
    for i in range(1, la + 1):
        db = 0
        for j in range(1, lb + 1):
            i1, j1 = last.get(b[j - 1], 0), db
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            h[i + 1][j + 1] = min(h[i][j] + cost, h[i + 1][j] + 1, h[i][j + 1] + 1,
                                  h[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return h[la + 1][lb + 1]


def _variants(s, k):
    out = {(s, 0)}
    frontier = {s}
    for d in range(1, k + 1):
        nxt = set()
        for x in frontier:
            for i in range(len(x)):
                nxt.add(x[:i] + x[i + 1:])
        out |= {(x, d) for x in nxt}
        frontier = nxt
    return {v for v, _ in out}


def test_known_distances():
    assert damerau_levenshtein("abcd", "abdc") == 1
    assert damerau_levenshtein("ca", "abc") == 2
    assert damerau_levenshtein("hedphones", "headphones") == 1
    assert damerau_levenshtein("wireles", "wireless") == 1
    assert damerau_levenshtein("", "ab") == 2


def _edit(s, rnd):
    ops = rnd.choice(["ins", "del", "sub", "swap"])
    i = rnd.randrange(len(s) + 1)
    c = rnd.choice("abcde")
    if ops == "ins":
        return s[:i] + c + s[i:]
    if not s:
        return s
    i = min(i, len(s) - 1)
    if ops == "del":
        return s[:i] + s[i + 1:]
    if ops == "sub":
        return s[:i] + c + s[i + 1:]
    if i + 1 < len(s):
        return s[:i] + s[i + 1] + s[i] + s[i + 2:]
    return s


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcde", min_size=0, max_size=9), st.integers(0, 10_000))
def test_deletion_neighbourhoods_find_every_pair_within_two(s, seed):
    rnd = random.Random(seed)
    t = s
    for _ in range(rnd.randrange(1, 3)):
        t = _edit(t, rnd)
    k = damerau_levenshtein(s, t)
    if k <= 2:
        assert _variants(s, k) & _variants(t, k), (s, t, k)


def test_distance_column_equals_the_full_table(spark):
    rnd = random.Random(4)
    pairs = [("ca", "abc"), ("abc", "ca"), ("", ""), ("", "ab"), ("abcdef", ""), ("é", "e"), ("aé\U0001f600b", "a\U0001f600éb")]
    for _ in range(6000):
        s = "".join(rnd.choices("abcd", k=rnd.randrange(0, 9)))
        t = s
        for _ in range(rnd.randrange(0, 4)):
            t = _edit(t, rnd)
        pairs.append((s, t))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(edit_distance("a", "b")).collect()]
    assert got == [min(damerau_levenshtein(a, b), MAX_EDITS + 1) for a, b in pairs]
