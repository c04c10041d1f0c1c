import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from vitrine.llm import divergence
from vitrine.llm.queries import DIVERGENCE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    """The contract in plain Python."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        n[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        sources = [s for x, s in groups if x == lang]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        v, all_n = len(kept), sum(whole.values())
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 2) // (total[s] + 2 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (all_n + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


ODD = ([("", None, None), (None, "en", "a"), ("12 3-4", "en", "empty"), ("alone", "xx", "one"), ("é", "", None)]
       + [(f"The the THE Straße co-op x{i} {'long' * 9} {'ü' * 8} {'abcdefgh' * 2} {'abcdefgh'}", "en", "ab"[i % 2]) for i in range(12)]
       + [(f"ÀB àb İx k's {'w' * (i % 70)} {'é' * (i % 40)} " * (i % 3), "en", ["a", "Z", "é"][i % 3]) for i in range(60)]
       + [("one long word " + "z" * 70_000 + " " + "z" * 17, "de", "s")] * 11)


def test_odd_rows_like_brute_force(spark):
    df = spark.createDataFrame(ODD, "text string, lang string, source string").repartition(4)
    want = brute(ODD)
    assert of(divergence.audit(df)) == want and len(want) > 40
    assert of(divergence.audit(df, min_docs=1, top=3)) == brute(ODD, 1, 3)
    assert divergence.audit(df.limit(0)).count() == 0
    assert of(divergence.audit(df.where("text = 'alone'"))) == []


def test_sources_in_blocks(spark, monkeypatch):
    rows = [(f"common word {'x' * (i % 5)} {'q' * (i % 11)}", "en", f"s{i % 13}") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    want = of(divergence.audit(df))
    assert want == brute(rows)
    monkeypatch.setattr(divergence, "BLOCK", 4)
    code = divergence._compare

    class Held:
        value = None
    # the blocks of the driver and of the tasks must agree, so the tasks' function runs here
    held = Held()
    terms = [(["s1", "s2", "s9"], [3, 4, 5]), (["s12"], [7])]
    names = sorted({s for _, _, s in rows})
    held.value = {"en": (names, np.full(len(names), 40, np.int64))}
    import pyarrow as pa
    tiles = [(i, j) for i in range(4) for j in range(i, 4)]
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "i": i, "j": j, "counts": [{"source": s, "n": n} for s, n in zip(*t)]}
                                        for i, j in tiles for t in terms])
    got = {(r["source"], r["item"]): r["value"] for b in code(held)([batch]) for r in b.to_pylist()}
    p = [{s: 1 + 10**9 * (dict(zip(*t)).get(s, 0) + 2) // 40 for s in names} for t in terms]
    assert got == {(a, b): sum((x[a] - x[b]) ** 2 // (x[a] + x[b]) for x in p) for a in names for b in names if a < b}


def test_packing_and_radix():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(2000)]
    data = b" ".join(words)
    first, length, doc = divergence.spans(np.frombuffer(data, np.uint8), np.array([len(data)]))
    assert [data[a:a + n] for a, n in zip(first, length)] == words and not doc.any()
    packed = divergence.words_at(data + bytes(24 - len(data) % 8), first, length)
    order = divergence.radix_order([packed])
    assert [words[i] for i in order] == sorted(words)
    big = np.array([0, 1, 10**13, 2 * 10**14 - 2])
    assert [int(x) for x in divergence.share(big, np.full(4, 2 * 10**14))] == [1 + 10**9 * (int(x) + 2) // (2 * 10**14) for x in big]


def test_terms_stop_at_the_end_of_a_text():
    data = np.frombuffer(b"abcd" + b"ef g" + b"h", np.uint8)
    first, length, doc = divergence.spans(data, np.array([0, 4, 4, 8, 9]))
    assert list(zip(first, length, doc)) == [(0, 4, 1), (4, 2, 3), (7, 1, 3), (8, 1, 4)]


@pytest.mark.parametrize("sf", [SF])
def test_query_like_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(DIVERGENCE_SQL).fetchall())
    assert of(QUERIES["op12_divergence"](spark, sf)) == want and len(want) > 500
