import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitrine.llm import exact_dedup, quality_rules, shared
from vitrine.llm.queries import EXACT_SQL, QUALITY_SQL

SF = "/root/testdata/sf0.001"
LINE = "some plain words here and there with more of them to read "
ODD = [(1, None, "a"), (2, "", "b"), (None, "x", "c"), (3, "x", "d"), (3, "x", None), (None, None, "e"), (4, "x\n" * 60, "f"),
       (5, " \t\n\x0b\f\r ", "g"), (6, LINE * 3000, "h"), (7, "THE BIG " * 40, "i"), (8, "\n".join([LINE * 2] * 6), "j"),
       (9, "a b c d " * 2 + " ".join(f"word{i}" for i in range(80)), "k"), (10, "x", "l"), (11, "one two", "m"),
       (12, " ".join(f"w{i}##" for i in range(70)), "n"), (13, "é b\x85c d e é b\x85c d", "o"), (2, "", "p")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, keep_id string").repartition(3)


def rows_of(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def oracle(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(str(r[k]) for k in order) for r in res.fetchall())


def test_quality_like_sql(odd):
    rows = [(i, t) for i, t, _ in ODD if i not in (2, 3, None)]
    got = quality_rules.judge(odd.where("doc_id is not null and doc_id not in (2, 3)"))
    assert rows_of(got) == oracle(QUALITY_SQL, rows)
    assert got.count() == len(rows) and quality_rules.judge(odd.limit(0)).count() == 0


def test_quality_keeps_what_it_judges_good(odd, spark):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        kept = quality_rules.keep_good(docs)
        assert kept.columns == docs.columns
        want = quality_rules.judge(docs).where("kept").select("doc_id")
        assert rows_of(kept.select("doc_id")) == rows_of(want)
    assert quality_rules.keep_good(odd.limit(0)).count() == 0


def test_rules_run_by_rejections_per_cost(odd):
    found = quality_rules.ranked(odd, [quality_rules.Rule("never", odd.doc_id < 0), quality_rules.Rule("all", odd.doc_id > 0)])
    assert [x[0] for x in found] == ["all", "never"] and found[1][2] == 0


def test_exact_like_sql(odd):
    unique = [(i, t) for i, t, _ in ODD if i is not None and (i, t) != (3, "x")] + [(3, "x")]
    df = odd.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    assert rows_of(exact_dedup.mark_repeats(df)) == oracle(EXACT_SQL, list(dict.fromkeys(unique)))


def test_exact_with_ties(odd):
    rows = exact_dedup.mark_repeats(odd).collect()
    assert len(rows) == len(ODD)
    groups = {}
    for r in rows:
        groups.setdefault(r.text_sha256, []).append(r)
    assert len(groups) == len({t or "" for _, t, _ in ODD})
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert {r.group_size for r in g} == {len(g)} and {r.keep_id for r in g} == {max(ids, default=None)}
        assert sum(r.kept for r in g) == 1
    kept = exact_dedup.drop_repeats(odd)
    assert kept.columns == odd.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t, _ in ODD})
    assert exact_dedup.mark_repeats(odd.limit(0)).count() == 0 and exact_dedup.drop_repeats(odd.limit(0)).count() == 0


def test_lookup_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    rows = shared.cut(spark.range(100).selectExpr("id", "case when id < 60 then 1 when id = 99 then null else id end k"))
    small = spark.range(80).selectExpr("id k", "id * 2 v")
    for how in ("left", "inner"):
        assert rows_of(shared.lookup(rows, "k", small, how)) == rows_of(rows.join(small, "k", how))
    wanted = spark.range(0, 50, 7).selectExpr("id k")
    assert {r.k for r in shared.maybe_in(rows.where("k is not null"), "k", wanted).collect()} >= {42, 49} - {42, 49} | {
        r.k for r in rows.join(wanted, "k", "left_semi").collect()}


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        path = str(tmp_path / name)
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= n
        n = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    # a brute-force version of what the stages keep
    from tests.llm.test_simhash import brute_components, brute_fingerprint
    judged = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_text = {}
    for r in judged:
        by_text[texts[r.doc_id]] = max(by_text.get(texts[r.doc_id], -1), r.doc_id)
    ids = sorted(by_text.values())
    keep = set(brute_components(ids, [brute_fingerprint(texts[i]) for i in ids], 4))
    assert {r.doc_id for r in docs.collect()} == keep


def test_rows_with_maps_pass_both_dedups(spark):
    from vitrine.llm import simhash
    rows = [(1, "same text here", {"a": 1}), (1, "same text here", {"b": 2}), (2, "another", None), (3, "same text here", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")
    for kept in (exact_dedup.drop_repeats(docs), simhash.keep_one(docs, width=4, radius=4)):
        assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["another", "same text here"]


def test_filters_are_broadcast_in_blocks_of_words(spark):
    wanted = spark.range(0, 60_000, 3).selectExpr("id k")
    rows = spark.range(60_000).selectExpr("case when id = 7 then null else id end k")
    words = wanted.count() // 4 + 1
    blocks = shared.filter_blocks(wanted, F.pmod(F.xxhash64("k"), F.lit(words * 64)), words).collect()
    assert len(blocks) == -(-words // 1024) and sum(len(b["__masks"]) for b in blocks) == words
    slots = {r.s for r in wanted.select(F.pmod(F.xxhash64("k"), F.lit(words * 64)).alias("s")).collect()}
    assert {(b["__block"] * 1024 + i) * 64 + k for b in blocks for i, m in enumerate(b["__masks"]) for k in range(64) if m >> k & 1} == slots
    flagged = shared.flag_in(rows, "k", wanted)
    expected = rows.withColumn("s", F.pmod(F.xxhash64("k"), F.lit(words * 64))).collect()
    assert sorted(((r.k is None, r.k or 0), r["__maybe"]) for r in flagged.collect()) == sorted(
        ((r.k is None, r.k or 0), r.s in slots) for r in expected)
