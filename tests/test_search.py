"""Search over a small catalogue: analyzer, typo and prefix cases of the
reference's manual suite (headphon, bluetoot, hedphones, wireles, blue)."""

import datetime as dt
from decimal import Decimal

import random

import pytest
from pyspark.sql import functions as F

from vitrine.functions import text as TX
from vitrine.operators import cells
from vitrine.operators import index as IX
from vitrine.operators import search as SE
from vitrine.plans import queries_search as Q
from vitrine.session import scratch_path

CATALOGUE = [
    (1, "Wireless Bluetooth Headphones", "Noise cancelling over-ear headphones", ["Electronics", "Audio"], "199.99"),
    (2, "Smartphone X", "A fast mobile phone", ["Electronics"], "899.00"),
    (3, "Laptop Pro 15", "Portable computer for work", ["Electronics", "Computers"], "1599.99"),
    (4, "Blue Running Shoes", "Light shoes for the road", ["Sports"], "89.90"),
    (5, "Garden Hose", "Twenty metres, blue", ["Garden"], "29.99"),
]


def _docs(spark, extra=()):
    rows = [(i, n, d, c, Decimal(p), f"SKU-{i:03d}", f"{n} {d}", float(i), dt.datetime(2024, 1, i))
            for i, n, d, c, p in CATALOGUE + list(extra)]
    return spark.createDataFrame(rows, "product_id long, name string, description string, "
                                       "categories array<string>, price decimal(10,2), sku string, "
                                       "all_text string, popularity_score double, created_at timestamp_ntz")


@pytest.fixture(scope="module")
def ix(spark):
    return SE.product_index(_docs(spark))


def _queries(spark, qs, cats=None, lo=None, hi=None):
    return spark.createDataFrame(
        [(i, q, cats, lo, hi, 0, 10, "relevance", "desc") for i, q in enumerate(qs)],
        "query_id long, q string, categories array<string>, min_price decimal(10,2), "
        "max_price decimal(10,2), page int, size int, sort_by string, sort_direction string")


def _hits(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, set()).add(r.doc_id)
    return out


def test_analyzer(spark):
    df = spark.createDataFrame([("The Wireless ÉARBUDS and a Mobile-phone",)], "t string")
    assert df.select(TX.analyze_query(F.col("t"))).first()[0] == ["wireless", "earbuds", "mobile", "phone"]
    group = ["phone", "mobile", "smartphone", "cell"]
    assert df.select(TX.analyze(F.col("t"))).first()[0] == ["wireless", "headphones", "earphones", "earbuds",
                                                            *group, *group]
    pos = df.select(TX.analyze_positions(F.col("t"))).first()[0]
    assert [p.pos for p in pos] == [1, 2, 2, 2, 5, 5, 5, 5, 6, 6, 6, 6]


def test_fuzzy_main_search(spark, ix):
    hits = _hits(SE.search(ix, _queries(spark, ["hedphones", "wireles headphones", "blue", "laptp"])))
    assert hits[0] == {1}
    assert hits[1] == {1}
    assert hits[2] == {4, 5}
    assert hits[3] == {3}


def test_filters_apply(spark, ix):
    q = _queries(spark, ["blue"], cats=["Garden"])
    assert _hits(SE.search(ix, q)) == {0: {5}}
    q = _queries(spark, ["blue"], lo=Decimal("50"), hi=Decimal("100"))
    assert _hits(SE.search(ix, q)) == {0: {4}}


def test_synonyms_match(spark, ix):
    hits = _hits(SE.multi_field_search(ix, _queries(spark, ["earbuds", "notebook"])))
    assert 1 in hits[0] and 3 in hits[1]


def test_synonyms_keep_their_spelling(spark):
    """Parts and misspellings of any word of a group find the others' products."""
    D = _docs(spark, [(6, "Notebook Stand", "Aluminium", ["Office"], "39.00")])
    ix = SE.product_index(D)
    hits = _hits(SE.autocomplete(ix, _queries(spark, ["smartp", "noteb", "mobile", "computer st"])))
    assert hits == {0: {2}, 1: {3, 6}, 2: {2}, 3: {6}}
    q = _queries(spark, ["notebok", "notebook", "mobil"])
    for search in (SE.name_fuzzy, SE.name_simple_fuzzy):
        assert _hits(search(ix, q)) == {0: {3, 6}, 1: {3, 6}, 2: {2}}


def test_phrase_score_follows_the_terms(spark):
    """A phrase of rarer words scores higher than one of common words."""
    D = _docs(spark, [(i, "Plain Cable", "", ["Audio"], "9.00") for i in range(6, 12)]
              + [(12, "Rare Cable", "", ["Audio"], "9.00")])
    ix = SE.product_index(D)
    best = {r.query_id: r.score for r in SE.autocomplete(ix, _queries(spark, ["plain cab", "rare cab"])).collect()}
    assert best[1] > best[0]


def test_autocomplete_prefixes(spark, ix):
    hits = _hits(SE.autocomplete(ix, _queries(spark, ["headphon", "wireless bluetoot", "blue r", "bluetooth wire"])))
    assert hits[0] == {1} and hits[1] == {1} and hits[2] == {4}
    assert 3 not in hits            # words out of order are no phrase


def test_more_like_this_excludes_seed(spark):
    D = _docs(spark, [(6, "Wireless Earbuds", "Noise cancelling in-ear buds", ["Electronics", "Audio"], "99.00")])
    ix = SE.product_index(D)
    seeds = spark.createDataFrame([(1,)], "id long")
    got = _hits(SE.more_like_this(ix, seeds, 5).withColumnRenamed("seed_id", "query_id"))
    assert got[1] == {6}            # shares >= 30% of the seed's terms; the seed itself is excluded


def test_dispatch_and_pages(spark, ix):
    q = spark.createDataFrame([
        (1, "", ["Electronics"], None, None, 0, 2, "price", "asc"),     # browse, price ignored
        (2, " ", None, Decimal("50"), Decimal("300"), 0, 10, "name", "asc"),   # range
        (3, "blue", None, None, None, 1, 1, "price", "desc"),            # text, second page
    ], "query_id long, q string, categories array<string>, min_price decimal(10,2), "
       "max_price decimal(10,2), page int, size int, sort_by string, sort_direction string")
    got = {(r.query_id, r.rank): r.doc_id for r in SE.search_products(ix, q).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 1): 4, (2, 2): 1, (3, 2): 5}


def test_relevance_ranks_by_score_and_boosts_act(spark, ix):
    q = _queries(spark, ["blue"]).union(_queries(spark, ["electronics"]).withColumn("query_id", F.lit(1).cast("long")))
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in SE.search_products(ix, q, relevance=True).collect()}
    assert got[0, 1][0] == 4 and got[0, 2][0] == 5       # in the name (boost 4) before in the description
    assert got[0, 1][1] > got[0, 2][1] > 0
    by_field = {r.rank: r.doc_id for r in SE.search_products(ix, _queries(spark, ["blue"])).collect()}
    assert by_field == {1: 5, 2: 4}                      # unknown sort: popularity


def test_relational_path(spark, ix):
    q = spark.createDataFrame([
        (1, "WIRELESS", None, None, None, 0, 10, "price", "asc"), (2, "o", ["Electronics"], None, Decimal("1000"), 0, 10, "price", "asc"),
        (3, "", ["Audio", "Garden"], Decimal("100"), None, 0, 10, "name", "asc"), (4, "", None, None, None, 1, 2, "price", "asc"),
        (5, "oo", None, None, None, 0, 10, "name", "asc"), (6, "100%", None, None, None, 0, 10, "name", "asc"),
    ], "query_id long, q string, categories array<string>, min_price decimal(10,2), max_price decimal(10,2), page int, size int, "
       "sort_by string, sort_direction string")
    got = {(r.query_id, r.rank): r.doc_id for r in SE.search_with_fallback("relational", ix, q).collect()}
    assert got == {(1, 1): 1, (2, 1): 1, (2, 2): 2, (3, 1): 1, (4, 3): 1, (4, 4): 2, (5, 1): 1}


def test_pages_cut_early_and_whole_are_the_same(spark, ix):
    q = spark.createDataFrame([(i, "", None, None, None, i % 3, 1 + i % 2, "price", "asc") for i in range(6)],
                              "query_id long, q string, categories array<string>, min_price decimal(10,2), max_price decimal(10,2), "
                              "page int, size int, sort_by string, sort_direction string")
    rows = [sorted((r.query_id, r.rank, r.doc_id) for r in SE.search_products(ix, q, deepest=d).collect()) for d in (None, 3, 100)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 5


WORDS = ["red", "blue", "green", "steel", "brass", "lamp", "table", "chair", "hook", "plate", "zinc", "rope"]


@pytest.fixture(scope="module")
def many(spark):
    """400 products of few words, every one of them with the word common; small blocks and parts."""
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choices(WORDS, weights=range(1, 13), k=rnd.randrange(1, 6))), "common " * rnd.randrange(1, 4), ["c"],
             Decimal(i), f"S{i}", "common", 1.0, dt.datetime(2024, 1, 1)) for i in range(400)]
    D = spark.createDataFrame(rows, "product_id long, name string, description string, categories array<string>, price decimal(10,2), "
                                    "sku string, all_text string, popularity_score double, created_at timestamp_ntz")
    old = IX.BLOCK, IX.PART_DOCS
    IX.BLOCK, IX.PART_DOCS = 8, 50
    yield SE.product_index(D)
    IX.BLOCK, IX.PART_DOCS = old


def test_heavy_terms_are_dealt_over_parts(many):
    parts = (many.blocks.where("term = 'common' and field = 'description'").groupBy("part")
             .agg(F.sum(F.size("postings")).alias("n"), F.max(F.size("postings")).alias("longest")).collect())
    assert len(parts) == 8 and sum(r.n for r in parts) == 400 and max(r.n for r in parts) < 80
    assert max(r.longest for r in parts) <= 8
    light = many.terms.where("parts = 1").join(many.blocks, ["field", "term"])
    assert light.agg(F.max("part")).first()[0] == 0
    in_order = many.blocks.select(F.forall(F.sequence(F.lit(1), F.size("postings") - 1), lambda i: F.when(
        F.size("postings") < 2, True).otherwise(F.get("postings", i - 1)["impact"] >= F.coalesce(F.get("postings", i)["impact"], F.lit(0)))),
        F.col("top") == F.col("postings")[0]["impact"])
    assert in_order.distinct().collect() == [(True, True)]


def test_skipping_blocks_loses_nothing(spark, many, monkeypatch):
    rnd = random.Random(8)
    qs = [" ".join(rnd.choices(WORDS + ["common", "sofa"], k=rnd.randrange(1, 5))) for _ in range(25)] + ["zinc", "red", "common rope"]
    q = _queries(spark, qs, lo=Decimal("100"), hi=Decimal("300"))
    for search in (lambda k: SE.multi_field_search(many, q, k), lambda k: SE.name_fuzzy(many, q, k),
                   lambda k: SE.search_in_price_range(many, q, k)):
        whole = SE.top_k(search(None), "query_id", 5)
        want = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in whole.collect())
        for few, share in ((0, 2.0), (0, 0.5), (1 << 17, 0.25)):
            monkeypatch.setattr(SE, "FEW_POSTINGS", few)
            monkeypatch.setattr(SE, "DECIDING_SHARE", share)
            assert sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in search(5).collect()) == want


def test_more_like_this_like_brute_force(spark, many):
    vectors = {r.doc_id: {(t.field, t.term): t.impact for t in r.terms if t.field in ("name", "description", "categories")}
               for r in many.vectors.collect()}
    seeds = spark.createDataFrame([(i,) for i in range(0, 400, 40)], "id long")
    want = set()
    for i in range(0, 400, 40):
        need = max(1, int(len(vectors[i]) * 0.3))
        found = [(round(sum(v[t] for t in vectors[i] if t in v), 6), -j) for j, v in vectors.items()
                 if j != i and len(vectors[i].keys() & v.keys()) >= need]
        want |= {(i, -j, s) for s, j in sorted(found, reverse=True)[:5]}
    got = SE.more_like_this(many, seeds, 5)
    assert {(r.seed_id, r.doc_id, round(r.score, 6)) for r in got.collect()} == want


def test_cells_add_up_every_posting(spark, many, monkeypatch):
    rnd = random.Random(8)
    q = _queries(spark, [" ".join(rnd.choices(WORDS + ["common", "sofa"], k=rnd.randrange(1, 5))) for _ in range(25)] + ["sofa"])
    seeds = spark.createDataFrame([(i,) for i in range(0, 400, 7)] + [(None,), (9999,)], "id long")

    def answers():
        found = SE.multi_field_search(many, q, 5), SE.more_like_this(many, seeds, 5).withColumnRenamed("seed_id", "query_id")
        return [sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in f.collect()) for f in found]

    want, calls, scores = answers(), [], cells.scores
    monkeypatch.setattr(SE, "FEW_POSTINGS", 0)
    monkeypatch.setattr(SE, "CELLS_SHARE", 0)
    monkeypatch.setattr(SE, "CELLS_POSTINGS", 1)
    monkeypatch.setattr(cells, "scores", lambda *a: calls.append(a) or scores(*a))
    for postings, terms in ((300, 100), (1 << 22, 1 << 23)):
        monkeypatch.setattr(cells, "DOC_POSTINGS", postings)
        monkeypatch.setattr(cells, "QUERY_TERMS", terms)
        assert answers() == want
    assert len(calls) == 4


def test_equal_scores_in_cells_go_by_document(spark, monkeypatch):
    D = spark.createDataFrame([(f"d{i:02d}", "zinc lamp") for i in range(40)] + [("e", None), ("f", "zinc")], "id string, text string")
    ix = IX.build_index(D, {"text": "text"})
    exp = SE.weighted_terms(ix, spark.createDataFrame([(1, "zinc lamp")], "query_id long, q string"), {"text": ("text", 1.0)})[1]
    monkeypatch.setattr(SE, "FEW_POSTINGS", 0)
    monkeypatch.setattr(SE, "CELLS_POSTINGS", 1)
    monkeypatch.setattr(cells, "DOC_POSTINGS", 10)
    got = SE.best(ix, exp, 3)
    assert sorted((r["rank"], r.doc_id) for r in got.collect()) == [(1, "d00"), (2, "d01"), (3, "d02")]


def test_documents_of_one_file_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    spark.createDataFrame([(i, f"word{i}") for i in range(50)], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    seen = []
    monkeypatch.setattr(IX, "stored", lambda spark, name, paths, build: build(f"{path}/ix"))
    monkeypatch.setattr(IX, "build_index", lambda docs, *a, **b: seen.append(docs.rdd.getNumPartitions()))
    monkeypatch.setattr(Q, "TASK_DOCUMENTS", 5)
    Q.corpus_ix(spark, path)
    assert seen == [11]


def test_prefixes_are_intervals_of_term_numbers(spark, many):
    p = spark.createDataFrame([(1, "r"), (2, "b"), (3, "common"), (4, "zzz")], "query_id long, qterm string")
    found = {(r.query_id, r.term) for r in SE.prefix_terms(many, p, "name").collect()}
    assert found == {(1, "red"), (1, "rope"), (2, "blue"), (2, "brass")}
    first = {(r.query_id, r.term) for r in SE.prefix_terms(many, p, "name", 1).collect()}
    assert first == {(1, "red"), (2, "blue")}


def test_price_ranges_meet_only_their_prices(spark):
    rnd = random.Random(9)
    prices = [Decimal(rnd.randrange(10 ** rnd.randrange(1, 9))) / 100 for _ in range(300)] + [None]
    docs = spark.createDataFrame(list(enumerate(prices)), "doc_id long, price decimal(10,2)")
    ends = [(Decimal(rnd.randrange(10**7)) / 100, Decimal(rnd.randrange(10**7)) / 100) for _ in range(30)]
    ranges = [(f"r{i}", min(e), max(e)) for i, e in enumerate(ends)] + [("open", Decimal(0), None), ("none", Decimal(9), Decimal(8)),
                                                                        ("one", prices[0], prices[0]), ("far", Decimal("99999999.99"), None)]
    got = SE.in_price_ranges(docs, spark.createDataFrame(ranges, "range_id string, low decimal(10,2), high decimal(10,2)"))
    want = {(r, i) for r, lo, hi in ranges for i, p in enumerate(prices) if p is not None and p >= lo and (hi is None or p <= hi)}
    rows = [(r.range_id, r.doc_id) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_stored_index_is_read_until_its_files_change(spark):
    path = scratch_path(spark, "source")
    spark.createDataFrame([(1, "one word")], "id long, t string").write.parquet(path)
    builds = []

    def build(where):
        builds.append(where)
        return IX.build_index(spark.read.parquet(path), {"t": "text"}, path=where)

    ready = lambda: {r.term for r in IX.stored(spark, "test", [path], build).terms.collect()}
    assert ready() == ready() == {"one", "word"} and len(builds) == 1
    for name in IX.KEYS:                                # a new session knows no table: only the files are left
        spark.sql(f"DROP TABLE {IX._table_name(builds[0], name)}")
    assert ready() == {"one", "word"} and len(builds) == 1
    spark.createDataFrame([(2, "two")], "id long, t string").write.mode("append").parquet(path)
    assert ready() == {"one", "word", "two"} and len(builds) == 2


def test_plans_hold_no_nested_loops_and_no_python(spark):
    sf = "/root/testdata/sf0.001"
    for query in (Q.q_search_products, Q.q_search_relational, Q.q_name_fuzzy, Q.q_autocomplete, Q.q_fuzzy_expansions):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        for bad in ("NestedLoop", "Cartesian", "ArrowEvalPython", "BatchEvalPython"):
            assert bad not in plan, (query.__name__, bad)


def _broadcast_sides(df):
    """The parts of the plan that go through the driver."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            out.append("\n".join(lines[i:below]))
    return out


def test_exploded_documents_are_never_broadcast(spark):
    docs = spark.createDataFrame([(i, f"large ring {i}", Decimal(i)) for i in range(40)], "doc_id long, name string, price decimal(10,2)")
    asked = spark.createDataFrame([("ring 7",), ("none",)], "q string")
    found = SE.containing(docs, asked, ["name"])
    assert _broadcast_sides(found) and not any("doc_id" in x for x in _broadcast_sides(found))
    assert {r.doc_id for r in found.collect()} == {7}
    ranges = spark.createDataFrame([(str(i), Decimal(i), Decimal(i + 2)) for i in range(30)],
                                   "range_id string, low decimal(10,2), high decimal(10,2)")
    met = SE.in_price_ranges(docs, ranges)
    assert _broadcast_sides(met) and not any("doc_id" in x for x in _broadcast_sides(met))
    assert met.count() == 90


def test_all_terms_are_found_by_the_rarest(spark, monkeypatch):
    texts = [(1, "apple pear plum fig nut"), (2, "apple pear plum fig"), (3, "apple pear nut"), (4, "nut fig plum pear apple apple")]
    made = IX.build_index(spark.createDataFrame(texts, "id long, text string"), {"text": "text"})
    asked = [(1, "apple pear plum fig nut"), (2, "pear apple"), (3, "apple unheard"), (4, "nut"), (5, "nut"), (5, "nut")]
    queries = spark.createDataFrame(asked, "query_id long, q string")
    either = {(r.query_id, r.doc_id): r.score for r in SE.score_fields(made, queries, {"text": ("text", 1.0)}).collect()}
    monkeypatch.setattr(SE, "_lanes", None)                 # the postings of all terms are not joined
    got = {(r.query_id, r.doc_id): r.score for r in SE.score_fields(made, queries, {"text": ("text", 1.0)}, operator="and").collect()}
    assert set(got) == {(1, 1), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (4, 1), (4, 3), (4, 4), (5, 1), (5, 3), (5, 4)}
    assert all(abs(s - either[k]) < 1e-9 for k, s in got.items())


def test_rescored_vectors_shuffle_only_pairs(spark, ix):
    exp = spark.createDataFrame([(1, "name", "name", "wireless", "wireless", 1.0)],
                                "query_id long, lane string, field string, qterm string, term string, w double")
    found = SE.rescore(ix, exp, spark.createDataFrame([(1, 1), (1, 2)], "query_id long, doc_id long"))
    sides = _broadcast_sides(found)
    assert any("lane" in x and "doc_id" not in x for x in sides)
    assert _hits(found) == {1: {1}}


def test_requests_are_numbered_and_phrases_counted_without_lists(spark, ix):
    seen = []

    def run(combos):
        seen.append(dict(combos.dtypes)["query_id"])
        return SE.autocomplete(ix, combos)

    asked = spark.createDataFrame([("a", "wireless blue"), ("b", "wireless blue"), ("c", "garden")], "query_id string, q string")
    found = SE.per_distinct(asked, ["q"], run)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert seen == ["bigint"] and _hits(found) == {"a": {1}, "b": {1}, "c": {5}}


def test_postings_are_dealt_over_tasks_before_they_are_unpacked(spark, monkeypatch):
    """a file of blocks holds more postings than one task should unpack; the blocks asked for are dealt by number."""
    from tests.conftest import SF001
    from vitrine.plans import queries_search as QS
    ix = QS.product_ix(spark, SF001)
    queries = spark.createDataFrame([(1, "ring"), (2, "large ring")], "query_id long, q string")
    answers = lambda: sorted(map(tuple, SE.multi_field_search(ix, queries, 5).select("query_id", "doc_id", "rank").collect()))
    plain = answers()
    monkeypatch.setattr(SE, "TASK_POSTINGS", 10)
    exp = SE.weighted_terms(ix, queries, SE.MULTI_FIELDS)[1]
    n = SE._tasks(exp)
    assert n > spark.sparkContext.defaultParallelism
    plan = SE._with_blocks(ix, exp)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and f", {n}" in plan
    assert answers() == plain and plain


def test_whole_answers_meet_lists_of_requests(spark, monkeypatch):
    """a request is not joined with each of its answers, a list of equal requests is."""
    monkeypatch.setattr(SE, "LIST_REQUESTS", 4)
    monkeypatch.setattr(SE, "PART_REQUESTS", 16)
    texts = ["wireless blue"] * 90 + ["garden"] * 7 + ["laptop", None, "nothing"]
    asked = spark.createDataFrame([(None if i % 13 == 0 else i // 2, q) for i, q in enumerate(texts)], "query_id long, q string")
    answers = spark.createDataFrame([("wireless blue", d % 50 or None) for d in range(300)] + [("garden", 5), ("garden", 5), (None, 1)], "q string, doc_id long")

    def run(combos):
        return combos.join(answers, combos["q"].eqNullSafe(answers["q"])).select("query_id", "doc_id")

    found = SE.per_distinct(asked, ["q"], run, whole=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(i for i, x in enumerate(plan.splitlines()) if "Join" in x)
    assert "explode(_ids" in "\n".join(plan.splitlines()[:join])
    plain = SE.per_distinct(asked, ["q"], run)
    rows = lambda df: sorted((str(r.query_id), str(r.doc_id)) for r in df.collect())
    assert rows(found) == rows(plain) and len(rows(found)) == 90 * 300 + 7 * 2 + 1
    assert found.columns == ["query_id", "doc_id"] and SE.per_distinct(asked.limit(0), ["q"], run, whole=True).count() == 0


def test_cells_are_gone_through_in_rounds(spark, many, monkeypatch):
    """the disk holds the copies of a round; the terms of the seeds are not stored."""
    seeds = spark.createDataFrame([(i,) for i in range(0, 400, 29)], "id long")
    answers = lambda: sorted((r.seed_id, r.rank, r.doc_id, round(r.score, 6)) for r in SE.more_like_this(many, seeds, 5).collect())
    want = answers()
    monkeypatch.setattr(SE, "CELLS_SHARE", 0)
    monkeypatch.setattr(SE, "CELLS_POSTINGS", 1)
    monkeypatch.setattr(SE, "_cut", lambda df: pytest.fail("the terms of the seeds are stored"))
    for blocks in ((3, 2), (1, 2)):
        monkeypatch.setattr(cells, "_blocks", lambda *a, b=blocks: b)
        assert answers() == want


def test_a_round_copies_queries_but_not_documents():
    for n_terms, n_postings, cores in ((3_000_000, 8_000_000, 8), (30_000_000, 80_000_000, 6), (100, 8_000_000, 8), (0, 0, 4)):
        q, d = cells._blocks(n_terms, n_postings, cores)
        assert d >= cells.CELLS_A_CORE * cores and q * cells.QUERY_TERMS >= n_terms and d * cells.DOC_POSTINGS >= n_postings
        assert n_terms // q * d <= cells.QUERY_TERMS * max(cells.CELLS_A_CORE * cores, n_postings // cells.DOC_POSTINGS + 1)


def test_words_counted_in_tasks_are_the_analyzers(spark, monkeypatch):
    """the postings of texts without positions are counted where the texts are; odd letters, repeated and null ids included."""
    monkeypatch.setattr(TX, "MEMO_WORDS", 5)
    texts = ["The Straße of ŁÓDŹ, strasse ÆON aeon İstanbul ΣΑΣ ﬁne x²y٣ áb", "mobile PHONE cell-phone tv's television the", None, "", " the of \n",
             "one two two\tthree_four 4four 𝒳𝒴 日本語 naïve e​f ı ŉ ſ ß", "phone phone", "same again", "null id", "other null"]
    ids = [1, 2, 3, 4, 5, 6, 2, 1, None, None]
    docs = spark.createDataFrame([(i, t, (t or "")[::-1]) for i, t in zip(ids, texts)], "id long, text string, more string")
    for D in (docs, docs.where("id > 2"), docs.limit(0)):
        for fields in ({"text": "text"}, {"text": "text", "more": "text"}):
            want = IX._tokens(D, fields, "id", False).select("field", "term", "doc_id", "tf", "dl")
            ix = IX.build_index(D, fields)
            got = ix.blocks.select("field", "term", F.explode("postings").alias("p")).select("field", "term", "p.doc_id", "p.tf", "p.dl")
            rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
            assert rows(got) == rows(want.where("term is not null"))
            sizes = want.where("term is null").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("a"))
            assert rows(ix.fields.select("field", "n_docs", "avgdl")) == rows(sizes)
    assert "Exchange" not in IX._word_counts(docs, "id", ["text"])._jdf.queryExecution().executedPlan().toString()
