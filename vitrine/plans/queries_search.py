"""Registered full-text search queries (X1-X16, P24) over the product
documents and over the ``documents`` corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import text as TX
from vitrine.operators import index as IX
from vitrine.operators import search as SE
from vitrine.operators import sync as S
from vitrine.plans import views as V
from vitrine.plans.oracle_text import (index_ctes, score_ctes, sql_analyze, sql_analyze_query, sql_analyze_sku,
                                       sql_bm25, sql_idf, sql_positions, sql_raw_tokens, sql_synonyms, top_k_sql)
from vitrine.plans.registry import register

AUTOCOMPLETE_SQL = f"""
, npos AS (SELECT p_partkey AS doc_id, {sql_positions('p_name')} AS s FROM part),
np AS (SELECT doc_id, s.pos AS dpos, unnest({sql_synonyms('s.term')}) AS term FROM npos),
dict AS (SELECT term, count(DISTINCT doc_id) AS df FROM np GROUP BY term),
qpos AS (SELECT query_id, {sql_positions('q')} AS s FROM prefix_req_v),
qp0 AS (SELECT query_id, s.pos AS qpos, s.term AS qterm,
               row_number() OVER (PARTITION BY query_id ORDER BY s.pos) - 1 AS i FROM qpos),
lst AS (SELECT query_id, max(i) AS last_i, min(qpos) AS p0, count(*) AS n FROM qp0 GROUP BY query_id),
qp AS (SELECT qp0.*, lst.last_i, lst.n, qp0.qpos - lst.p0 AS rel FROM qp0 JOIN lst USING (query_id)),
ex AS (SELECT qp.query_id, qp.i, qp.rel, qp.n, dict.term, dict.df FROM qp JOIN dict ON dict.term = qp.qterm WHERE qp.i < qp.last_i),
pref AS (SELECT qp.query_id, qp.i, qp.rel, qp.n, dict.term, dict.df
         FROM qp JOIN dict ON starts_with(dict.term, qp.qterm) WHERE qp.i = qp.last_i),
terms AS (SELECT * FROM ex UNION ALL SELECT * FROM pref),
hits AS (SELECT t.query_id, np.doc_id, np.dpos - t.rel AS start, t.n, t.i FROM terms t JOIN np ON np.term = t.term),
phr AS (SELECT query_id, doc_id, start FROM hits GROUP BY query_id, doc_id, start, n HAVING count(DISTINCT i) = n),
matched AS (SELECT query_id, doc_id, count(*) AS freq FROM phr GROUP BY query_id, doc_id)"""
PIX = index_ctes("doc_v", "product_id", SE.PRODUCT_INDEX_FIELDS)
#: Products that one task analyses while the index is built.
TASK_PRODUCTS = 20_000
#: Documents of the corpus that one task analyses.
TASK_DOCUMENTS = 2_000
CIX = index_ctes("documents", "doc_id", {"text": "text"}, prefix="cx")


def product_docs(spark, sf):
    return S.full_sync(V.product(spark, sf), V.as_of())


def product_ix(spark, sf):
    """The stored index of the product documents."""
    paths = [f"{sf}/{t}.parquet" for t in ("part", "events", "lineitem")]

    def build(path):
        # rows are short and their analysis is long: tasks by number of products, which the footers tell, not by bytes
        n = max(spark.sparkContext.defaultParallelism, V.table(spark, sf, "part").count() // TASK_PRODUCTS + 1)
        return SE.product_index(product_docs(spark, sf).repartition(n, "product_id"), path)

    return IX.stored(spark, "product", paths, build)


def corpus_ix(spark, sf):
    """The stored index of the corpus."""
    docs = V.table(spark, sf, "documents").select("doc_id", "text")

    def build(path):
        # a row group is never shared by tasks, however long its analysis: the documents are dealt over tasks by their number
        n = max(spark.sparkContext.defaultParallelism, docs.count() // TASK_DOCUMENTS + 1)
        return IX.build_index(docs.repartition(n), {"text": "text"}, key="doc_id", path=path)

    return IX.stored(spark, "corpus", [f"{sf}/documents.parquet"], build)


def _scored_out(df, key="query_id"):
    return df.select(key, "doc_id", "rank", F.round("score", 4).alias("score"))


# --- analysis and index ----------------------------------------------------------------
@register("analyze_documents", f"""
SELECT doc_id, len({sql_analyze('text')}) AS n_terms, len(list_distinct({sql_analyze('text')})) AS n_distinct
FROM documents""")
def q_analyze_documents(spark, sf):
    """X1 over the whole corpus: terms per document after the analyzer."""
    d = V.table(spark, sf, "documents").select("doc_id", TX.analyze(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_terms"),
                    F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@register("name_term_stats", f"""
SELECT term, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest({sql_analyze('p_name')}) AS term FROM part)
GROUP BY term""")
def q_name_term_stats(spark, sf):
    """Document frequency of every term of the product name field."""
    return product_ix(spark, sf).terms.filter(F.col("field") == "name").select("term", "df")


@register("corpus_term_stats", f"""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf
FROM (SELECT doc_id, unnest({sql_analyze('text')}) AS term FROM documents) GROUP BY term""")
def q_corpus_term_stats(spark, sf):
    """X5 over the corpus: document frequency and total term frequency."""
    return corpus_ix(spark, sf).terms.select("term", "df", "cf")


@register("index_postings", PIX + f"""
SELECT p.field, p.term, p.doc_id, p.tf, round({sql_bm25('p.tf', 'd.df', 'fs.n_docs', 'l.dl', 'fs.avgdl')}, 4) AS impact
FROM ix_post p JOIN ix_df d ON d.field = p.field AND d.term = p.term JOIN ix_fs fs ON fs.field = p.field
JOIN ix_len l ON l.field = p.field AND l.doc_id = p.doc_id""", ("doc_v",))
def q_index_postings(spark, sf):
    """Every posting of the stored product index, read back from its blocks, with its impact."""
    rows = product_ix(spark, sf).blocks.select("field", "term", F.explode("postings").alias("p"))
    return rows.select("field", "term", "p.doc_id", F.col("p.tf").cast("bigint").alias("tf"), F.round("p.impact", 4).alias("impact"))


@register("edge_ngrams", f"""
SELECT gram, count(DISTINCT p_partkey) AS products FROM (
  SELECT p_partkey, substr(t, 1, n) AS gram FROM (
    SELECT p_partkey, t, unnest(generate_series(2, least(20, length(t)))) AS n
    FROM (SELECT p_partkey, unnest({sql_raw_tokens('p_name')}) AS t FROM part) WHERE length(t) >= 2))
GROUP BY gram""")
def q_edge_ngrams(spark, sf):
    """Autocomplete grams of product names: how many names carry each gram."""
    D = product_docs(spark, sf)
    toks = D.select("product_id", F.explode(TX.raw_tokens(F.col("name"))).alias("t"))
    grams = toks.select("product_id", F.explode(TX.edge_ngrams(F.col("t"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count_distinct("product_id").alias("products"))


@register("sku_terms", f"""
SELECT p_partkey AS product_id,
       {sql_analyze_sku("upper(substr(p_type, 1, 3)) || '-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')")} AS sku_term
FROM part""")
def q_sku_terms(spark, sf):
    """The SKU keyword analyzer (whole value, lower case, folded)."""
    D = product_docs(spark, sf)
    return D.select("product_id", TX.analyze_sku(F.col("sku")).alias("sku_term"))


# --- product search ---------------------------------------------------------------------
def _request_sql(hits: str, order: str | None = None, columns: str = "") -> str:
    """Pages of ``hits`` (query_id, doc_id) by ``order``, or the sort of each request."""
    menu = "('name', 'price', 'createdat', 'popularityscore')"
    keys = "".join(f"CASE WHEN r.by_ = '{key}' AND {sign}r.asc_ THEN {col} END {way} NULLS LAST,\n      "
                   for key, col in (("name", "CASE WHEN length(d.name) <= 256 THEN d.name END"), ("price", "d.price"),
                                    ("createdat", "d.created_at"), ("popularityscore", "d.popularity_score"))
                   for sign, way in (("", "ASC"), ("NOT ", "DESC")))
    keys += (f"CASE WHEN r.by_ NOT IN {menu} THEN d.popularity_score END DESC NULLS LAST,\n      "
             f"CASE WHEN r.by_ NOT IN {menu} THEN d.created_at END DESC NULLS LAST")
    return f""",
hits AS ({hits}),
ranked AS (SELECT h.*, r.page, r.size, row_number() OVER (PARTITION BY h.query_id ORDER BY
      {order or keys}, h.doc_id ASC) AS rank
    FROM hits h JOIN req r ON r.query_id = h.query_id JOIN doc_v d ON d.product_id = h.doc_id)
SELECT query_id, doc_id, rank{columns} FROM ranked WHERE rank > page * size AND rank <= (page + 1) * size"""


REQ_SQL = """
req AS (SELECT *, lower(coalesce(sort_by, '')) AS by_, lower(coalesce(sort_direction, '')) = 'asc' AS asc_,
               coalesce(length(trim(q)) = 0, true) AS blank_, coalesce(len(categories) > 0, false) AS has_cats
        FROM search_req_v)"""
PRICE_SQL = "coalesce(d.price >= r.min_price, true) AND coalesce(d.price <= r.max_price, true)"
TEXT_SQL = PIX + score_ctes("(SELECT * FROM search_req_v WHERE coalesce(length(trim(q)), 0) > 0)", SE.MAIN_FIELDS, "and", True) + f""",{REQ_SQL},
textm AS (SELECT s.query_id, s.doc_id, s.score FROM scored s JOIN req r ON r.query_id = s.query_id
          JOIN doc_v d ON d.product_id = s.doc_id
          WHERE (r.categories IS NULL OR len(r.categories) = 0 OR coalesce(list_has_any(d.categories, r.categories), false))
            AND {PRICE_SQL})"""
BROWSE_SQL = """,
browse AS (SELECT DISTINCT r.query_id, d.product_id AS doc_id FROM req r JOIN doc_v d
           ON list_has_any(d.categories, r.categories) WHERE r.blank_ AND r.has_cats{0}),
rng AS (SELECT r.query_id, d.product_id AS doc_id FROM req r JOIN doc_v d
        ON d.price >= coalesce(r.min_price, 0) AND coalesce(d.price <= r.max_price, true)
        WHERE r.blank_ AND NOT r.has_cats)"""
ALL_HITS = "SELECT query_id, doc_id FROM textm UNION ALL SELECT * FROM browse UNION ALL SELECT * FROM rng"
#: The deepest row of the request menu: page 2 of 20.
DEEPEST = 60


@register("search_products", TEXT_SQL + BROWSE_SQL.format("") + _request_sql(ALL_HITS), ("doc_v", "search_req_v"))
def q_search_products(spark, sf):
    """One page per search request of the batch."""
    return SE.search_products(product_ix(spark, sf), V.search_requests(spark, sf), deepest=DEEPEST).drop("score")


@register("search_browse_priced", TEXT_SQL + BROWSE_SQL.format(f" AND {PRICE_SQL}") + _request_sql(ALL_HITS),
          ("doc_v", "search_req_v"))
def q_search_browse_priced(spark, sf):
    """Q4 the other way: category browse within the request's price range, too."""
    ix = product_ix(spark, sf)
    return SE.search_products(ix, V.search_requests(spark, sf), price_in_browse=True, deepest=DEEPEST).drop("score")


@register("search_by_relevance", TEXT_SQL + _request_sql("SELECT * FROM textm", "round(h.score, 6) DESC", ", round(score, 4) AS score"),
          ("doc_v", "search_req_v"))
def q_search_by_relevance(spark, sf):
    """X6/T1 by score (Q19): the requests with a text, sorted by relevance."""
    reqs = (V.search_requests(spark, sf).filter(F.length(F.trim("q")) > 0)
            .withColumn("sort_by", F.lit("relevance")))
    found = SE.search_products(product_ix(spark, sf), reqs, relevance=True, deepest=DEEPEST)
    return found.withColumn("score", F.round("score", 4))


@register("search_relational", f""",{REQ_SQL}""" + _request_sql(f"""
SELECT r.query_id, d.product_id AS doc_id FROM req r JOIN doc_v d
  ON (contains(lower(d.name), lower(coalesce(r.q, ''))) OR contains(lower(coalesce(d.description, '')), lower(coalesce(r.q, ''))))
 AND (NOT r.has_cats OR list_has_any(d.categories, r.categories)) AND {PRICE_SQL}"""), ("doc_v", "search_req_v"))
def q_search_relational(spark, sf):
    """The same batch on the relational path (J2 in set form, T1, T3)."""
    found = SE.search_with_fallback("relational", product_ix(spark, sf), V.search_requests(spark, sf), deepest=DEEPEST)
    return found.drop("score")


@register("fuzzy_expansions", f"""
, qt AS (SELECT DISTINCT qterm FROM (SELECT unnest(list_distinct({sql_analyze_query('q')})) AS qterm FROM search_req_v)
         WHERE length(qterm) > 0),
dict AS (SELECT DISTINCT unnest({sql_analyze('p_name')}) AS term FROM part),
c AS (SELECT qterm, term, CASE WHEN qterm = term THEN 0 ELSE damerau_levenshtein(qterm, term) END AS edits,
             CASE WHEN length(qterm) <= 2 THEN 0 WHEN length(qterm) <= 5 THEN 1 ELSE 2 END AS k FROM qt, dict)
SELECT qterm, term, edits FROM (SELECT *, row_number() OVER (PARTITION BY qterm ORDER BY edits, term) AS r
                                FROM c WHERE edits <= k)""", ("search_req_v",))
def q_fuzzy_expansions(spark, sf):
    """Name-dictionary terms within AUTO distance of each request term."""
    reqs = V.search_requests(spark, sf)
    qt = SE.query_terms(reqs, {"name": "text"}).select("field", "qterm").distinct().withColumn("query_id", F.lit(0))
    e = SE.expand_terms(product_ix(spark, sf), qt, fuzzy=True)
    return e.select("qterm", "term", F.col("edits").cast("bigint").alias("edits"))


@register("name_fuzzy", PIX + score_ctes("search_req_v", {"name": ("text", 1.0)}, "or", True)
          + "\n" + top_k_sql("scored", "query_id", 10), ("doc_v", "search_req_v"))
def q_name_fuzzy(spark, sf):
    """Fuzzy name match (any term), best 10 per request."""
    ix = product_ix(spark, sf)
    return _scored_out(SE.per_distinct(V.search_requests(spark, sf), ["q"], lambda c: SE.name_fuzzy(ix, c, 10)))


@register("name_simple_fuzzy", PIX + score_ctes("search_req_v", {"name": ("text", 1.0)}, "or", True, raw=True)
          + "\n" + top_k_sql("scored", "query_id", 10), ("doc_v", "search_req_v"))
def q_name_simple_fuzzy(spark, sf):
    """X11: the raw request text as one fuzzy term on name."""
    ix = product_ix(spark, sf)
    return _scored_out(SE.per_distinct(V.search_requests(spark, sf), ["q"], lambda c: SE.name_simple_fuzzy(ix, c, 10)))


@register("multi_field_search", PIX + score_ctes("search_req_v", SE.MULTI_FIELDS, "or", False)
          + "\n" + top_k_sql("scored", "query_id", 10), ("doc_v", "search_req_v"))
def q_multi_field_search(spark, sf):
    """Exact multi-field search, best 10 per request."""
    ix = product_ix(spark, sf)
    return _scored_out(SE.per_distinct(V.search_requests(spark, sf), ["q"], lambda c: SE.multi_field_search(ix, c, 10)))


@register("search_in_category", PIX + score_ctes(
    "(SELECT * FROM search_req_v WHERE categories IS NOT NULL)", SE.CATEGORY_FIELDS, "or", False) + """,
f AS (SELECT s.* FROM scored s JOIN search_req_v r ON r.query_id = s.query_id
      JOIN doc_v d ON d.product_id = s.doc_id WHERE list_has_any(d.categories, r.categories))
""" + top_k_sql("f", "query_id", 10), ("doc_v", "search_req_v"))
def q_search_in_category(spark, sf):
    """X7 fields within the request's category (requests that have one)."""
    ix = product_ix(spark, sf)
    reqs = V.search_requests(spark, sf).filter(F.col("categories").isNotNull())
    return _scored_out(SE.per_distinct(reqs, ["q", "categories", "min_price", "max_price"],
                                       lambda c: SE.search_in_category(ix, c, 10)))


@register("search_in_price_range", PIX + score_ctes(
    "(SELECT * FROM search_req_v WHERE min_price IS NOT NULL)", SE.CATEGORY_FIELDS, "or", False) + """,
f AS (SELECT s.* FROM scored s JOIN search_req_v r ON r.query_id = s.query_id
      JOIN doc_v d ON d.product_id = s.doc_id WHERE d.price >= r.min_price AND d.price <= r.max_price)
""" + top_k_sql("f", "query_id", 10), ("doc_v", "search_req_v"))
def q_search_in_price_range(spark, sf):
    """X7 fields within the request's price range (requests that have one)."""
    ix = product_ix(spark, sf)
    reqs = V.search_requests(spark, sf).filter(F.col("min_price").isNotNull())
    return _scored_out(SE.per_distinct(reqs, ["q", "categories", "min_price", "max_price"],
                                       lambda c: SE.search_in_price_range(ix, c, 10)))


COMPLETIONS_SQL = AUTOCOMPLETE_SQL + PIX + f""",
sc AS (SELECT m.query_id, m.doc_id, {sql_bm25('m.freq', dl='l.dl', avgdl='fs.avgdl', idf='w.idf')} AS score
       FROM matched m JOIN (SELECT query_id, sum({sql_idf('df', 'n_docs')}) AS idf FROM terms, ix_fs
                            WHERE field = 'name' GROUP BY query_id) w ON w.query_id = m.query_id
       JOIN ix_len l ON l.field = 'name' AND l.doc_id = m.doc_id JOIN ix_fs fs ON fs.field = 'name')
"""


@register("autocomplete", COMPLETIONS_SQL + top_k_sql("sc", "query_id", 10), ("prefix_req_v", "doc_v"))
def q_autocomplete(spark, sf):
    """The best 10 products whose name completes the prefix as a phrase."""
    ix = product_ix(spark, sf)
    return _scored_out(SE.per_distinct(V.prefix_requests(spark, sf), ["q"], lambda c: SE.autocomplete(ix, c, k=10)))


@register("autocomplete_all", AUTOCOMPLETE_SQL + "\nSELECT query_id, doc_id FROM matched", ("prefix_req_v",))
def q_autocomplete_all(spark, sf):
    """Every product whose name completes the prefix as a phrase."""
    ix = product_ix(spark, sf)
    return SE.per_distinct(V.prefix_requests(spark, sf), ["q"],
                           lambda c: SE.autocomplete(ix, c).select("query_id", "doc_id"), whole=True)


@register("suggest", COMPLETIONS_SQL + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
                       FROM sc) WHERE rank <= 5)
SELECT DISTINCT t.query_id, p.name FROM top t JOIN doc_v p ON p.product_id = t.doc_id""",
          ("prefix_req_v", "doc_v"))
def q_suggest(spark, sf):
    """X13 + T7: first 5 completions per prefix, then distinct names."""
    ix = product_ix(spark, sf)
    return SE.per_distinct(V.prefix_requests(spark, sf), ["q"], lambda c: SE.suggest(ix, c, 5))


@register("more_like_this", PIX + f""",
seeds AS (SELECT DISTINCT product_id AS seed_id FROM views_v),
st AS (SELECT s.seed_id, p.field, p.term, p.tf, d.df, fs.n_docs, fs.avgdl FROM seeds s
       JOIN ix_post p ON p.doc_id = s.seed_id JOIN ix_df d ON d.field = p.field AND d.term = p.term
       JOIN ix_fs fs ON fs.field = p.field WHERE p.field IN ('name', 'description', 'categories')),
wt AS (SELECT *, CAST(tf AS DOUBLE) * (ln(CAST(n_docs AS DOUBLE) / CAST(df + 1 AS DOUBLE)) + CAST(1.0 AS DOUBLE)) AS w FROM st),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY w DESC, field, term) AS r FROM wt)),
need AS (SELECT seed_id, greatest(1, floor(CAST(count(*) AS DOUBLE) * CAST(0.3 AS DOUBLE))) AS need FROM chosen GROUP BY 1),
hits AS (SELECT c.seed_id, p.doc_id, {sql_bm25('p.tf', 'c.df', 'c.n_docs', 'l.dl', 'c.avgdl')} AS sc
         FROM chosen c JOIN ix_post p ON p.field = c.field AND p.term = c.term
         JOIN ix_len l ON l.field = c.field AND l.doc_id = p.doc_id WHERE p.doc_id <> c.seed_id),
agg AS (SELECT seed_id, doc_id, sum(sc) AS score, count(*) AS matched FROM hits GROUP BY 1, 2),
res AS (SELECT a.seed_id, a.doc_id, a.score FROM agg a JOIN need n USING (seed_id) WHERE a.matched >= n.need)
""" + top_k_sql("res", "seed_id", 5), ("doc_v", "views_v"))
def q_more_like_this(spark, sf):
    """5 most similar products for every viewed product."""
    seeds = V.views(spark, sf).select(F.col("product_id").alias("id")).distinct()
    return _scored_out(SE.more_like_this(product_ix(spark, sf), seeds, 5), key="seed_id")


# --- corpus search ---------------------------------------------------------------------
@register("corpus_search", CIX + score_ctes(
    "(SELECT item_id AS query_id, text AS q FROM benchmark)", {"text": ("text", 1.0)}, "or", False, prefix="cx")
          + "\n" + top_k_sql("scored", "query_id", 10))
def q_corpus_search(spark, sf):
    """X7/X15 on the corpus: each whole benchmark text as a query (any term),
    BM25, best 10 documents per query."""
    ix = corpus_ix(spark, sf)
    _, exp = SE.weighted_terms(ix, V.text_queries(spark, sf), {"text": ("text", 1.0)})
    return _scored_out(SE.best(ix, exp, 10))


@register("corpus_search_all_terms", CIX + score_ctes(
    "(SELECT item_id AS query_id, text AS q FROM benchmark)", {"text": ("text", 1.0)}, "and", False, prefix="cx")
          + "\nSELECT query_id, doc_id, round(score, 4) AS score FROM scored")
def q_corpus_search_all_terms(spark, sf):
    """X6 on the corpus without fuzziness: documents containing every term of
    a whole benchmark text (the texts are quoted inside documents)."""
    ix = corpus_ix(spark, sf)
    s = SE.score_fields(ix, V.text_queries(spark, sf), {"text": ("text", 1.0)}, operator="and")
    return s.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@register("corpus_more_like_this", CIX + f""",
seeds AS (SELECT DISTINCT doc_id AS seed_id FROM labels),
st AS (SELECT s.seed_id, p.field, p.term, p.tf, d.df, fs.n_docs, fs.avgdl FROM seeds s
       JOIN cx_post p ON p.doc_id = s.seed_id JOIN cx_df d ON d.field = p.field AND d.term = p.term
       JOIN cx_fs fs ON fs.field = p.field WHERE p.field IN ('text')),
wt AS (SELECT *, CAST(tf AS DOUBLE) * (ln(CAST(n_docs AS DOUBLE) / CAST(df + 1 AS DOUBLE)) + CAST(1.0 AS DOUBLE)) AS w FROM st),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY w DESC, field, term) AS r FROM wt)),
need AS (SELECT seed_id, greatest(1, floor(CAST(count(*) AS DOUBLE) * CAST(0.3 AS DOUBLE))) AS need FROM chosen GROUP BY 1),
hits AS (SELECT c.seed_id, p.doc_id, {sql_bm25('p.tf', 'c.df', 'c.n_docs', 'l.dl', 'c.avgdl')} AS sc
         FROM chosen c JOIN cx_post p ON p.field = c.field AND p.term = c.term
         JOIN cx_len l ON l.field = c.field AND l.doc_id = p.doc_id WHERE p.doc_id <> c.seed_id),
agg AS (SELECT seed_id, doc_id, sum(sc) AS score, count(*) AS matched FROM hits GROUP BY 1, 2),
res AS (SELECT a.seed_id, a.doc_id, a.score FROM agg a JOIN need n USING (seed_id) WHERE a.matched >= n.need)
""" + top_k_sql("res", "seed_id", 5))
def q_corpus_more_like_this(spark, sf):
    """X14 on the corpus, over all terms: 5 most similar documents for every labelled document."""
    ix = corpus_ix(spark, sf)
    seeds = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct()
    return _scored_out(SE.more_like_this(ix, seeds, 5, ("text",)), key="seed_id")
