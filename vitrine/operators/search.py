"""Full-text search as Spark jobs over a stored index.

A batch of queries is analysed with the same Column analyzer as the index,
expanded (fuzzy / prefix) against its dictionary and joined with its blocks on
(field, term, part). A posting carries its impact, so scores are sums. Where
only the best k answers of a query with many postings count (``best``), a first round
over the strongest blocks finds what the k-th answer scores at least, and blocks that
cannot lift a document there are skipped; the candidates left are scored exactly from
their document vectors. Nothing is approximate: a document is left out only if the
sum of what it can still get is below the k-th score.

Scoring is BM25 (k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5)/(df + 0.5))),
rounded to 4 places on output; a field's length counts synonyms too. A fuzzy hit
is weighted 1 - edits/min(len). These are our definitions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import fuzzy as FZ
from vitrine.functions import text as TX
from vitrine.functions.features import is_blank, keyword
from vitrine.operators import cells
from vitrine.operators.index import PREFIX_MAX, Index, build_index, idf, saturation
from vitrine.operators.joins import SALTS, request_side
from vitrine.session import checkpoint_dir

MLT_MIN_SHOULD_MATCH = 0.3
#: Terms of a query and field that the first round of ``best`` looks at.
SEED_TERMS = 8
#: Queries with fewer postings are scored over all of them: that is less than the rounds of ``best`` cost.
FEW_POSTINGS = 1 << 17
#: The rounds go on only where the terms that can decide have less than this share of the query's postings.
DECIDING_SHARE = 0.25
#: Batches whose queries have this many times the index's postings are added up in cells, not a row a posting,
CELLS_SHARE = 0.25
#: and from so many on.
CELLS_POSTINGS = 1 << 24
#: Scores closer than this are taken as equal when a bound decides.
MARGIN = 1e-4
#: Postings that one task adds up. Spark would put partitions together by their compressed size, which says little here.
TASK_POSTINGS = 1 << 20
#: Rarest terms of a query by whose postings the documents with all its terms are looked up.
RAREST = 3
#: Identical requests are joined with whole answers in lists of so many, which are made of parts of about so many.
LIST_REQUESTS, PART_REQUESTS = 1 << 8, 1 << 14
#: Bits of the price cells of one level; a range is covered by at most 2^4 + 1 cells of its level.
CELL_BITS = 4
CELL_LEVELS = range(0, 40, CELL_BITS)
#: Parts over which the documents of a price cell are dealt; a wide range repeats its cells for each.
CELL_PARTS = 16

Keep = Callable[[DataFrame], DataFrame]


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# --- query terms and expansion ---------------------------------------------------------
def query_terms(queries: DataFrame, fields: dict[str, str], raw: bool = False) -> DataFrame:
    """(query_id, field, qterm) for fields (name -> kind): analysed text terms, the
    whole query for keyword fields, or the raw query text when ``raw`` (X11)."""
    q = F.col("q")

    def terms(kind: str) -> Column:
        if raw or kind == "keyword_array":
            return F.array(q)
        return F.array(TX.analyze_sku(q)) if kind == "sku" else F.array_distinct(TX.analyze_query(q))

    def pairs(field: str, kind: str) -> Column:
        return F.transform(terms(kind), lambda t: F.struct(F.lit(field).alias("field"), t.alias("qterm")))

    arrays = [pairs(*f) for f in fields.items()]
    return (queries.select("query_id", F.explode(F.concat(*arrays)).alias("t")).select("query_id", "t.field", "t.qterm")
            .where(F.length("qterm") > 0))


def expand_terms(ix: Index, qterms: DataFrame, fuzzy: bool, max_expansions: int | None = None) -> DataFrame:
    """(query_id, field, qterm) -> matching dictionary terms with edits, parts and top.
    Exact: equi-join. Fuzzy (AUTO: 0 / 1 / 2 edits by query-term length): an
    equi-join with the index's deletion neighbourhoods for candidates, then the exact
    distance; all of them, or the first ``max_expansions`` per query term (fewest
    edits, term order)."""
    known = ix.terms.select("field", "term", "df", "parts", "top")
    if not fuzzy:
        return qterms.withColumn("term", F.col("qterm")).withColumn("edits", F.lit(0)).join(known, ["field", "term"])
    distinct = qterms.select("field", "qterm").distinct().withColumn("k", TX.fuzzy_edits(F.col("qterm")))
    near = (distinct.select("field", "qterm", "k", F.explode(FZ.deletion_variants(F.col("qterm"))).alias("x"))
            .where(F.col("x.d") <= F.col("k")).select("field", "qterm", "k", F.col("x.v").alias("v")))
    found = (near.join(ix.variants, ["field", "v"]).where(F.col("d") <= F.col("k"))
             .where(F.abs(F.length("qterm") - F.length("term")) <= F.col("k"))
             .select("field", "qterm", "term", "k").distinct()
             .withColumn("edits", FZ.edit_distance("qterm", "term")).where(F.col("edits") <= F.col("k")).drop("k"))
    if max_expansions is not None:
        w = Window.partitionBy("field", "qterm").orderBy("edits", "term")
        found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_expansions).drop("_r")
    return qterms.join(found.join(known, ["field", "term"]), ["field", "qterm"])


def _boosts(fields: dict[str, tuple[str, float]]) -> Column:
    return reduce(lambda c, f: c.when(F.col("field") == f[0], F.lit(float(f[1][1]))), fields.items(), F.when(F.lit(False), F.lit(0.0)))


def weighted_terms(ix: Index, queries: DataFrame, fields: dict[str, tuple[str, float]], fuzzy: bool = False,
                   raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """The query terms, and their expansions with ``w`` (field boost x fuzzy weight) and ``lane`` (the field)."""
    qt = query_terms(queries, {f: kind for f, (kind, _) in fields.items()}, raw)
    weight = F.when(F.col("edits") == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.col("edits") / F.least(F.length("qterm"), F.length("term")))
    exp = expand_terms(ix, qt, fuzzy).withColumn("w", _boosts(fields) * weight).withColumn("lane", F.col("field"))
    return qt, exp.select("query_id", "lane", "field", "qterm", "term", "w", "df", "parts", "top")


def _tasks(exp: DataFrame) -> int:
    """Tasks over which the postings of the expansions ``exp`` (df) are dealt, about TASK_POSTINGS or fewer each."""
    return (exp.agg(F.sum("df")).first()[0] or 0) // TASK_POSTINGS + 1


def _with_blocks(ix: Index, exp: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Each expansion with the blocks of its term; only terms of several parts are repeated. Files hold far more postings
    than their size says, so where there are many, the blocks that are asked for are dealt over tasks first."""
    keyed = exp.drop("top", "df").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    key = ["field", "term", "part"]
    found = ix.blocks if blocks is None else blocks
    n = _tasks(exp)
    if n > exp.sparkSession.sparkContext.defaultParallelism:
        found = found.join(request_side(keyed.select(*key).distinct()), key, "left_semi").repartition(n, *key, "block")
    return found.join(request_side(keyed), key)


def _dealt(hits: DataFrame, exp: DataFrame) -> DataFrame:
    """The postings of the expansions ``exp`` (df) dealt by document, about TASK_POSTINGS or fewer a partition: for
    the filters on documents and, as no query and document are in two, for the sums."""
    return hits.repartition(max(_tasks(exp), int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "doc_id")


def _postings(found: DataFrame, *columns: str) -> DataFrame:
    """(query_id, lane, qterm, doc_id, s): the postings of joined blocks with their weighted impact."""
    each = found.select("query_id", "lane", "qterm", "w", *columns, F.explode("postings").alias("p"))
    return each.select("query_id", "lane", "qterm", *columns, "p.doc_id", (F.col("w") * F.col("p.impact")).alias("s"))


def _lanes(ix: Index, exp: DataFrame, fuzzy: bool, keep: Keep | None) -> DataFrame:
    """(query_id, lane, doc_id, s, matched) over all documents. The postings shuffle once, by document,
    which the filters and all sums over them can use."""
    hits = _dealt(_postings(_with_blocks(ix, exp)), exp)
    hits = keep(hits) if keep else hits
    if fuzzy:                                       # the best of a query term's expansions
        hits = hits.groupBy("query_id", "lane", "doc_id", "qterm").agg(F.max("s").alias("s"))
    return hits.groupBy("query_id", "lane", "doc_id").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("matched"))


def score_fields(ix: Index, queries: DataFrame, fields: dict[str, tuple[str, float]], operator: str = "or",
                 fuzzy: bool = False, raw: bool = False, keep: Keep | None = None) -> DataFrame:
    """Best-fields multi-match over all documents: per field, impacts summed over
    query terms (the best expansion of each term); with operator 'and' a field
    matches only if it matches every query term; a document's score is its best
    field's. ``keep`` filters (query_id, doc_id, ...) rows before they are scored.
    Returns (query_id, doc_id, score)."""
    qt, exp = weighted_terms(ix, queries, fields, fuzzy, raw)
    wanted = qt.groupBy("query_id", F.col("field").alias("lane")).agg(F.count(F.lit(1)).alias("wanted"))
    if operator == "and" and not fuzzy:
        lanes = _with_all(ix, exp, wanted, keep)
    else:
        lanes = _lanes(ix, _cut(exp), fuzzy, keep)
        if operator == "and":
            lanes = lanes.join(wanted, ["query_id", "lane"]).where("matched = wanted")
    return lanes.groupBy("query_id", "doc_id").agg(F.max("s").alias("score"))


def _with_all(ix: Index, exp: DataFrame, wanted: DataFrame, keep: Keep | None) -> DataFrame:
    """(query_id, lane, doc_id, s) of the documents with every term of a lane. Only the postings of its RAREST
    rarest terms are joined; documents that have these are looked up in the vectors for all of them."""
    lane = ["query_id", "lane"]
    each = (exp.groupBy(*lane, "field", "qterm", "term").agg(F.first("w").alias("w"), F.first("df").alias("df"), F.first("parts").alias("parts"),
                                                             F.first("top").alias("top"), F.count(F.lit(1)).alias("times")))
    known = each.groupBy(*lane).agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("n")).join(wanted, lane).where("times = wanted")
    rarity = F.row_number().over(Window.partitionBy(*lane).orderBy("df", "qterm"))
    each = _cut(each.join(known.drop("times"), lane).withColumn("rarity", rarity))
    rare = each.where(F.col("rarity") <= RAREST)
    hits = _dealt(_postings(_with_blocks(ix, rare), "n"), rare)
    pairs = (keep(hits) if keep else hits).groupBy(*lane, "doc_id", "n").agg(F.count(F.lit(1)).alias("met"))
    pairs = _cut(pairs.where(F.col("met") == F.least("n", F.lit(RAREST))).select(*lane, "doc_id"))
    terms = (ix.vectors.join(request_side(pairs), "doc_id").select(*lane, "doc_id", F.explode("terms").alias("t"))
             .select(*lane, "doc_id", "t.field", "t.term", "t.impact"))
    scored = terms.join(request_side(each.select(*lane, "field", "term", "w", "times", "wanted")), [*lane, "field", "term"])
    return (scored.groupBy(*lane, "doc_id").agg(F.sum(F.col("times") * F.col("w") * F.col("impact")).alias("s"),
                                                F.sum("times").alias("matched"), F.first("wanted").alias("wanted"))
            .where("matched = wanted"))


# --- the best k answers ----------------------------------------------------------------
def rescore(ix: Index, exp: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact scores of (query_id, doc_id) pairs from the document vectors: the sum of each lane, the best lane
    wins. Returns query_id, doc_id, score and matched (query terms of the best-matched lane)."""
    terms = (pairs.join(ix.vectors, "doc_id").select("query_id", "doc_id", F.explode("terms").alias("t"))
             .select("query_id", "doc_id", "t.field", "t.term", "t.impact"))
    # the terms of the documents are filtered where they are read; only pairs shuffle
    each = (terms.join(request_side(exp.select("query_id", "lane", "field", "qterm", "term", "w")), ["query_id", "field", "term"])
            .groupBy("query_id", "doc_id", "lane", "qterm").agg(F.max(F.col("w") * F.col("impact")).alias("s")))
    return (each.groupBy("query_id", "doc_id", "lane").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("matched"))
            .groupBy("query_id", "doc_id").agg(F.max("s").alias("score"), F.max("matched").alias("matched")))


def best(ix: Index, exp: DataFrame, k: int, keep: Keep | None = None, fuzzy: bool = False) -> DataFrame:
    """The ``k`` best documents of each query: (query_id, doc_id, score, rank).

    exp: rows (query_id, lane, field, qterm, term, w, df, parts, top). In a lane the
    impacts of its query terms add up, the best lane counts. Queries of up to
    FEW_POSTINGS are scored over all their postings, the others go through ``_least``
    and ``_deciding`` if that spares most of their postings.
    """
    exp = _cut(exp)
    size = exp.groupBy("query_id").agg(F.sum("df").alias("size"))
    whole = lambda rows: _lanes(ix, rows, fuzzy, keep).groupBy("query_id", "doc_id").agg(F.max("s").alias("score"))
    many = exp.join(size.where(F.col("size") > FEW_POSTINGS).select("query_id"), "query_id", "left_semi")
    if many.isEmpty():
        return top_k(whole(exp), "query_id", k)
    if keep is None and not fuzzy and _in_cells(ix, exp.agg(F.sum("df")).first()[0] or 0):
        lists = exp.groupBy("query_id", "lane").agg(F.lit(1).alias("need"), F.collect_list(F.struct("field", "term", "w")).alias("terms"))
        return top_k(cells.scores(ix, lists, k, exp.count()), "query_id", k)
    few = exp.join(size.where(F.col("size") <= FEW_POSTINGS).select("query_id"), "query_id", "left_semi")
    many = _cut(_least(ix, _cut(many), k, keep))
    deciding = F.col("below") + F.col("bound") >= F.col("least")
    share = many.groupBy("query_id").agg((F.sum(F.when(deciding, F.col("df")).otherwise(0)) / F.sum("df")).alias("share"))
    spared = many.join(share.where(F.col("share") < DECIDING_SHARE).select("query_id"), "query_id", "left_semi")
    rest = many.join(share.where(F.col("share") >= DECIDING_SHARE).select("query_id"), "query_id", "left_semi")
    scored = whole(few.unionByName(rest.select(few.columns))).unionByName(
        rescore(ix, many, _deciding(ix, spared, keep)).select("query_id", "doc_id", "score"))
    return top_k(scored, "query_id", k)


def _in_cells(ix: Index, asked: int) -> bool:
    """Whether ``asked`` postings are so many that ``cells`` costs less than a row for each."""
    held = ix.terms.agg(F.sum("df")).first()[0] or 0
    return asked >= max(CELLS_POSTINGS, CELLS_SHARE * held)


def _least(ix: Index, exp: DataFrame, k: int, keep: Keep | None) -> DataFrame:
    """``exp`` with bounds. Terms of a lane are ordered by their bound (w x top); ``below`` is the sum of the
    smaller ones. ``least``: the k-th best exact score among the documents in the first blocks of the
    SEED_TERMS strongest terms, which the k-th answer reaches."""
    bound = exp.groupBy("query_id", "lane", "qterm").agg(F.max(F.col("w") * F.col("top")).alias("bound"))
    by_lane = Window.partitionBy("query_id", "lane")
    bound = (bound.withColumn("strength", F.row_number().over(by_lane.orderBy(F.desc("bound"), "qterm")))
             .withColumn("below", F.coalesce(F.sum("bound").over(
                 by_lane.orderBy(F.col("strength").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    exp = _cut(exp.join(bound, ["query_id", "lane", "qterm"]))
    strong = exp.where(F.col("strength") <= SEED_TERMS)
    first = _dealt(_postings(_with_blocks(ix, strong, ix.blocks.where("block = 0"))), strong)
    seen = ((keep(first) if keep else first)
            .groupBy("query_id", "lane", "doc_id", "qterm").agg(F.max("s").alias("s"))
            .groupBy("query_id", "lane", "doc_id").agg(F.sum("s").alias("s"))
            .groupBy("query_id", "doc_id").agg(F.max("s").alias("score")))
    seeds = top_k(seen, "query_id", 2 * k + SEED_TERMS).select("query_id", "doc_id")
    least = top_k(rescore(ix, exp, seeds), "query_id", k).where(F.col("rank") == k).select(
        "query_id", (F.col("score") - MARGIN).alias("least"))
    return exp.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))


def _deciding(ix: Index, exp: DataFrame, keep: Keep | None) -> DataFrame:
    """(query_id, doc_id) pairs that hold every answer. A document whose strongest term lies in a block with
    below + w x top < least scores less, so such blocks are skipped, and terms without other blocks
    are not even joined. Documents met in the rest stay if what they have and the bounds of
    the terms not seen reach ``least``."""
    lanes = (exp.groupBy("query_id", "lane", "qterm")
             .agg(F.max("bound").alias("bound"), F.max("below").alias("below"), F.max("least").alias("least"))
             .withColumn("rest", F.least("bound", F.greatest(F.col("least") - F.col("below"), F.lit(0.0)))))
    total = lanes.groupBy("query_id", "lane").agg(F.sum("rest").alias("total"), F.max("least").alias("least"))
    strong = exp.where(F.col("below") + F.col("bound") >= F.col("least"))
    some = _with_blocks(ix, strong)
    some = _dealt(_postings(some.where(F.col("below") + F.col("w") * F.col("top") >= F.col("least"))), strong)
    met = ((keep(some) if keep else some).groupBy("query_id", "lane", "doc_id", "qterm").agg(F.max("s").alias("s"))
           .join(lanes.select("query_id", "lane", "qterm", "rest"), ["query_id", "lane", "qterm"])
           .groupBy("query_id", "lane", "doc_id").agg(F.sum(F.greatest(F.col("s") - F.col("rest"), F.lit(0.0))).alias("more")))
    return (met.join(total, ["query_id", "lane"]).where(F.col("total") + F.col("more") >= F.col("least"))
            .select("query_id", "doc_id").distinct())


def top_k(scored: DataFrame, key: str, k: int, order: list[Column] | None = None) -> DataFrame:
    """W2 over scores: best k per query (score desc, doc id asc)."""
    # scores equal to 1e-6 tie (summation order may move the last bits)
    order = order or [F.round("score", 6).desc(), F.col("doc_id").asc()]
    w = Window.partitionBy(key).orderBy(*order)
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


# --- the repository's queries ---------------------------------------------------------
MAIN_FIELDS = {"name": ("text", 4.0), "categories": ("keyword_array", 2.0), "description": ("text", 1.0)}
MULTI_FIELDS = {"name": ("text", 3.0), "description": ("text", 2.0), "sku": ("sku", 2.0),
                "all_text": ("text", 1.0)}
CATEGORY_FIELDS = {"name": ("text", 3.0), "description": ("text", 2.0), "all_text": ("text", 1.0)}
NAME_FIELD = {"name": ("text", 1.0)}
PRODUCT_INDEX_FIELDS = {"name": "text", "description": "text", "categories": "keyword_array",
                        "sku": "sku", "all_text": "text"}
PRODUCT_COLUMNS = ["name", "description", "categories", "price", "popularity_score", "created_at"]


def product_index(D: DataFrame, path: str | None = None) -> Index:
    return build_index(D, PRODUCT_INDEX_FIELDS, key="product_id", path=path, positions=True, keep=PRODUCT_COLUMNS,
                       fuzzy=list(MAIN_FIELDS), prefix=["name"])


def _passes(categories: bool = True, price: bool = True) -> Column:
    """Unscored filters of a request on a document: categories (empty / null = none) and the inclusive price range."""
    cat_ok = (F.col("q_categories").isNull() | (F.size("q_categories") == 0)
              | F.coalesce(F.arrays_overlap("categories", "q_categories"), F.lit(False)))
    price_ok = (F.coalesce(F.col("price") >= F.col("min_price"), F.lit(True))
                & F.coalesce(F.col("price") <= F.col("max_price"), F.lit(True)))
    return (cat_ok if categories else F.lit(True)) & (price_ok if price else F.lit(True))


def within(ix: Index, queries: DataFrame, categories: bool = True, price: bool = True) -> Keep:
    """Keeps the rows whose document passes its query's filters. The rows meet the documents by doc_id, so
    what is scored afterwards, by (query, document), need not shuffle again."""
    q = request_side(queries.select("query_id", F.col("categories").alias("q_categories"), "min_price", "max_price"))
    d = ix.docs.select("doc_id", "categories", "price").hint("merge")

    def keep(rows: DataFrame) -> DataFrame:
        return (rows.join(q, "query_id").join(d, "doc_id").where(_passes(categories, price)).select(*rows.columns))

    return keep


def search(ix: Index, queries: DataFrame) -> DataFrame:
    """Every query term must match (per field), best field wins, boosts
    name^4 categories^2 description^1, AUTO fuzzy, within the category and price
    filters. (query_id, doc_id, score)."""
    return score_fields(ix, queries, MAIN_FIELDS, operator="and", fuzzy=True, keep=within(ix, queries))


def _best_fields(ix: Index, queries: DataFrame, fields: dict[str, tuple[str, float]], k: int | None, keep: Keep | None = None,
                 fuzzy: bool = False, raw: bool = False) -> DataFrame:
    if k is None:
        return score_fields(ix, queries, fields, "or", fuzzy, raw, keep)
    return best(ix, weighted_terms(ix, queries, fields, fuzzy, raw)[1], k, keep, fuzzy)


def multi_field_search(ix: Index, queries: DataFrame, k: int | None = None) -> DataFrame:
    """name^3, description^2, sku^2, all_text^1; any term matches; exact. All answers, or the best ``k``."""
    return _best_fields(ix, queries, MULTI_FIELDS, k)


def search_in_category(ix: Index, queries: DataFrame, k: int | None = None) -> DataFrame:
    """X7 on name/description/all_text, restricted to the query's category."""
    return _best_fields(ix, queries, CATEGORY_FIELDS, k, within(ix, queries, price=False))


def search_in_price_range(ix: Index, queries: DataFrame, k: int | None = None) -> DataFrame:
    """X7 on name/description/all_text within the price range."""
    return _best_fields(ix, queries, CATEGORY_FIELDS, k, within(ix, queries, categories=False))


def name_fuzzy(ix: Index, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Fuzzy match on the analysed name, any term."""
    return _best_fields(ix, queries, NAME_FIELD, k, fuzzy=True)


def name_simple_fuzzy(ix: Index, queries: DataFrame, k: int | None = None) -> DataFrame:
    """X11: one fuzzy term on name; the query text is not analysed."""
    return _best_fields(ix, queries, NAME_FIELD, k, fuzzy=True, raw=True)


# --- autocomplete ----------------------------------------------------------------------
def prefix_terms(ix: Index, prefixes: DataFrame, field: str, max_expansions: int | None = None) -> DataFrame:
    """Rows of ``prefixes`` (with qterm) x the dictionary terms that begin with it, all or the first
    ``max_expansions`` in term order: term, df, parts, n_docs, avgdl. A prefix is an interval of term numbers; one
    that is longer than the table's is narrowed by comparing."""
    table = ix.prefixes.where(F.col("field") == field).drop("field")
    found = prefixes.withColumn("prefix", F.substring("qterm", 1, PREFIX_MAX)).join(table, "prefix")
    if max_expansions is not None:
        short = F.length("qterm") <= PREFIX_MAX
        found = found.withColumn("high", F.when(short, F.least("high", F.col("low") + (max_expansions - 1))).otherwise(F.col("high")))
    terms = ix.terms.where(F.col("field") == field).select("number", "term", "df", "parts", "n_docs", "avgdl")
    found = (found.withColumn("number", F.explode(F.sequence("low", "high"))).drop("low", "high", "prefix")
             .join(terms, "number").where(F.col("term").startswith(F.col("qterm"))))
    if max_expansions is None:
        return found.drop("number")
    w = Window.partitionBy(*prefixes.columns).orderBy("number")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_expansions).drop("_r", "number")


def autocomplete(ix: Index, queries: DataFrame, field: str = "name", k: int | None = None,
                 max_expansions: int | None = None) -> DataFrame:
    """Phrase-prefix: the query's leading terms as a phrase (relative
    positions kept, stop-word gaps included) and its last term as a prefix
    expanded to all dictionary terms it begins, or the first ``max_expansions``
    in term order. The score is BM25 of the phrase's frequency, with the sum of
    the idf of all terms it may consist of. All completions, or the best ``k``:
    (query_id, doc_id, score[, rank])."""
    qp = (queries.select("query_id", F.posexplode(TX.analyze_query_positions(F.col("q"))).alias("i", "t"))
          .select("query_id", "i", F.col("t.pos").alias("qpos"), F.col("t.term").alias("qterm")))
    shape = qp.groupBy("query_id").agg(F.max("i").alias("last_i"), F.min("qpos").alias("p0"), F.count(F.lit(1)).alias("n"))
    qp = qp.join(shape, "query_id").withColumn("rel", F.col("qpos") - F.col("p0"))
    known = ix.terms.where(F.col("field") == field).select("term", "df", "parts", "n_docs", "avgdl")
    exact = qp.where("i < last_i").withColumn("term", F.col("qterm")).join(known, "term")
    terms = _cut(exact.unionByName(prefix_terms(ix, qp.where("i = last_i"), field, max_expansions)))
    keyed = terms.select("query_id", "i", "n", "rel", "term", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = ix.blocks.where(F.col("field") == field).drop("field", "block", "top").join(request_side(keyed), ["term", "part"])
    # the places where the phrase would begin, of each term, from its position list as it is
    hits = joined.select("query_id", "i", "n", "rel", F.explode("postings").alias("p"))
    hits = _dealt(hits.select("query_id", "i", "n", "p.doc_id", "p.dl", F.transform("p.positions", lambda x: x - F.col("rel")).alias("starts")), terms)
    phrase = (hits.withColumn("start", F.explode("starts"))
              .groupBy("query_id", "doc_id", "start", "i", "n").agg(F.max("dl").alias("dl"))
              .groupBy("query_id", "doc_id", "start", "n").agg(F.count(F.lit(1)).alias("met"), F.max("dl").alias("dl")).where("met = n")
              .groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("freq"), F.max("dl").alias("dl")))
    idfs = terms.groupBy("query_id").agg(F.sum(idf(F.col("df"), F.col("n_docs"))).alias("idf"), F.max("avgdl").alias("avgdl"))
    scored = phrase.join(idfs, "query_id").select(
        "query_id", "doc_id", (F.col("idf") * saturation(F.col("freq"), F.col("dl"), F.col("avgdl"))).alias("score"))
    return scored if k is None else top_k(scored, "query_id", k)


def suggest(ix: Index, queries: DataFrame, k: int) -> DataFrame:
    """X13 + T7: first k completions per prefix (score desc, id asc), then the
    distinct product names among them (may be fewer than k)."""
    top = autocomplete(ix, queries, k=k)
    return top.join(ix.docs.select("doc_id", "name"), "doc_id").select("query_id", "name").distinct()


# --- more like this --------------------------------------------------------------------
def more_like_this(ix: Index, seeds: DataFrame, k: int, fields: tuple[str, ...] = ("name", "description", "categories"),
                   max_query_terms: int | None = None) -> DataFrame:
    """For each seed document, its (field, term) pairs, all or the
    ``max_query_terms`` best by tf x idf (idf = ln(N/(df+1)) + 1; min tf 1, min df 1), then the ``k`` best
    documents of those that match at least 30% of them (at least one), scored by BM25 over the
    matched terms; the seed itself is excluded. (seed_id, doc_id, score, rank)."""
    s = seeds.select(F.col("id").alias("doc_id")).distinct()
    vectors = s.join(ix.vectors, "doc_id").select(F.col("doc_id").alias("query_id"),
                                                  F.filter("terms", lambda t: t["field"].isin(list(fields))).alias("terms"))
    own = vectors.select("query_id", F.explode("terms").alias("t")).select("query_id", "t.field", "t.term")
    need = lambda n: F.greatest(F.lit(1), F.floor(n * MLT_MIN_SHOULD_MATCH)).alias("need")
    if max_query_terms is None:                     # seeds go to the cells as their vectors are: no row a term is stored
        counts = own.groupBy("field", "term").agg(F.count(F.lit(1)).alias("seeds")).join(ix.terms.select("field", "term", "df"), ["field", "term"])
        n_terms, asked = counts.agg(F.sum("seeds"), F.sum(F.col("seeds") * F.col("df"))).first()
        if _in_cells(ix, asked or 0):
            entries = F.transform("terms", lambda t: F.struct(t["field"].alias("field"), t["term"].alias("term"), F.lit(1.0).alias("w")))
            lists = vectors.where(F.size("terms") > 0).select("query_id", F.lit("").alias("lane"), need(F.size("terms")), entries.alias("terms"))
            return _not_seeds(cells.scores(ix, lists, k + 1, n_terms or 0, fields), k)
    exp = own.join(ix.terms.select("field", "term", "df", "parts", "top", "n_docs"), ["field", "term"])
    if max_query_terms is not None:
        # term frequencies of the seeds come from the postings, which the vectors do not repeat
        found = _with_blocks(ix, exp)
        tf = (found.select("query_id", "field", "term", F.explode("postings").alias("p"))
              .where(F.col("p.doc_id") == F.col("query_id")).select("query_id", "field", "term", "p.tf"))
        weight = F.col("tf") * (F.log(F.col("n_docs") / (F.col("df") + 1)) + 1.0)
        w = Window.partitionBy("query_id").orderBy(F.desc("weight"), "field", "term")
        exp = (exp.join(tf, ["query_id", "field", "term"]).withColumn("weight", weight)
               .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_query_terms))
    exp = exp.select("query_id", F.lit("").alias("lane"), "field", F.concat_ws("\t", "field", "term").alias("qterm"), "term",
                     F.lit(1.0).alias("w"), "df", "parts", "top")
    exp = _cut(exp.join(exp.groupBy("query_id").agg(need(F.count(F.lit(1)))), "query_id"))
    if max_query_terms is not None and _in_cells(ix, exp.agg(F.sum("df")).first()[0] or 0):
        lists = exp.groupBy("query_id", "lane").agg(F.first("need").alias("need"), F.collect_list(F.struct("field", "term", "w")).alias("terms"))
        return _not_seeds(cells.scores(ix, lists, k + 1, exp.count(), fields), k)
    # A document that matches ``need`` terms matches need - x of those that are left without the x most common.
    common = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("df"), "qterm"))
    rarer = exp.withColumn("nth", common).where(F.col("nth") > F.floor(F.col("need") / 2)).drop("nth")
    met = (_postings(_with_blocks(ix, rarer), "need").where(F.col("doc_id") != F.col("query_id"))
           .groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")))
    pairs = met.where(F.col("n") >= F.col("need") - F.floor(F.col("need") / 2))
    scored = rescore(ix, exp, pairs.select("query_id", "doc_id")).join(exp.select("query_id", "need").distinct(), "query_id")
    found = scored.where("matched >= need").select("query_id", "doc_id", "score")
    return top_k(found, "query_id", k).withColumnRenamed("query_id", "seed_id")


def _not_seeds(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each seed without itself."""
    return top_k(found.where(F.col("doc_id") != F.col("query_id")), "query_id", k).withColumnRenamed("query_id", "seed_id")


# --- batches of requests ---------------------------------------------------------------
def per_distinct(queries: DataFrame, params: list[str], run, whole: bool = False) -> DataFrame:
    """Answer identical requests once: ``run`` gets one row per distinct
    parameter combination (the exact JSON of the parameters, numbered: query_id is the number) and
    its rows are joined back to every request with those parameters. A batch
    of n requests over a small parameter menu costs one answer per distinct
    request, and nothing is expanded before each answer's own top-k. ``whole``: answers are not cut to a top-k."""
    key = F.to_json(F.struct(*[F.col(p) for p in params]))
    keyed = queries.withColumn("_combo", key)
    combos = _cut(keyed.select("_combo", *params).dropDuplicates(["_combo"]).withColumn("query_id", F.monotonically_increasing_id()))
    numbers = combos.select("_combo", F.col("query_id").alias("_number"))
    asked = keyed.select("query_id", "_combo").join(request_side(numbers), "_combo").select("_number", "query_id")
    res = run(combos.drop("_combo")).withColumnRenamed("query_id", "_number")
    return _each_request(asked, res) if whole else asked.join(res, "_number").drop("_number")


def _each_request(asked: DataFrame, res: DataFrame) -> DataFrame:
    """``asked`` (_number, query_id) joined with many rows of ``res`` (_number, doc_id, ...) a number. Requests are taken in lists of
    LIST_REQUESTS, so the join makes a row a list, and the rows that come out are a list's with one document after another: columns
    that repeat themselves byte by byte, as Parquet packs eight values at a time, take the fewest bytes where the answers are written. The
    documents of a number are dealt over up to SALTS parts."""
    asked = _cut(asked)                             # so that the numbers of its rows stay
    counts = asked.groupBy("_number").agg(F.count(F.lit(1)).alias("_n"))
    n_asked, n_numbers = asked.count(), counts.count()
    salts = F.lit(max(1, min(SALTS, n_asked // max(1, n_numbers)))).cast("bigint")
    part = F.pmod(F.xxhash64("_row"), F.floor(F.col("_n") / PART_REQUESTS) + 1).alias("_part")
    slices = F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(LIST_REQUESTS)), lambda i: F.slice("_all", i, LIST_REQUESTS))
    lists = (asked.withColumn("_row", F.monotonically_increasing_id()).join(request_side(counts), "_number")
             .groupBy("_number", part).agg(F.collect_list(F.struct("query_id")).alias("_all"))
             .select("_number", F.explode(slices).alias("_ids"))
             .select("_number", "_ids", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("_salt")))
    dealt = res.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), salts))
    # the left side is gone through row by row: a list, and all documents with it
    found = lists.hint("merge").join(dealt, ["_number", "_salt"])
    rest = [c for c in res.columns if c != "_number"]
    return found.select(F.explode("_ids").alias("_id"), *rest).select("_id.query_id", *rest)


SORT_FIELDS = {"name": "name", "price": "price", "createdat": "created_at",
               "popularityscore": "popularity_score"}
REQUEST = ["q", "categories", "min_price", "max_price", "sort_by", "sort_direction", "page", "size"]


def _request_combos(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identical requests are answered once: (combo_id -> params) and
    (query_id -> combo_id). A combo is known by a number, which its hits carry."""
    cats = F.array_sort(F.coalesce("categories", F.array().cast("array<string>")))
    q = queries.withColumn("categories", cats).withColumn("_combo", F.to_json(F.struct(*[F.col(c) for c in REQUEST])))
    combos = _cut(q.groupBy("_combo").agg(*[F.first(c).alias(c) for c in REQUEST])
                  .withColumn("combo_id", F.monotonically_increasing_id()))
    qmap = q.select("query_id", "_combo").join(request_side(combos.select("_combo", "combo_id")), "_combo").drop("_combo")
    return combos.drop("_combo").withColumnRenamed("categories", "q_categories"), qmap


def _sort_columns(relevance: bool) -> list[Column]:
    """T1 per request inside one window: a number and a name, each ascending or
    descending as the request asks, nulls last. Unknown field -> popularity
    desc, created desc; ``relevance`` -> score desc. Ties -> id asc."""
    by = F.lower(F.coalesce(F.col("sort_by"), F.lit("")))
    asc = F.lower(F.coalesce(F.col("sort_direction"), F.lit(""))) == "asc"
    epoch = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at")).cast("double")
    score = F.col("popularity_score").cast("double")
    value = (F.when(by == "price", F.col("price").cast("double")).when(by == "createdat", epoch).when(by == "popularityscore", score))
    signed = F.when(by.isin(list(SORT_FIELDS)), F.when(asc, value).otherwise(-value)).otherwise(-score)
    known = list(SORT_FIELDS)
    if relevance:
        known.append("relevance")
        signed = F.when(by == "relevance", -F.round("score", 6)).otherwise(signed)
    name = F.when(by == "name", keyword("name"))
    return [signed.asc_nulls_last(), F.when(asc, name).asc_nulls_last(), F.when(~asc, name).desc_nulls_last(),
            F.when(~by.isin(known), -epoch).asc_nulls_last(), F.col("doc_id").asc()]


def price_cells(price: Column) -> Column:
    """The cells of a price at every level: array<struct<level, cell>>. A cell of level l spans 2^l cents."""
    cents = (price * 100).cast("long")
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(cents, level).alias("cell")) for level in CELL_LEVELS])


def range_cells(low: Column, high: Column) -> Column:
    """Cells that cover the prices from ``low`` to ``high``, all of one level, at most 2^CELL_BITS + 1."""
    top = F.lit((1 << (CELL_LEVELS[-1] + CELL_BITS)) - 1)
    a, b = F.least(F.ceil(low * 100).cast("long"), top), F.least(F.coalesce(F.floor(high * 100).cast("long"), top), top)
    cover = lambda level: F.transform(F.sequence(F.shiftright(a, level), F.shiftright(b, level)),
                                      lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))
    out = cover(CELL_LEVELS[-1])
    for level in reversed(CELL_LEVELS[:-1]):
        out = F.when(F.shiftright(b - a, level + CELL_BITS) == 0, cover(level)).otherwise(out)
    return F.when(b >= a, out).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))


def in_price_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (range_id, low, high; a null high is open, low not null) joined with the ``docs`` whose price
    lies in them. An equi-join on price cells, then the exact comparison; no range meets documents far from it."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(CELL_PARTS - 1)))
    wanted = (ranges.select("range_id", "low", "high", F.explode(range_cells(F.col("low"), F.col("high"))).alias("c"))
              .select("range_id", "low", "high", "c.level", "c.cell", parts.alias("part")))
    # every document has ten cells, but only levels in use can meet, and wide cells are dealt over parts
    cells = (docs.where("price >= 0").withColumn("c", F.explode(price_cells(F.col("price"))))
             .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(CELL_PARTS)).cast("int"))
             .select(*docs.columns, "c.level", "c.cell", "part"))
    return (cells.join(request_side(wanted), ["level", "cell", "part"])
            .where((F.col("price") >= F.col("low")) & F.coalesce(F.col("price") <= F.col("high"), F.lit(True)))
            .drop("level", "cell", "part", "low", "high"))


def _pages(hits: DataFrame, relevance: bool, deepest: int | None) -> DataFrame:
    """The page of each request: rank within the whole result. Requests that end within ``deepest`` rows are
    cut before the shuffle; the others are ranked whole."""
    w = Window.partitionBy("combo_id").orderBy(*_sort_columns(relevance))
    end = (F.col("page") + 1) * F.col("size")

    def ranked(rows: DataFrame, limit: int | None) -> DataFrame:
        out = rows.withColumn("rank", F.row_number().over(w))
        return out if limit is None else out.where(F.col("rank") <= limit)

    out = ranked(hits, None) if deepest is None else ranked(hits.where(end <= deepest), deepest).unionByName(
        ranked(hits.where(end > deepest), None))
    return (out.where((F.col("rank") > F.col("page") * F.col("size")) & (F.col("rank") <= end))
            .select("combo_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.col("score")))


def _browse(docs: DataFrame, combos: DataFrame) -> DataFrame:
    """Documents of requests with categories, each once."""
    shared = (docs.select("*", F.explode(F.array_distinct("categories")).alias("cat"))
              .join(request_side(combos.select("*", F.explode("q_categories").alias("cat"))), "cat"))
    # a document that shares several categories is taken at the first of them
    first = F.array_min(F.array_intersect("categories", "q_categories"))
    return shared.where(F.col("cat") == first).drop("cat")


def _by_range(docs: DataFrame, combos: DataFrame) -> DataFrame:
    """Documents of requests with a price range (low 0 and high open by default)."""
    low = F.coalesce("min_price", F.lit(0).cast("decimal(10,2)"))
    keyed = combos.withColumn("range_id", F.concat_ws(":", low, F.coalesce(F.col("max_price").cast("string"), F.lit("open"))))
    ranges = keyed.select("range_id", low.alias("low"), F.col("max_price").alias("high")).distinct()
    return in_price_ranges(docs, ranges).join(request_side(keyed), "range_id").drop("range_id")


def search_products(ix: Index, queries: DataFrame, price_in_browse: bool = False, deepest: int | None = None,
                    relevance: bool = False) -> DataFrame:
    """P24/P25 + T1/T3 for a batch of search requests: per request
    (query_id) the rows of its page, with ``rank`` inside the full result and ``score``.

    Dispatch: blank q with categories -> category browse (price ignored unless
    ``price_in_browse``, Q4); blank q -> price range (min default 0, max open); otherwise the main
    search X6. Identical requests are answered once (combos). Text meets the
    documents once per distinct text; browse and range requests are equi-joins on categories and
    price cells. ``relevance``: sort_by 'relevance' ranks by score (Q19); the score of the others is 0 unless set.
    ``deepest``: the deepest row that most requests ask for.
    """
    combos, qmap = _request_combos(queries)
    blank, has_cats = is_blank("q"), F.size("q_categories") > 0
    docs = ix.docs.select("doc_id", "categories", "name", "popularity_score", "created_at", "price")
    flat = lambda rows: rows.withColumn("score", F.lit(0.0))
    browse = _browse(docs, combos.where(blank & has_cats))
    if price_in_browse:
        browse = browse.where(_passes(categories=False))
    ranged = _by_range(docs, combos.where(blank & ~has_cats))
    text = combos.where(~blank)
    texts = text.select(F.col("q").alias("query_id"), "q").distinct()
    found = score_fields(ix, texts, MAIN_FIELDS, operator="and", fuzzy=True).withColumnRenamed("query_id", "q")
    matched = found.join(docs.hint("merge"), "doc_id").join(request_side(text), "q").where(_passes())
    hits = flat(browse).unionByName(flat(ranged)).unionByName(matched)
    return qmap.join(_pages(hits, relevance, deepest), "combo_id").drop("combo_id")


# --- the relational path ---------------------------------------------------------------
GRAM = 3


def _grams(text: Column, n: Column | int) -> Column:
    """Distinct substrings of ``n`` letters."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: text.substr(i, size)))).otherwise(F.array().cast("array<string>"))


def containing(docs: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """``texts`` (q) joined with the ``docs`` of which one of ``columns`` contains q, whatever the case (F1).
    A q meets only the documents that hold its rarest substring of GRAM letters (its own length, if shorter)."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    sizes = [F.explode(F.array_distinct(F.concat(*[_grams(c, n) for c in low for n in range(1, GRAM + 1)]))).alias("gram")]
    grams = docs.select("*", *sizes)
    needle = F.lower("q")
    own = _cut(texts.select("q", F.explode(_grams(needle, F.least(F.length("q"), F.lit(GRAM)))).alias("gram")))
    common = grams.select("gram").join(request_side(own.select("gram").distinct()), "gram", "left_semi")
    counts = common.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = _cut(own.join(counts, "gram").groupBy("q").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))
    found = grams.join(request_side(rarest), "gram").drop("gram")
    return found.where(reduce(lambda a, b: a | b, [F.contains(c, needle) for c in low]))


def search_relational(ix: Index, queries: DataFrame, deepest: int | None = None) -> DataFrame:
    """The same batch of requests answered without the text index, as the reference does when its search
    server is down: substring in name or description, categories, price range (J2 in set form), T1 and T3."""
    combos, qmap = _request_combos(queries)
    empty, has_cats = F.coalesce(F.length("q") == 0, F.lit(True)), F.size("q_categories") > 0
    docs = ix.docs.select("doc_id", "categories", "name", "description", "popularity_score", "created_at", "price")
    text = combos.where(~empty)
    found = containing(docs, text.select("q").distinct(), ["name", "description"]).join(request_side(text), "q")
    hits = (found.unionByName(_browse(docs, combos.where(empty & has_cats))).unionByName(_by_range(docs, combos.where(empty & ~has_cats)))
            .where(_passes()).withColumn("score", F.lit(0.0)))
    return qmap.join(_pages(hits, False, deepest), "combo_id").drop("combo_id")


def search_with_fallback(backend: str, ix: Index, queries: DataFrame, **options) -> DataFrame:
    """The reference falls back to relational queries when the search
    server fails; here the backend is an explicit choice."""
    return (search_products if backend == "text" else search_relational)(ix, queries, **options)
