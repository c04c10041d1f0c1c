"""Catalogue queries as set operations over the product frame ``P``.

Point lookups of the reference become joins against a key frame; optional
request parameters become predicates built only from the parameters given, so
Catalyst sees plain filters it can push into the parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUBLIC_COLUMNS = ["id", "name", "description", "categories", "price", "sku", "attributes",
                  "images", "created_at", "updated_at", "click_count", "purchase_count",
                  "popularity_score"]

# Sort fields accepted by the search API (case-insensitive) and
# the column each maps to.
SEARCH_SORT_FIELDS = {"name": "name", "price": "price", "createdat": "created_at",
                      "popularityscore": "popularity_score"}


# projections -----------------------------------------------------------------
def to_dto(P: DataFrame) -> DataFrame:
    """The 13-column public row."""
    return P.select(*PUBLIC_COLUMNS)


def document_to_dto(D: DataFrame) -> DataFrame:
    """Search document -> public row; derived columns dropped, id := productId."""
    return D.select(F.col("product_id").alias("id"), *[c for c in PUBLIC_COLUMNS if c != "id"])


# predicates ------------------------------------------------------------------
def is_available(price: Column) -> Column:
    """Price present and positive."""
    return F.coalesce(price > 0, F.lit(False))


def contains_ci(col: Column, q: str, raw_like: bool = False) -> Column:
    """case-insensitive substring test. ``%``/``_`` are literal unless
    ``raw_like`` (the reference passes them through as LIKE wildcards)."""
    if raw_like:
        return F.lower(col).like(f"%{q.lower()}%")
    return F.lower(col).contains(q.lower())


def search_text(P: DataFrame, q: str, raw_like: bool = False) -> DataFrame:
    """Substring in name OR description; a null description is no match."""
    return P.filter(contains_ci(F.col("name"), q, raw_like)
                    | F.coalesce(contains_ci(F.col("description"), q, raw_like), F.lit(False)))


def price_between(P: DataFrame, lo, hi) -> DataFrame:
    """Both ends inclusive; pushed to the scan as two range filters."""
    return P.filter(F.col("price").between(F.lit(lo).cast("decimal(10,2)"),
                                           F.lit(hi).cast("decimal(10,2)")))


def popular_above(P: DataFrame, threshold: float) -> DataFrame:
    """P10: popularity strictly above the threshold."""
    return P.filter(F.col("popularity_score") > F.lit(float(threshold)))


def _str_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def in_categories(D: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Any of the categories."""
    return D.filter(F.arrays_overlap("categories", _str_array(cats)))


def in_tags(D: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Any of the tags."""
    return D.filter(F.arrays_overlap("tags", _str_array(tags)))


def recent_products(D: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Created within ``days`` of ``as_of`` (F21), newest first."""
    return (D.filter(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
            .orderBy(F.col("created_at").desc(), F.col("id").asc()))


def search_with_filters(P: DataFrame, q: str | None = None, cats: Sequence[str] | None = None,
                        lo=None, hi=None, mode: str = "set", raw_like: bool = False) -> DataFrame:
    """Optional-parameter conjunction; a None parameter drops its term.

    ``mode="set"``: one row per product. ``mode="bag"``: the reference's left
    join over categories, one row per (matching) category and one row with a
    null category for a product without any (then ``category`` is added).
    """
    out = P
    if q is not None:
        out = out.filter(contains_ci(F.col("name"), q, raw_like)
                         | F.coalesce(contains_ci(F.col("description"), q, raw_like), F.lit(False)))
    if lo is not None:
        out = out.filter(F.col("price") >= F.lit(lo).cast("decimal(10,2)"))
    if hi is not None:
        out = out.filter(F.col("price") <= F.lit(hi).cast("decimal(10,2)"))
    if mode == "bag":
        out = out.withColumn("category", F.explode_outer("categories"))
        if cats is not None:
            out = out.filter(F.col("category").isin(list(cats)))
        return out
    if cats is not None:
        out = out.filter(F.arrays_overlap("categories", _str_array(cats)))
    return out


# joins -----------------------------------------------------------------------
def by_categories(P: DataFrame, cats: Sequence[str], mode: str = "bag") -> DataFrame:
    """Inner join product x category then IN filter.
    bag: one row per matching category (column ``category``); set: one per product."""
    if mode == "bag":
        return (P.withColumn("category", F.explode("categories"))
                .filter(F.col("category").isin(list(cats))))
    return P.filter(F.arrays_overlap("categories", _str_array(cats)))


def lookup_by_id(P: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """P5: rows for a batch of ids (an equi-join; AQE broadcasts a small key side
    from its measured size)."""
    return P.join(keys.select(F.col(key).alias("id")).distinct(), "id")


def lookup_by_sku(P: DataFrame, skus: DataFrame, key: str = "sku") -> DataFrame:
    """Rows for a batch of SKUs."""
    return P.join(skus.select(F.col(key).alias("sku")).distinct(), "sku")


def exists_by_sku(keys: DataFrame, P: DataFrame, key: str = "sku") -> DataFrame:
    """The keys that exist (semi join)."""
    return keys.join(P.select(F.col("sku").alias(key)), key, "left_semi")


def missing_ids(keys: DataFrame, P: DataFrame, key: str = "id") -> DataFrame:
    """The keys that do not exist (anti join)."""
    return keys.join(P.select(F.col("id").alias(key)), key, "left_anti")


def with_categories(P: DataFrame, cats: DataFrame) -> DataFrame:
    """Left fetch join of the category side table, one row per product."""
    grouped = cats.groupBy("product_id").agg(
        F.array_sort(F.collect_list("category")).alias("categories"))
    return (P.drop("categories").join(grouped, P.id == grouped.product_id, "left")
            .drop("product_id")
            .withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))))


def related_by_category(P: DataFrame, seeds: DataFrame, n: int, mode: str = "set") -> DataFrame:
    """For each seed, the first ``n`` other products sharing a category,
    ordered by popularity desc, purchases desc, id asc.

    No pair enumeration: a product can only be in a seed's answer if it is in
    the first n+1 of one of the seed's categories (n+1 because the seed itself
    may take a slot), so each category keeps its n+1 best (a partial top-k
    before the shuffle), and each seed joins only those few candidates.
    ``mode="bag"`` keeps one row per shared category (the reference's join).
    Output: seed_id, id, rank, plus the candidate's ordering columns.
    """
    order = [F.col("popularity_score").desc(), F.col("purchase_count").desc(), F.col("id").asc()]
    per_cat = (P.select("id", "popularity_score", "purchase_count",
                        F.explode("categories").alias("category"))
               .dropDuplicates(["id", "category"]))
    w = Window.partitionBy("category").orderBy(*order)
    best = per_cat.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n + 1).drop("_r")
    seed_cats = (seeds.select(F.col("id").alias("seed_id"), F.explode("categories").alias("category"))
                 .dropDuplicates(["seed_id", "category"]))
    cand = seed_cats.join(best, "category").filter(F.col("id") != F.col("seed_id"))
    if mode == "set":
        cand = cand.groupBy("seed_id", "id").agg(
            F.first("popularity_score").alias("popularity_score"),
            F.first("purchase_count").alias("purchase_count"))
        ws = Window.partitionBy("seed_id").orderBy(*order)
    else:
        ws = Window.partitionBy("seed_id").orderBy(*order, F.col("category").asc())
    return (cand.withColumn("rank", F.row_number().over(ws)).filter(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("bigint")))


# sorts and pages ---------------------------------------------------------------
def search_sort_columns(by: str | None, direction: str | None) -> list[Column]:
    """Sort of the search API. Unknown field -> popularity desc, created desc.
    Ties are broken by id so results are deterministic."""
    col = SEARCH_SORT_FIELDS.get((by or "").lower())
    if col is None:
        return [F.col("popularity_score").desc(), F.col("created_at").desc(), F.col("id").asc()]
    c = F.col(col)
    c = c.asc() if (direction or "").lower() == "asc" else c.desc()
    return [c, F.col("id").asc()]


def list_sort_columns(P: DataFrame, by: str | None = None, direction: str = "desc") -> list[Column]:
    """List sort by any public column (allow-list), default created_at desc."""
    allowed = {c.lower(): c for c in P.columns}
    key = (by or "created_at").replace("At", "_at").lower()
    col = allowed.get(key) or allowed.get((by or "").lower()) or "created_at"
    c = F.col(col)
    return [c.asc() if direction.lower() == "asc" else c.desc(), F.col("id").asc()]


def page(df: DataFrame, order: list[Column], page_no: int, size: int,
         cap: int | None = None) -> DataFrame:
    """Rows of one page (offset = page x size). Spark plans this as a
    per-partition top-(offset+size) and a final merge, never a full sort."""
    if page_no < 0 or size < 1:
        raise ValueError("page must be >= 0 and size >= 1")
    if cap is not None and page_no * size + size > cap:
        raise ValueError(f"result window is too large: from + size must be <= {cap}")
    return df.orderBy(*order).offset(page_no * size).limit(size)


def page_meta(df: DataFrame, page_no: int, size: int) -> DataFrame:
    """T3 metadata, one row: total_elements, total_pages = ceil, first, last,
    has_next, has_previous (Spring Page semantics)."""
    total = F.count(F.lit(1))
    m = df.agg(total.alias("total_elements"))
    tp = F.ceil(F.col("total_elements") / F.lit(size)).cast("bigint")
    return m.select(
        F.lit(page_no).alias("page"), F.lit(size).alias("size"), "total_elements",
        tp.alias("total_pages"),
        F.lit(page_no == 0).alias("first"),
        (F.lit(page_no + 1) >= tp).alias("last"),
        (F.lit(page_no + 1) < tp).alias("has_next"),
        F.lit(page_no > 0).alias("has_previous"))


def top_by_popularity(P: DataFrame, n: int) -> DataFrame:
    """T4: first n by popularity desc, purchases desc (id breaks ties)."""
    return P.orderBy(F.col("popularity_score").desc(), F.col("purchase_count").desc(),
                     F.col("id").asc()).limit(n)


def popular_by_update(P: DataFrame, threshold: float) -> DataFrame:
    """T5: popularity above threshold, newest update first."""
    return popular_above(P, threshold).orderBy(F.col("updated_at").desc(), F.col("id").asc())


def popular_products(D: DataFrame, n: int, threshold: float = 10.0) -> DataFrame:
    """Score > threshold, first n. The reference gives no order; we use
    popularity desc, id asc for determinism."""
    return (popular_above(D, threshold)
            .orderBy(F.col("popularity_score").desc(), F.col("id").asc()).limit(n))


def limit_then_distinct(df: DataFrame, col: str, n: int) -> DataFrame:
    """The suggest tail: limit first, then distinct values (may be < n)."""
    return df.limit(n).select(col).distinct()


def top_n_per(df: DataFrame, key: str | list[str], order: list[Column], n: int,
              rank_col: str = "rank") -> DataFrame:
    """First n rows per key. ``row_number() <= n`` lets Catalyst insert a
    partial WindowGroupLimit before the shuffle, so a hot key ships at most n
    rows per map task."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


# aggregates ------------------------------------------------------------------
def count_by_category(P: DataFrame) -> DataFrame:
    """A1: products per category (explode + partial/final hash aggregate)."""
    return (P.select(F.explode("categories").alias("category"))
            .groupBy("category").agg(F.count(F.lit(1)).alias("product_count")))


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    """A4: a one-row count."""
    return df.agg(F.count(F.lit(1)).alias(name))


def facets(D: DataFrame, field: str) -> DataFrame:
    """Facet counts; array fields (tags, categories) are exploded."""
    dtype = dict(D.dtypes)[field]
    col = F.explode(field) if dtype.startswith("array") else F.col(field)
    return (D.select(col.alias("value")).groupBy("value")
            .agg(F.count(F.lit(1)).alias("doc_count"))
            .withColumn("facet", F.lit(field)))


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """DISTINCT."""
    return df.select(*cols).distinct()


def realtime_views(events: DataFrame) -> DataFrame:
    """Real-time view filter (user known and not 'anonymous') and the
    ProductViewed event it emits, with metadata event_source and
    view_increment = 1."""
    u = F.col("user_id").cast("string")
    return (events.filter(u.isNotNull() & (u != "anonymous"))
            .select(F.col("product_id").alias("productId"), u.alias("userId"),
                    F.col("ts").alias("viewedAt"),
                    F.create_map(F.lit("event_source"), F.lit("realtime"),
                                 F.lit("view_increment"), F.lit("1")).alias("metadata")))
