"""Registered catalogue queries (S1, P*, J*, T*, A1/A4/A16/A17, W2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import catalog as C
from vitrine.plans import views as V
from vitrine.plans.registry import joined, money, register

PRODUCT_OUT = ["id", "name", "price", "sku", "popularity_score", "created_at", "categories"]


def _product_out(df, extra=()):
    return df.select("id", "name", money("price").alias("price"), "sku", "popularity_score",
                     "created_at", joined("categories").alias("categories"), *extra)


SQL_PRODUCT_OUT = ("id, name, CAST(price AS DOUBLE) AS price, sku, popularity_score, created_at, "
                   "array_to_string(categories, '|') AS categories")

# --- minimum slice: P8/J2 (set) -> T1 -> T3 -------------------------------------
SEARCH_ARGS = dict(q="widget", cats=["ECONOMY", "PROMO", "SMALL"], lo=50, hi=300)


@register("search_with_filters", f"""
SELECT {SQL_PRODUCT_OUT} FROM product_v
WHERE (contains(lower(name), 'widget') OR coalesce(contains(lower(description), 'widget'), false))
  AND price >= 50 AND price <= 300
  AND list_has_any(categories, ['ECONOMY', 'PROMO', 'SMALL'])
ORDER BY price ASC, id ASC LIMIT 10 OFFSET 10""", ("product_v",))
def q_search_with_filters(spark, sf):
    hits = C.search_with_filters(V.product(spark, sf), **SEARCH_ARGS)
    return _product_out(C.page(hits, C.search_sort_columns("price", "asc"), 1, 10))


@register("search_page_meta", """
SELECT 1 AS page, 10 AS size, count(*) AS total_elements,
       CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages, false AS first,
       (2 >= CAST(ceil(count(*) / 10) AS BIGINT)) AS last,
       (2 < CAST(ceil(count(*) / 10) AS BIGINT)) AS has_next, true AS has_previous
FROM product_v
WHERE (contains(lower(name), 'widget') OR coalesce(contains(lower(description), 'widget'), false))
  AND price >= 50 AND price <= 300
  AND list_has_any(categories, ['ECONOMY', 'PROMO', 'SMALL'])""", ("product_v",))
def q_search_page_meta(spark, sf):
    return C.page_meta(C.search_with_filters(V.product(spark, sf), **SEARCH_ARGS), 1, 10)


ATTR_TEXT_SQL = ("array_to_string(list_transform(list_sort(map_keys(attributes)), "
                 "lambda k: k || '=' || attributes[k]), ';')")


def attr_text(col="attributes"):
    m = F.col(col)
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)),
                                    lambda k: F.concat(k, F.lit("="), m[k])), ";")


@register("scan_products", f"""
SELECT id, name, description, array_to_string(categories, '|') AS categories,
       CAST(price AS DOUBLE) AS price, sku, {ATTR_TEXT_SQL} AS attributes,
       array_to_string(images, '|') AS images, created_at, updated_at, click_count,
       purchase_count, popularity_score
FROM product_v""", ("product_v",))
def q_scan_products(spark, sf):
    d = C.to_dto(V.product(spark, sf))
    return d.select("id", "name", "description", joined("categories").alias("categories"),
                    money("price").alias("price"), "sku", attr_text().alias("attributes"),
                    joined("images").alias("images"), "created_at", "updated_at",
                    "click_count", "purchase_count", "popularity_score")


@register("search_text", """
SELECT id, name, sku FROM product_v
WHERE contains(lower(name), 'gear') OR coalesce(contains(lower(description), 'gear'), false)""",
          ("product_v",))
def q_search_text(spark, sf):
    return C.search_text(V.product(spark, sf), "Gear").select("id", "name", "sku")


@register("price_between", """
SELECT id, CAST(price AS DOUBLE) AS price FROM product_v WHERE price BETWEEN 100 AND 200""",
          ("product_v",))
def q_price_between(spark, sf):
    return C.price_between(V.product(spark, sf), 100, 200).select("id", money("price").alias("price"))


@register("popular_by_update", """
SELECT id, popularity_score, updated_at FROM product_v WHERE popularity_score > 600""",
          ("product_v",))
def q_popular_by_update(spark, sf):
    return C.popular_by_update(V.product(spark, sf), 600.0).select(
        "id", "popularity_score", "updated_at")


@register("top_by_popularity", """
SELECT id, popularity_score, purchase_count FROM product_v
ORDER BY popularity_score DESC, purchase_count DESC, id ASC LIMIT 20""", ("product_v",))
def q_top_by_popularity(spark, sf):
    return C.top_by_popularity(V.product(spark, sf), 20).select(
        "id", "popularity_score", "purchase_count")


@register("count_by_category", """
SELECT c AS category, count(*) AS product_count FROM (SELECT unnest(categories) AS c FROM product_v)
GROUP BY c""", ("product_v",))
def q_count_by_category(spark, sf):
    return C.count_by_category(V.product(spark, sf))


@register("by_categories_bag", """
SELECT id, c AS category FROM (SELECT id, unnest(categories) AS c FROM product_v)
WHERE c IN ('PROMO', 'Brand#7')""", ("product_v",))
def q_by_categories_bag(spark, sf):
    return C.by_categories(V.product(spark, sf), ["PROMO", "Brand#7"], "bag").select("id", "category")


@register("search_with_filters_bag", """
SELECT id, c AS category FROM (SELECT id, name, description, price, unnest(categories) AS c FROM product_v)
WHERE (contains(lower(name), 'bolt') OR coalesce(contains(lower(description), 'bolt'), false))
  AND price >= 20 AND price <= 400""", ("product_v",))
def q_search_with_filters_bag(spark, sf):
    return C.search_with_filters(V.product(spark, sf), q="bolt", lo=20, hi=400,
                                 mode="bag").select("id", "category")


@register("lookup_by_id", f"""
SELECT {SQL_PRODUCT_OUT} FROM product_v
WHERE id IN (SELECT product_id FROM views_v)""", ("product_v", "views_v"))
def q_lookup_by_id(spark, sf):
    keys = V.views(spark, sf).select(F.col("product_id").alias("id"))
    return _product_out(C.lookup_by_id(V.product(spark, sf), keys))


RELATED_SQL = """
, seeds AS (SELECT * FROM product_v WHERE id IN (SELECT product_id FROM views_v)),
cand AS (
  SELECT DISTINCT s.id AS seed_id, p.id, p.popularity_score, p.purchase_count
  FROM seeds s, product_v p
  WHERE p.id <> s.id AND list_has_any(p.categories, s.categories)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY seed_id
            ORDER BY popularity_score DESC, purchase_count DESC, id ASC) AS rank FROM cand)
SELECT seed_id, id, rank, popularity_score FROM ranked WHERE rank <= 5"""


@register("related_by_category", RELATED_SQL, ("product_v", "views_v"))
def q_related_by_category(spark, sf):
    P = V.product(spark, sf)
    seeds = C.lookup_by_id(P, V.views(spark, sf).select(F.col("product_id").alias("id")))
    return C.related_by_category(P, seeds, 5).select("seed_id", "id", "rank", "popularity_score")


@register("list_products", """
SELECT id, CAST(price AS DOUBLE) AS price FROM product_v ORDER BY price DESC, id ASC LIMIT 25""",
          ("product_v",))
def q_list_products(spark, sf):
    P = V.product(spark, sf)
    return C.page(P, C.list_sort_columns(P, "price", "desc"), 0, 25).select(
        "id", money("price").alias("price"))


@register("product_count", "SELECT count(*) AS row_count FROM part")
def q_product_count(spark, sf):
    return C.row_count(V.product(spark, sf))


@register("realtime_views", """
SELECT product_id AS "productId", CAST(user_id AS VARCHAR) AS "userId", ts AS "viewedAt",
       '1' AS view_increment, 'realtime' AS event_source
FROM views_v""", ("views_v",))
def q_realtime_views(spark, sf):
    r = C.realtime_views(V.views(spark, sf))
    return r.select("productId", "userId", "viewedAt",
                    F.col("metadata")["view_increment"].alias("view_increment"),
                    F.col("metadata")["event_source"].alias("event_source"))


@register("assemble_roundtrip", f"""
SELECT id, name, description, array_to_string(categories, '|') AS categories,
       CAST(price AS DOUBLE) AS price, sku, {ATTR_TEXT_SQL} AS attributes,
       array_to_string(images, '|') AS images, created_at, updated_at, click_count,
       purchase_count, popularity_score
FROM product_v""", ("product_v",))
def q_assemble_roundtrip(spark, sf):
    """The catalogue flattened into its three side tables and assembled
    back into nested rows."""
    from vitrine.sources import tables as T
    base, cats, attrs, imgs = T.flatten(V.product(spark, sf))
    d = C.to_dto(T.assemble(base, cats, attrs, imgs))
    return d.select("id", "name", "description", joined("categories").alias("categories"),
                    money("price").alias("price"), "sku", attr_text().alias("attributes"),
                    joined("images").alias("images"), "created_at", "updated_at",
                    "click_count", "purchase_count", "popularity_score")


@register("serialize_products", """
SELECT '{"id":' || CAST(id AS VARCHAR) || ',"sku":"' || sku || '","createdAt":"'
       || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}' AS payload FROM product_v""", ("product_v",))
def q_serialize_products(spark, sf):
    """Rows -> JSON payload text."""
    from vitrine.sources import tables as T
    return T.serialize(V.product(spark, sf), ["id", "sku", F.col("created_at").alias("createdAt")])
