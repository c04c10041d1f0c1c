"""Registered search-document queries (P3 with F5-F11, A16 facets, P11-P13, T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import catalog as C
from vitrine.operators import sync as S
from vitrine.plans import views as V
from vitrine.plans.registry import register


def documents(spark, sf):
    return S.full_sync(V.product(spark, sf), V.as_of())


@register("document_build", """
SELECT id, product_id, all_text, array_to_string(list_sort(tags), '|') AS tags, in_stock,
       price_range, round(score_boost, 4) AS score_boost
FROM doc_v""", ("doc_v",))
def q_document_build(spark, sf):
    d = documents(spark, sf)
    return d.select("id", "product_id", "all_text",
                    F.array_join(F.array_sort("tags"), "|").alias("tags"), "in_stock",
                    "price_range", F.round("score_boost", 4).alias("score_boost"))


@register("facets", """
SELECT 'price_range' AS facet, price_range AS value, count(*) AS doc_count FROM doc_v GROUP BY 2
UNION ALL SELECT 'in_stock', CAST(in_stock AS VARCHAR), count(*) FROM doc_v GROUP BY 2
UNION ALL SELECT 'tags', t, count(*) FROM (SELECT unnest(tags) AS t FROM doc_v) GROUP BY 2
UNION ALL SELECT 'categories', c, count(*) FROM (SELECT unnest(categories) AS c FROM doc_v) GROUP BY 2""",
          ("doc_v",))
def q_facets(spark, sf):
    d = documents(spark, sf)
    out = None
    for f in ("price_range", "in_stock", "tags", "categories"):
        x = C.facets(d, f).select("facet", F.col("value").cast("string").alias("value"), "doc_count")
        out = x if out is None else out.unionByName(x)
    return out


@register("in_categories", "SELECT id FROM doc_v WHERE list_has_any(categories, ['LARGE', 'Brand#3'])",
          ("doc_v",))
def q_in_categories(spark, sf):
    return C.in_categories(documents(spark, sf), ["LARGE", "Brand#3"]).select("id")


@register("in_tags", "SELECT id FROM doc_v WHERE list_has_any(tags, ['premium', 'budget'])", ("doc_v",))
def q_in_tags(spark, sf):
    return C.in_tags(documents(spark, sf), ["premium", "budget"]).select("id")


@register("recent_products", f"""
SELECT id, created_at FROM doc_v WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY""",
          ("doc_v",))
def q_recent_products(spark, sf):
    return C.recent_products(documents(spark, sf), V.as_of(), 30).select("id", "created_at")


@register("popular_products", """
SELECT product_id, popularity_score FROM doc_v WHERE popularity_score > 10.0
ORDER BY popularity_score DESC, product_id ASC LIMIT 20""", ("doc_v",))
def q_popular_products(spark, sf):
    d = documents(spark, sf).withColumn("id", F.col("product_id"))
    return C.popular_products(d, 20, 10.0).select("product_id", "popularity_score")
