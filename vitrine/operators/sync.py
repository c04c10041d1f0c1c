"""Source -> search-document synchronisation.

P3 document build, ST14 full backfill, ST15 targeted resync, J7 reconcile,
SET1 drift diff, A5 sync stats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import features as FX

DOCUMENT_COLUMNS = ["id", "product_id", "name", "description", "categories", "price", "sku",
                    "attributes", "images", "created_at", "updated_at", "click_count",
                    "purchase_count", "popularity_score", "all_text", "tags", "in_stock",
                    "price_range", "score_boost"]
# columns that carry content (the rest are derived from them or are the key)
CONTENT_COLUMNS = ["name", "description", "categories", "price", "sku", "attributes", "images",
                   "created_at", "updated_at", "click_count", "purchase_count",
                   "popularity_score"]


def to_document(P: DataFrame, as_of: Column) -> DataFrame:
    """Product -> 19-column search document, one narrow projection
    (document id = product id as text, F4)."""
    return P.select(
        F.col("id").cast("string").alias("id"),
        F.col("id").alias("product_id"),
        "name", "description", "categories", "price", "sku", "attributes", "images",
        "created_at", "updated_at", "click_count", "purchase_count", "popularity_score",
        FX.all_text("name", "description", "sku", "categories", "attributes").alias("all_text"),
        FX.tags("categories", "price", "popularity_score", "purchase_count").alias("tags"),
        FX.is_available("price").alias("in_stock"),
        FX.price_range("price").alias("price_range"),
        FX.score_boost("popularity_score", "created_at", "images", as_of).alias("score_boost"),
    )


def full_sync(P: DataFrame, as_of: Column) -> DataFrame:
    """ST14: every product -> document; the caller overwrites the index with it
    in one write (no paging loop)."""
    return to_document(P, as_of)


def content_hash(df: DataFrame, key: str) -> DataFrame:
    """Key + a 64-bit hash of the content columns (map entries sorted by key)."""
    cols = []
    for c in CONTENT_COLUMNS:
        if c == "attributes":
            cols.append(F.array_sort(F.map_entries(F.col(c))))
        else:
            cols.append(F.col(c))
    # the hash skips nulls, so their places are hashed, too
    return df.select(F.col(key).alias("id"), F.xxhash64(*cols, *[c.isNull() for c in cols]).alias("h"))


def reconcile(P: DataFrame, D: DataFrame) -> DataFrame:
    """Full outer join of source and index by id -> one action per id:
    insert (source only), delete (index only), update (content differs),
    noop (equal)."""
    s = content_hash(P, "id").withColumnRenamed("h", "src_h")
    d = content_hash(D, "product_id").withColumnRenamed("h", "idx_h")
    j = s.join(d, "id", "full_outer")
    action = (F.when(F.col("idx_h").isNull(), "insert").when(F.col("src_h").isNull(), "delete")
              .when(F.col("src_h") != F.col("idx_h"), "update").otherwise("noop"))
    return j.select("id", action.alias("action"))


def sync_ids(P: DataFrame, D: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """ST15: targeted resync. Present in source -> upsert the rebuilt document;
    absent -> delete. Returns the new index."""
    keys = ids.select(F.col("id").alias("product_id")).distinct()
    fresh = to_document(P.join(keys.withColumnRenamed("product_id", "id"), "id", "left_semi"), as_of)
    kept = D.join(keys, "product_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def sync_diff(P: DataFrame, D: DataFrame) -> DataFrame:
    """SET1: ids missing from the index, orphaned in the index, and differing in
    content; one row per id with its kind."""
    r = reconcile(P, D).filter(F.col("action") != "noop")
    kind = (F.when(F.col("action") == "insert", "missing")
            .when(F.col("action") == "delete", "orphaned").otherwise("differs"))
    return r.select("id", kind.alias("kind"))


def sync_stats(P: DataFrame, D: DataFrame) -> DataFrame:
    """A5: source count, index count, equal? One aggregate over the tagged union
    of both key columns (partial counts per task, no join)."""
    u = (P.select(F.lit(1).alias("s"), F.lit(0).alias("i"))
         .unionByName(D.select(F.lit(0).alias("s"), F.lit(1).alias("i"))))
    return (u.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("source_count"),
                  F.coalesce(F.sum("i"), F.lit(0)).cast("bigint").alias("index_count"))
            .withColumn("in_sync", F.col("source_count") == F.col("index_count")))
