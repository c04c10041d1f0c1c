"""Batch writes as set operations.

Each returns new frames instead of mutating a table: the new product table,
the outbox rows for the change (derived from the same change set, so data and
events can never disagree, H7) and the rejected requests. The caller writes
them; ids and event ids are deterministic, so a replayed batch writes the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import features as FX
from vitrine.operators import quality as Q
from vitrine.session import checkpoint_dir
from vitrine.sources import schemas as SC

JSON_OPTS = {"timestampNTZFormat": SC.JSON_TIME_FORMAT, "timestampFormat": SC.JSON_TIME_FORMAT}
PRODUCT_FIELDS = ["name", "description", "categories", "price", "sku", "attributes", "images"]


def from_create(req: DataFrame) -> DataFrame:
    """Request -> product row: SKU upper+trim (F2), counters 0, score 0.0."""
    return req.select(
        "request_id", "name", "description",
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        F.col("price").cast("decimal(10,2)").alias("price"),
        FX.normalise_sku("sku").alias("sku"),
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        F.coalesce("images", F.array().cast("array<string>")).alias("images"),
        F.lit(0).cast("bigint").alias("click_count"),
        F.lit(0).cast("bigint").alias("purchase_count"),
        F.lit(0.0).alias("popularity_score"))


def _outbox_rows(changes: DataFrame, event_type: str, payload: Column, as_of: Column,
                 id_col: Column) -> DataFrame:
    return changes.select(
        id_col.alias("id"), F.col("id").cast("string").alias("aggregate_id"),
        F.lit("Product").alias("aggregate_type"), F.lit(event_type).alias("event_type"),
        payload.alias("event_data"), as_of.alias("created_at"), F.lit(False).alias("processed"),
        F.lit(None).cast("timestamp_ntz").alias("processed_at"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("timestamp_ntz").alias("next_retry_at"),
        F.lit(None).cast("string").alias("error_message"))


def _event_id(kind: int, key: Column) -> Column:
    """Deterministic outbox id: (kind, key) packed into one long."""
    return (F.lit(kind).cast("bigint") * F.lit(10 ** 15) + key.cast("bigint"))


def create_products(P: DataFrame, req: DataFrame, as_of: Column
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validate (V1), normalise (P4), reject duplicate SKUs in the batch or
    the table (V5, on the normalised SKU, Q14), assign ids after the current
    maximum, compute F12, emit ProductCreated. Returns (P', events, rejects)."""
    checked = Q.validate_create(req)
    ok, bad = Q.split_valid(checked)
    rows = from_create(ok)
    dups = Q.duplicate_skus(rows.withColumnRenamed("sku", "sku_norm"), P)
    accepted = rows.join(dups.select("request_id"), "request_id", "left_anti")
    # identity: current max id + 1 + request_id (gaps allowed, like a sequence)
    base = F.coalesce(P.agg(F.max("id")).scalar(), F.lit(0)) + 1
    new = accepted.select(
        (base + F.col("request_id")).cast("bigint").alias("id"),
        *[F.col(c) for c in PRODUCT_FIELDS],
        as_of.alias("created_at"), as_of.alias("updated_at"), F.lit(0).cast("bigint").alias("version"),
        "click_count", "purchase_count",
        FX.popularity("click_count", "purchase_count", "entity").alias("popularity_score"))
    payload = F.to_json(F.struct(
        F.col("id").alias("productId"), "name", "description", "categories", "price", "sku",
        "attributes", "images", F.col("created_at").alias("createdAt"),
        F.lit("system").alias("createdBy")), JSON_OPTS)
    events = _outbox_rows(new, "ProductCreated", payload, as_of, _event_id(1, F.col("id")))
    rejects = (bad.select("request_id", "code", F.to_json("errors").alias("detail"))
               .unionByName(dups.select("request_id", "code", F.col("sku_norm").alias("detail"))))
    return P.unionByName(new.select(*P.columns)), events, rejects


def _newest(field: str) -> Column:
    """The field's value in the last request that gives one."""
    return F.max_by(field, F.when(F.col(field).isNotNull(), F.col("request_id")))


def _running(good: DataFrame, P: DataFrame) -> DataFrame:
    """Each accepted request with the product's row as it is after it. A
    product may have a third of the requests, so no window holds all of one:
    requests are range-partitioned by (id, request_id), a window runs within
    (id, partition), and what earlier partitions leave (at most one row per id
    and partition) is carried in."""
    spark = good.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (good.repartitionByRange(n, "id", "request_id").withColumn("_pid", F.spark_partition_id())
            .checkpoint(eager=True))                       # partition numbers stay as they are
    left = rows.groupBy("id", "_pid").agg(*[_newest(c).alias(c) for c in PRODUCT_FIELDS],
                                          F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("id", "_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
                       *[F.last(c, ignorenulls=True).over(earlier).alias(f"_{c}") for c in PRODUCT_FIELDS])
    left = left.join(P, "id").select(
        "id", "_pid", *[F.coalesce(f"_{c}", c).alias(f"_{c}") for c in PRODUCT_FIELDS],
        (F.col("version") + F.col("_n")).alias("_version"))
    here = Window.partitionBy("id", "_pid").orderBy("request_id").rowsBetween(Window.unboundedPreceding, 0)
    changed = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in PRODUCT_FIELDS]),
                       lambda x: x.isNotNull())
    return rows.join(left, ["id", "_pid"]).select(
        "id", "request_id", changed.alias("_changed"),
        *[F.coalesce(F.last(c, ignorenulls=True).over(here), f"_{c}").alias(c) for c in PRODUCT_FIELDS],
        (F.col("_version") + F.row_number().over(here)).alias("version"))


def update_products(P: DataFrame, req: DataFrame, as_of: Column
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Partial updates; a null request field keeps the old value. Requests
    of one product apply in the order of ``request_id`` (unique, not null),
    each raising the version by one and emitting ProductUpdated with the full
    row after it and the changed field names. Broken rules -> VALIDATION_ERROR;
    unknown id -> PRODUCT_NOT_FOUND; an SKU that another product had before the
    batch, or that another product asked for earlier in it ->
    PRODUCT_ALREADY_EXISTS (no check against the product itself). A rejected
    request changes nothing."""
    ok, bad = Q.split_valid(Q.validate_update(req))
    types = dict(P.dtypes)
    asked = ok.select("request_id", "id", *[
        (FX.normalise_sku("sku") if c == "sku" else F.col(c).cast(types[c])).alias(c) for c in PRODUCT_FIELDS])
    ids = P.select("id", F.lit(True).alias("_known"))
    asked = asked.join(ids, "id", "left")
    missing = asked.filter(F.col("_known").isNull()).select(
        "request_id", F.lit(Q.PRODUCT_NOT_FOUND).alias("code"), F.col("id").cast("string").alias("detail"))
    found = asked.filter(F.col("_known")).drop("_known")
    # one owner per SKU asked for: who has it, else who asks first (a min, reduced map-side)
    first = (found.filter(F.col("sku").isNotNull()).groupBy("sku")
             .agg(F.min(F.struct("request_id", "id"))["id"].alias("_first")))
    owner = (first.join(P.select("sku", F.col("id").alias("_has")), "sku", "left")
             .select("sku", F.coalesce("_has", "_first").alias("_owner")))
    found = found.join(owner, "sku", "left")
    conflict = F.coalesce(F.col("_owner") != F.col("id"), F.lit(False))
    conflicts = found.filter(conflict).select(
        "request_id", F.lit(Q.PRODUCT_ALREADY_EXISTS).alias("code"), F.col("sku").alias("detail"))
    good = found.filter(~conflict).drop("_owner")

    final = good.groupBy("id").agg(*[_newest(c).alias(f"_{c}") for c in PRODUCT_FIELDS],
                                   F.count(F.lit(1)).alias("_n"))
    touched = F.col("_n").isNotNull()
    merged = {c: F.coalesce(f"_{c}", c) for c in PRODUCT_FIELDS} | {
        "updated_at": F.when(touched, as_of).otherwise(F.col("updated_at")),
        "version": F.col("version") + F.coalesce("_n", F.lit(0)),
        "popularity_score": F.when(touched, FX.popularity("click_count", "purchase_count", "entity"))
        .otherwise(F.col("popularity_score"))}
    newP = P.join(final, "id", "left").select(*[merged.get(c, F.col(c)).alias(c) for c in P.columns])

    payload = F.to_json(F.struct(
        F.col("id").alias("productId"), *PRODUCT_FIELDS, as_of.alias("updatedAt"),
        F.lit("system").alias("updatedBy"), F.col("_changed").alias("changedFields")), JSON_OPTS)
    events = _outbox_rows(_running(good, P), "ProductUpdated", payload, as_of, _event_id(2, F.col("request_id")))
    rejects = (bad.select("request_id", "code", F.to_json("errors").alias("detail"))
               .unionByName(missing).unionByName(conflicts))
    return newP, events, rejects


def delete_products(P: DataFrame, ids: DataFrame, as_of: Column
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """D3: remove the ids; unknown ids are rejected (no event); ProductDeleted
    events carry sku and name of the removed row."""
    keys = ids.select(F.col("id").alias("_d")).distinct()
    gone = P.join(keys, P.id == keys._d, "inner").drop("_d")
    missing = keys.join(P.select(F.col("id").alias("_d")), "_d", "left_anti").select(
        F.lit(None).cast("bigint").alias("request_id"), F.lit(Q.PRODUCT_NOT_FOUND).alias("code"),
        F.col("_d").cast("string").alias("detail"))
    payload = F.to_json(F.struct(
        F.col("id").alias("productId"), "sku", "name", as_of.alias("deletedAt"),
        F.lit("system").alias("deletedBy"), F.lit("deleted").alias("reason")), JSON_OPTS)
    events = _outbox_rows(gone, "ProductDeleted", payload, as_of, _event_id(3, F.col("id")))
    return P.join(keys, P.id == keys._d, "left_anti"), events, missing


def record_purchases(P: DataFrame, purchases: DataFrame, as_of: Column
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """purchase_count += quantity (pre-aggregated per product before the
    join), popularity by F12, one ProductPurchased event of the product per
    purchase row with total = unit price x quantity (F14, Decimal). Third:
    rejected purchases, of products that do not exist."""
    q = purchases.groupBy(F.col("product_id").alias("_p")).agg(
        F.sum(F.col("quantity").cast("bigint")).alias("_q"))
    j = P.join(q, P.id == q._p, "left")
    pc = F.col("purchase_count") + F.coalesce(F.col("_q"), F.lit(0))
    newP = j.select(*[pc.alias(c) if c == "purchase_count" else
                      FX.popularity("click_count", pc, "entity").alias(c) if c == "popularity_score" else
                      F.col(c) for c in P.columns])
    known = P.select(F.col("id").alias("product_id"), F.col("sku").alias("_sku"))
    rejected = purchases.join(known, "product_id", "left_anti")
    purchases = purchases.join(known, "product_id")
    total = (F.col("unit_price") * F.col("quantity").cast("decimal(10,0)")).cast("decimal(18,2)")
    payload = F.to_json(F.struct(
        F.col("product_id").alias("productId"), F.col("_sku").alias("sku"), F.col("user_id").cast("string").alias("userId"),
        F.col("order_id").cast("string").alias("orderId"), "quantity",
        F.col("unit_price").alias("unitPrice"), total.alias("totalPrice"),
        F.col("purchased_at").alias("purchasedAt")), JSON_OPTS)
    events = purchases.select(
        (F.lit(4).cast("bigint") * F.lit(10 ** 15) + F.col("order_id") * 1000 + F.col("line_number"))
        .alias("id"), F.col("product_id").cast("string").alias("aggregate_id"),
        F.lit("Product").alias("aggregate_type"), F.lit("ProductPurchased").alias("event_type"),
        payload.alias("event_data"), as_of.alias("created_at"), F.lit(False).alias("processed"))
    return newP, events, rejected


def increment(P: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Bulk counter += number of occurrences of each id; popularity is not
    recomputed (the reference's UPDATE ... SET c = c + 1 per call)."""
    n = ids.groupBy(F.col("id").alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    j = P.join(n, P.id == n._i, "left")
    return j.select(*[(F.col(c) + F.coalesce(F.col("_n"), F.lit(0))).alias(c) if c == col
                      else F.col(c) for c in P.columns])
