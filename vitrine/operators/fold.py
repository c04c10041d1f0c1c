"""Fold product events into the search read model, as set operations.

ST5/S5 parse, ST6 idempotency, W3 latest lifecycle event, ST9 fold,
ST11/J8 metric application, A10-A13 view / purchase / popularity roll-ups.

The reference applies events one at a time. Here the final state of every
product is a formula over its offset-ordered events (see ``fold_events``),
computed with partial aggregates grouped by product, so a hot product costs
one partial row per map task instead of one long sequential task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import features as FX
from vitrine.functions import messaging as MX
from vitrine.operators.joins import salted
from vitrine.session import scratch_path
from vitrine.sources import schemas as SC

LIFECYCLE = ["ProductCreated", "ProductUpdated", "ProductDeleted"]
METRIC = ["ProductViewed", "ProductPurchased"]
CORRUPT = "_corrupt"
JSON_OPTS = {"timestampNTZFormat": SC.JSON_TIME_FORMAT, "timestampFormat": SC.JSON_TIME_FORMAT}


def dedupe(M: DataFrame, key: str = "idempotency-key") -> DataFrame:
    """ST6: keep the first delivery (lowest offset) of each idempotency key.
    A min_by aggregate, so duplicates of a hot key are reduced map-side."""
    k = F.coalesce(F.col("headers")[key], F.col("id"))
    cols = [c for c in M.columns]
    first = (M.withColumn("_k", k).groupBy("_k")
             .agg(F.min_by(F.struct(*cols), F.col("offset")).alias("_m")))
    return first.select("_m.*")


def parse_events(M: DataFrame) -> DataFrame:
    """JSON payload -> typed columns (one union schema for all six types).
    ``product_id``: payload productId for lifecycle events, the aggregate-id
    header (try_cast; 'product-7' -> null, Q15) for metric events.
    ``corrupt``: the payload does not parse, or a lifecycle event names no
    product; ``corrupt_events`` lists these, and no document comes of them."""
    schema = T.StructType([*SC.EVENT_UNION.fields, T.StructField(CORRUPT, T.StringType())])
    ev = F.from_json("payload", schema, JSON_OPTS | {"columnNameOfCorruptRecord": CORRUPT})
    hdr_id = F.expr("try_cast(try_element_at(headers, 'aggregate-id') AS BIGINT)")
    is_life = F.col("event_type").isin(LIFECYCLE)
    return (M.withColumn("ev", ev)
            .withColumn("product_id", F.when(is_life, F.col("ev.productId")).otherwise(hdr_id))
            .withColumn("corrupt", F.col("ev").isNull() | F.col(f"ev.{CORRUPT}").isNotNull()
                        | (is_life & F.col("product_id").isNull())))


def corrupt_events(M: DataFrame) -> DataFrame:
    """S5 error output: (id, offset, event_type, payload) of messages that
    cannot be read."""
    return parse_events(M).filter("corrupt").select("id", "offset", "event_type", "payload")


def _total_views() -> Column:
    """The absolute view count (metadata total_views) that a view event gives; bad -> null."""
    return F.when(F.col("event_type") == "ProductViewed",
                  F.expr("try_cast(try_element_at(ev.metadata, 'total_views') AS BIGINT)"))


def metric_increments(E: DataFrame) -> DataFrame:
    """ST11/F17: per metric event, the absolute view count (total_views) or else
    the view increment (metadata view_increment, bad or missing -> 1), the
    absolute popularity_score if given, and the purchase increment
    (purchase_increment, else quantity, else 1)."""
    view_inc = F.coalesce(F.expr("try_cast(try_element_at(ev.metadata, 'view_increment') AS BIGINT)"),
                          F.lit(1).cast("bigint"))
    pop = F.expr("try_cast(try_element_at(ev.metadata, 'popularity_score') AS DOUBLE)")
    buy_inc = F.coalesce(F.expr("try_cast(try_element_at(ev.metadata, 'purchase_increment') AS BIGINT)"),
                         F.col("ev.quantity").cast("bigint"), F.lit(1).cast("bigint"))
    is_view = F.col("event_type") == "ProductViewed"
    return E.select(
        "product_id", "offset", "event_type", _total_views().alias("total"),
        F.when(is_view & _total_views().isNull(), view_inc).alias("view_inc"),
        F.when(~is_view, buy_inc).alias("buy_inc"),
        F.when(is_view, pop).alias("pop_set"))


def _is_life() -> Column:
    return F.col("event_type").isin(LIFECYCLE) & ~F.col("corrupt")


def last_positions(E: DataFrame, mode: str = "replace") -> DataFrame:
    """W3 without the event itself, as numbers that add up in a hash aggregate: per product, offset ``l_off`` and type
    ``l_type`` of its last lifecycle event, where counters restart (``counter_from``), and the
    last absolute view count (``set_to`` at offset ``set_off``) if any.
    ``merge`` mode: counters restart at the last Created/Deleted."""
    rows = (E.withColumn("_life", _is_life())
            .withColumn("_total", _total_views()).filter(F.col("_life") | F.col("_total").isNotNull()))
    life = rows.filter("_life")
    at = F.when(F.col("_life"), F.col("offset"))
    set_at = F.when(F.col("_total").isNotNull(), F.col("offset"))
    kind = reduce(lambda c, k: c.when(F.col("event_type") == k[1], k[0]), enumerate(LIFECYCLE), F.when(F.lit(False), -1))
    aggs = [F.max_by(kind, at).alias("_kind"), F.max(at).alias("l_off"), F.max(set_at).alias("set_off"), F.max_by("_total", set_at).alias("set_to")]
    l_type = F.element_at(F.array(*map(F.lit, LIFECYCLE)), F.col("_kind") + 1).alias("l_type")
    if mode != "merge":
        return (rows.groupBy("product_id").agg(*aggs).filter(F.col("l_off").isNotNull())
                .select("product_id", "l_off", l_type, "set_off", "set_to", F.col("l_off").alias("counter_from")))
    # merge: counters live as long as the document: from the last Created, or
    # from the first lifecycle event after the last Deleted, whichever is later
    t = F.col("event_type")
    aggs += [F.max(F.when(t == "ProductDeleted", at)).alias("_last_del"),
             F.max(F.when(t == "ProductCreated", at)).alias("_last_cr")]
    out = rows.groupBy("product_id").agg(*aggs).filter(F.col("l_off").isNotNull())
    first_after = (life.select("product_id", "offset")
                   .join(out.select("product_id", "_last_del"), "product_id")
                   .filter(F.col("offset") > F.coalesce(F.col("_last_del"), F.lit(-1)))
                   .groupBy("product_id").agg(F.min("offset").alias("_first_after")))
    counter_from = F.greatest(F.coalesce("_last_cr", F.lit(-1)), F.coalesce("_first_after", F.lit(-1)))
    return (out.join(first_after, "product_id", "left")
            .select("product_id", "l_off", l_type, "set_off", "set_to", counter_from.alias("counter_from")))


def latest_lifecycle(E: DataFrame, mode: str = "replace") -> DataFrame:
    """``last_positions`` and, as ``L``, the last lifecycle event itself (offset, event_type, ev): the one at that
    offset, so only numbers are aggregated. ``offset`` must tell the events of a product apart."""
    life = E.filter(_is_life()).select("product_id", F.col("offset").alias("l_off"), F.struct("offset", "event_type", "ev").alias("L"))
    return last_positions(E, mode).join(life, ["product_id", "l_off"])


def parsed_once(M: DataFrame) -> DataFrame:
    """``parse_events`` as a table in the shared folder: every payload is parsed once, and each
    reader takes the fields it needs."""
    path = scratch_path(M.sparkSession, "parsed-events")
    E = parse_events(M).drop("payload", "headers")
    E.write.option("compression", "zstd").parquet(path)
    return M.sparkSession.read.schema(E.schema).parquet(path)


def fold_events(M: DataFrame, mode: str = "replace", dedup: bool = True) -> tuple[DataFrame, DataFrame]:
    """ST9: final search documents from a product-event topic; returns
    (documents, dropped metric events).

    Per product, with L = its last Created/Updated/Deleted (by offset):
      no L or L is Deleted      -> no document;
      document body             -> L's payload (F6 text, F8 band, F10 tags);
      clicks / purchases        -> sum of increments after L, added to 0 after
                                   Created, to null after Updated (a counter
                                   without events after an Updated stays null);
                                   an absolute view count restarts the clicks;
      popularity                -> popularity_score of the last metric event
                                   after L if it carries one, else F13 of the
                                   counters when any metric event follows L,
                                   else 0.0 after Created / null after Updated.
    ``mode="merge"`` keeps counters across Updated (they restart only at the
    last Created/Deleted). The second frame lists metric events after a
    product's last lifecycle event that find no live document (deleted or
    never created) and events whose product id is unreadable; metric events
    before the last lifecycle event are superseded by it and not listed.
    The parsed events are written before they are read for both.
    """
    return fold_parsed(parsed_once(dedupe(M) if dedup else M), mode)


def fold_parsed(E: DataFrame, mode: str = "replace") -> tuple[DataFrame, DataFrame]:
    """``fold_events`` over events that are parsed already."""
    L = latest_lifecycle(E, mode)
    metrics = metric_increments(E.filter(F.col("event_type").isin(METRIC)))
    was_set = F.col("set_off") > F.col("counter_from")
    mj = salted(metrics, last_positions(E, mode).select(
        "product_id", "counter_from", F.when(was_set, F.col("set_off")).otherwise(F.col("counter_from")).alias("click_from"),
        "l_off", "l_type"), "product_id", "offset")
    live = (F.col("l_type").isNotNull() & (F.col("l_type") != "ProductDeleted"))
    counted = mj.filter(live & (F.col("offset") > F.col("counter_from")))
    dropped = mj.filter(F.col("product_id").isNull() | F.col("l_type").isNull()
                        | ((F.col("l_type") == "ProductDeleted") & (F.col("offset") > F.col("l_off")))) \
        .select("product_id", "offset", "event_type")
    agg = counted.groupBy("product_id").agg(
        F.sum(F.when(F.col("offset") > F.col("click_from"), F.col("view_inc"))).alias("clicks_after"),
        F.count("view_inc").alias("n_views"),
        F.sum("buy_inc").alias("buys_after"),
        F.count("buy_inc").alias("n_buys"),
        F.max("offset").alias("last_metric"), F.max_by("pop_set", "offset").alias("pop_set"))
    doc = (L.filter(F.col("l_type") != "ProductDeleted")
           .join(agg, "product_id", "left"))
    created = F.col("L.event_type") == "ProductCreated"
    restart_zero = created if mode == "replace" else F.lit(True)
    base = F.when(restart_zero, F.lit(0).cast("bigint"))
    after = F.coalesce(F.col("clicks_after"), F.lit(0))
    clicks = (F.when(was_set, F.col("set_to") + after)
              .when(F.coalesce(F.col("n_views"), F.lit(0)) > 0, F.coalesce(base, F.lit(0)) + after).otherwise(base))
    buys = F.when(F.coalesce(F.col("n_buys"), F.lit(0)) > 0,
                  F.coalesce(base, F.lit(0)) + F.col("buys_after")).otherwise(base)
    any_metric = F.col("last_metric").isNotNull()
    pop = (F.when(any_metric, F.coalesce(F.col("pop_set"),
                                         FX.popularity(clicks, buys, "sync")))
           .when(restart_zero, F.lit(0.0)))
    ev = F.col("L.ev")
    doc = doc.select(
        F.col("product_id").cast("string").alias("id"),
        "product_id",
        ev["name"].alias("name"), ev["description"].alias("description"),
        ev["categories"].alias("categories"), ev["price"].alias("price"), ev["sku"].alias("sku"),
        ev["attributes"].alias("attributes"), ev["images"].alias("images"),
        F.when(created, ev["createdAt"]).alias("created_at"),
        F.when(created, ev["createdAt"]).otherwise(ev["updatedAt"]).alias("updated_at"),
        clicks.alias("click_count"), buys.alias("purchase_count"), pop.alias("popularity_score"),
        FX.all_text(ev["name"], ev["description"], ev["sku"], ev["categories"],
                    ev["attributes"], form="event").alias("all_text"),
        F.when(created, FX.tags(ev["categories"], ev["price"], None, None, "created", ev["attributes"]))
         .otherwise(FX.tags(ev["categories"], ev["price"], None, None, "updated", ev["attributes"]))
         .alias("tags"),
        F.lit(True).alias("in_stock"),
        FX.price_range(ev["price"], "event").alias("price_range"),
        F.lit(1.0).alias("score_boost"),
        F.col("L.offset").alias("source_offset"))
    return doc, dropped


def apply_metrics(D: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J8/ST11/U4: the index's scripted update as Column expressions: add
    pre-aggregated counters (product_id, clicks, purchases,
    popularity_set) to existing documents; popularity is set when given, else
    recomputed by F13. Metrics for unknown documents go to the side output."""
    m = metrics.groupBy("product_id").agg(
        F.sum("clicks").alias("_dc"), F.sum("purchases").alias("_dp"),
        F.max_by("popularity_set", "offset").alias("_pop") if "offset" in metrics.columns
        else F.max("popularity_set").alias("_pop"))
    j = D.join(m, "product_id", "left")
    hit = F.col("_dc").isNotNull() | F.col("_dp").isNotNull()
    c = F.when(hit & F.col("_dc").isNotNull(), FX.add_counter("click_count", F.col("_dc"))).otherwise(F.col("click_count"))
    p = F.when(hit & F.col("_dp").isNotNull(), FX.add_counter("purchase_count", F.col("_dp"))).otherwise(F.col("purchase_count"))
    pop = F.when(hit, F.coalesce(F.col("_pop"), FX.popularity(c, p, "sync"))).otherwise(F.col("popularity_score"))
    new = {"click_count": c, "purchase_count": p, "popularity_score": pop}
    out = j.select(*[new[x].alias(x) if x in new else F.col(x) for x in D.columns])
    unmatched = m.join(D.select("product_id"), "product_id", "left_anti")
    return out, unmatched


def merge_batch(D: DataFrame | None, batch: DataFrame) -> DataFrame:
    """``merge_slice`` without the dropped metric events."""
    return merge_slice(D, batch)[0]


def merge_slice(D: DataFrame | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST9 incremental form: fold one more slice of the log (a micro-batch,
    offsets after everything already in D) into documents D. Returns (documents,
    metric events that find no document once the slice is folded).

    Products with a lifecycle event in the slice are rebuilt from it exactly as
    ``fold_events`` does; the others only take the slice's metric events:
    counters add (null counts as 0 once touched), popularity is the last
    metric event's absolute value, else F13 of the new counters. Products
    without a live document drop their metric events. One partial aggregate
    per product per slice, so a hot product costs one row per map task.
    """
    return merge_parsed(D, parse_events(batch))


def merge_parsed(D: DataFrame | None, E: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``merge_slice`` of a slice that is parsed already; it is read several times."""
    L = last_positions(E).select("product_id")
    rebuilt, dropped = fold_parsed(E)
    if D is None:
        return rebuilt, dropped
    untouched = D.select("product_id").join(L, "product_id", "left_anti")
    dropped = dropped.join(untouched, "product_id", "left_anti").select(*dropped.columns)
    m = metric_increments(E.filter(F.col("event_type").isin(METRIC)))
    sets = m.filter(F.col("total").isNotNull()).groupBy("product_id").agg(
        F.max("offset").alias("set_off"), F.max_by("total", "offset").alias("set_to"))
    later = F.col("set_off").isNull() | (F.col("offset") > F.col("set_off"))
    agg = salted(m, sets, "product_id", "offset").groupBy("product_id").agg(
        F.sum(F.when(later, F.col("view_inc"))).alias("_dc"), F.count("view_inc").alias("_nv"),
        F.max("set_to").alias("_set"),
        F.sum("buy_inc").alias("_dp"), F.count("buy_inc").alias("_nb"),
        F.max("offset").alias("_last"), F.max_by("pop_set", "offset").alias("_pop"))
    kept = D.join(L, "product_id", "left_anti").join(agg, "product_id", "left")
    c = (F.when(F.col("_set").isNotNull(), F.col("_set") + F.coalesce(F.col("_dc"), F.lit(0)))
         .when(F.coalesce(F.col("_nv"), F.lit(0)) > 0, FX.add_counter("click_count", F.col("_dc")))
         .otherwise(F.col("click_count")))
    p = F.when(F.coalesce(F.col("_nb"), F.lit(0)) > 0,
               FX.add_counter("purchase_count", F.col("_dp"))).otherwise(F.col("purchase_count"))
    pop = F.when(F.col("_last").isNotNull(),
                 F.coalesce(F.col("_pop"), FX.popularity(c, p, "sync"))
                 ).otherwise(F.col("popularity_score"))
    new = {"click_count": c.cast("bigint"), "purchase_count": p.cast("bigint"), "popularity_score": pop}
    kept = kept.select(*[new[x].alias(x) if x in new else F.col(x) for x in D.columns])
    return kept.unionByName(rebuilt.select(*D.columns)), dropped


# roll-ups ------------------------------------------------------------------------
def view_counts(views: DataFrame) -> DataFrame:
    """A10: total views per product."""
    return views.groupBy("product_id").agg(F.count(F.lit(1)).alias("total_views"))


def daily_views(views: DataFrame) -> DataFrame:
    """A10: views per product and day."""
    return views.groupBy("product_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("views"))


def _distinct_bits(rows: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """One row with an exact distinct count for each kind of whole number: one pass that turns numbers into
    bits of blocks of 2^15, one row a block and task, and sums the set bits."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("bigint").alias("x")) for k, c in kinds.items()]))
    numbers = rows.select(each.alias("e")).select("e.kind", "e.x").where("x is not null")
    blocks = (numbers.groupBy("kind", F.bitmap_bucket_number("x").alias("block"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")))
    return blocks.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.bitmap_count("bits"))), F.lit(0)).alias(k) for k in kinds])


def view_stats(views: DataFrame) -> DataFrame:
    """A11 (inferred fields): total views, products viewed, active days, viewers. Ids are dense numbers, so
    their bitmaps are small; the total comes from the same kind of pass."""
    parts = [views.agg(F.count(F.lit(1)).alias("total_views")),
             _distinct_bits(views, {"products_viewed": F.col("product_id"), "active_days": F.unix_date(F.to_date("ts")),
                                    "viewers": F.col("user_id")})]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("total_views", "products_viewed", "active_days", "viewers")])


def purchase_stats(purchases: DataFrame, parts: int | None = None) -> DataFrame:
    """Per product: quantity, revenue = sum(unit price x quantity) in
    Decimal (F14), distinct orders, buyers. Purchases are dealt by product and order and first summed per product, order
    and buyer; orders and buyers are groups of that, each counted by itself, so no row is repeated per
    distinct count and a hot product is spread over its orders. ``parts``: tasks that the groups, about as many as the
    purchases, are dealt over; with it the memory of a task does not grow with the input."""
    line_total = (F.col("unit_price") * F.col("quantity").cast("decimal(10,0)"))
    deal = lambda df, *keys: df.repartition(parts, *keys) if parts else df.repartition(*keys)
    groups = deal(purchases, "product_id", "order_id").groupBy("product_id", "order_id", "user_id").agg(
        F.sum(F.col("quantity").cast("bigint")).alias("quantity"), F.sum(line_total).alias("revenue"))
    # a product and order lie in one task, so orders need no further shuffle
    orders = groups.groupBy("product_id", "order_id").agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))
    total = orders.groupBy("product_id").agg(F.sum("quantity").alias("quantity"), F.sum("revenue").cast("decimal(20,2)").alias("revenue"),
                                             F.count("order_id").alias("orders"))
    buyers = (deal(groups.select("product_id", "user_id"), "product_id", "user_id").groupBy("product_id", "user_id").agg(F.lit(1))
              .groupBy("product_id").agg(F.count("user_id").alias("buyers")))
    return total.join(buyers, "product_id")


def popularity_from_counters(P: DataFrame, views: DataFrame, purchases: DataFrame,
                             model: str = "entity") -> DataFrame:
    """Recompute counters from the event tables and popularity from them."""
    v = view_counts(views).withColumnRenamed("total_views", "_c")
    b = purchases.groupBy("product_id").agg(F.sum(F.col("quantity").cast("bigint")).alias("_p"))
    j = (P.drop("click_count", "purchase_count", "popularity_score")
         .join(v, P.id == v.product_id, "left").drop("product_id")
         .join(b, P.id == b.product_id, "left").drop("product_id"))
    c = F.coalesce(F.col("_c"), F.lit(0)).cast("bigint")
    p = F.coalesce(F.col("_p"), F.lit(0)).cast("bigint")
    return (j.withColumn("click_count", c).withColumn("purchase_count", p)
            .withColumn("popularity_score", FX.popularity(c, p, model)).drop("_c", "_p"))


def is_metric(c: Column) -> Column:
    return c.isin(METRIC)


__all__ = ["dedupe", "parse_events", "fold_events", "apply_metrics", "latest_lifecycle",
           "view_counts", "daily_views", "view_stats", "purchase_stats", "popularity_from_counters",
           "MX"]
