"""Registered queries of the sources and sinks: JSON ingest (S10), document writes
and merges (S7, S8), event append and outbox scan (S9, S3), topic listeners (S4, U1-U3), and small
projections over them (P2, J3, T8, A17, F25, F26)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from vitrine.functions import features as FX
from vitrine.operators import catalog as C
from vitrine.operators import outbox as OB
from vitrine.operators import quality as Q
from vitrine.operators import sync as S
from vitrine.plans import views as V
from vitrine.plans.queries_events import topic_log
from vitrine.plans.registry import money, register
from vitrine.session import scratch_path
from vitrine.sources import schemas as SC
from vitrine.sources import tables as T
from vitrine.streaming import streams as ST


def _documents(spark, sf):
    return S.full_sync(V.product(spark, sf), V.as_of())


@register("ingest_products", """
SELECT request_id, CASE WHEN request_id % 37 <> 0 AND request_id % 41 <> 0 THEN upper(trim(sku)) END AS sku,
       CASE WHEN request_id % 37 = 0 OR request_id % 41 = 0 THEN 'body:Malformed JSON request' ELSE errors END AS errors
FROM create_chk_v""", ("create_chk_v",))
def q_ingest_products(spark, sf):
    """The create requests as JSON lines, every 37th cut short and every 41st with a
    list for a SKU: readable lines with their field errors, the others as quarantined lines."""
    path = scratch_path(spark, "requests")
    i = F.col("request_id")
    whole = F.to_json(F.struct(*[f.name for f in SC.CREATE_REQUEST.fields]))
    line = (F.when(i % 37 == 0, F.expr("substring(line, 1, length(line) - 7)"))
            .when(i % 41 == 0, F.regexp_replace("line", '"sku":"[^"]*"', '"sku":[["x"],1')).otherwise(F.col("line")))
    V.create_requests(spark, sf).withColumn("line", whole).select(line.alias("value")).write.text(path)
    requests, bad = T.ingest_products(spark, path)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ";")
    good = Q.validate_create(requests).select("request_id", FX.normalise_sku("sku").alias("sku"), text.alias("errors"))
    return good.unionByName(bad.select(F.regexp_extract("line", '"request_id":(\\d+)', 1).cast("bigint").alias("request_id"),
                                       F.lit(None).cast("string").alias("sku"), text.alias("errors")))


@register("upsert_documents", """
, gone AS (SELECT DISTINCT user_id * 14 + event_id % 14 AS id FROM events WHERE event_type = 'error'),
seen AS (SELECT DISTINCT product_id AS id FROM views_v)
SELECT d.product_id, d.name, d.click_count + CASE WHEN d.product_id IN (SELECT id FROM seen) THEN 1000 ELSE 0 END AS click_count
FROM doc_v d WHERE d.product_id NOT IN (SELECT id FROM gone)""", ("doc_v", "views_v"))
def q_upsert_documents(spark, sf):
    """All documents written, then one merge of upserts (viewed products) and deletes."""
    table = ST.documents_table(scratch_path(spark, "documents"))
    docs = _documents(spark, sf)
    T.write_documents(docs, table)
    seen = V.views(spark, sf).select("product_id").distinct()
    upserts = docs.join(seen, "product_id", "left_semi").withColumn("click_count", F.col("click_count") + 1000)
    T.merge_documents(spark, table, upserts, V.delete_ids(spark, sf).withColumnRenamed("id", "product_id"), 1)
    return table.latest(spark).select("product_id", "name", "click_count")


@register("store_events", """
SELECT id, aggregate_id, event_type, created_at FROM outbox_v WHERE NOT processed""", ("outbox_v",))
def q_store_events(spark, sf):
    """Outbox rows appended in two batches, the second stored twice, and the unprocessed ones scanned."""
    O, path = V.outbox(spark, sf), scratch_path(spark, "outbox")
    for batch, half in ((0, 0), (1, 1), (1, 1)):
        T.store_events(O.where(F.col("id") % 2 == half), path, batch)
    return T.scan_outbox(spark, path).select("id", "aggregate_id", "event_type", "created_at")


@register("scan_outbox_oldest", """
SELECT id, created_at FROM outbox_v WHERE NOT processed ORDER BY created_at, id LIMIT 100""", ("outbox_v",))
def q_scan_outbox_oldest(spark, sf):
    """S3 with its bound: the 100 oldest unprocessed rows."""
    path = scratch_path(spark, "outbox")
    T.store_events(V.outbox(spark, sf), path, 0)
    return T.scan_outbox(spark, path, 100).select("id", "created_at")


@register("topic_listeners", """
SELECT 'counts' AS listener, event_type AS item, count(*) AS n FROM topic_v WHERE topic IN ('product-events', 'user-events') GROUP BY event_type
UNION ALL SELECT 'keys', partition_key, sum(length(event_data))::BIGINT FROM topic_v JOIN outbox_v ON outbox_v.id = topic_v.outbox_id
WHERE topic = 'order-events' GROUP BY partition_key""", ("topic_v", "outbox_v"))
def q_topic_listeners(spark, sf):
    """Two listeners with their own positions: one counts whole batches of two topics, one takes
    single messages of a third; each writes what it finds, batch by batch."""
    root, out = scratch_path(spark, "topics"), scratch_path(spark, "listeners")
    OB.route(topic_log(spark, sf).select(*[f.name for f in SC.MESSAGE.fields]), root)

    def counts(batch, batch_id):
        (batch.groupBy(F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").parquet(f"{out}/listener=counts/batch={batch_id}"))

    def sizes(messages):
        return messages[["partition_key"]].rename(columns={"partition_key": "item"}).assign(n=messages["payload"].str.len())

    def keep(found, batch_id):
        found.groupBy("item").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/listener=keys/batch={batch_id}")

    name = out.rsplit("-", 1)[-1]
    listeners = [ST.Listener(f"counts-{name}", ["product-events", "user-events"], batch_handler=counts),
                 ST.Listener(f"keys-{name}", ["order-events"], message_handler=sizes, output_schema="item string, n long")]
    for query in ST.start_listeners(spark, root, SC.MESSAGE, listeners, sink=keep, max_files=8):
        query.awaitTermination()
    return spark.read.parquet(out).groupBy("listener", "item").agg(F.sum("n").alias("n"))


@register("stream_purge", """
SELECT id, processed FROM outbox_v WHERE NOT coalesce(processed AND processed_at < TIMESTAMP '2024-01-24 02:00:00', false)""", ("outbox_v",))
def q_stream_purge(spark, sf):
    """ST12/ST13: the daily purge, due at 02:00 of the last day, as its clock finds it at 09:30."""
    table = ST.VersionedTable(scratch_path(spark, "outbox-table"))
    table.write(V.outbox(spark, sf), 0)
    name = f"purge-{table.path.rsplit('-', 1)[-1]}"
    query = ST.purge_stream(spark, table, lambda: dt.datetime(2024, 1, 31, 9, 30), name=name, trigger=ST.RELAY_TRIGGER)
    ST.run_until(query, lambda: len(table.versions(spark)) > 1)
    return table.latest(spark).select("id", "processed")


@register("scan_product_files", """
SELECT id, name, sku, CAST(price AS DOUBLE) AS price, len(categories) AS categories, len(images) AS images, version FROM product_v""",
          ("product_v",))
def q_scan_product_files(spark, sf):
    """The product table written as files and scanned under the fixed schema."""
    path = scratch_path(spark, "products")
    V.product(spark, sf).write.parquet(path)
    return T.scan_products(spark, path).select("id", "name", "sku", money("price").alias("price"),
                                               F.size("categories").cast("bigint").alias("categories"),
                                               F.size("images").cast("bigint").alias("images"), "version")


@register("document_dto", """
SELECT product_id AS id, name, sku, CAST(price AS DOUBLE) AS price, click_count, popularity_score, created_at FROM doc_v""", ("doc_v",))
def q_document_dto(spark, sf):
    """The public row of every document."""
    return C.document_to_dto(_documents(spark, sf)).select("id", "name", "sku", money("price").alias("price"), "click_count",
                                                           "popularity_score", "created_at")


@register("with_categories", """
SELECT id, array_to_string(list_sort(categories), '|') AS categories FROM product_v""", ("product_v",))
def q_with_categories(spark, sf):
    """Products joined with their category side table."""
    P, cats, _, _ = T.flatten(V.product(spark, sf))
    return C.with_categories(P, cats).select("id", F.array_join("categories", "|").alias("categories"))


@register("capped_page", """
SELECT id, popularity_score FROM product_v ORDER BY popularity_score DESC, id ASC LIMIT 20 OFFSET 40""", ("product_v",))
def q_capped_page(spark, sf):
    """A page inside the result window of 10,000."""
    order = [F.col("popularity_score").desc(), F.col("id").asc()]
    return C.page(V.product(spark, sf), order, 2, 20, cap=10_000).select("id", "popularity_score")


@register("distinct_tags", "SELECT DISTINCT unnest(tags) AS tag FROM doc_v", ("doc_v",))
def q_distinct_tags(spark, sf):
    """The distinct tags of all documents."""
    return C.distinct_values(_documents(spark, sf).select(F.explode("tags").alias("tag")), "tag")


@register("index_values", """
SELECT product_id, CASE WHEN length(name) <= 256 THEN name END AS name_keyword, round(popularity_score, 2) AS score,
       round(score_boost, 2) AS boost FROM doc_v""", ("doc_v",))
def q_index_values(spark, sf):
    """the values that the index keeps of names and scores."""
    return _documents(spark, sf).select("product_id", FX.keyword("name").alias("name_keyword"),
                                        FX.scaled2("popularity_score").alias("score"), FX.scaled2("score_boost").alias("boost"))


@register("suggest_names", """
SELECT DISTINCT name FROM (SELECT name FROM doc_v WHERE starts_with(lower(name), 's') ORDER BY product_id LIMIT 10)""", ("doc_v",))
def q_suggest_names(spark, sf):
    """Limit first, then distinct values (may be fewer)."""
    found = _documents(spark, sf).where(F.lower("name").startswith("s")).orderBy("product_id")
    return C.limit_then_distinct(found, "name", 10)
