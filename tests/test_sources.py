"""Sources and sinks: quarantine of unreadable lines, document merges, event append."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tests.conftest import SF001
from vitrine.plans import views as V
from vitrine.operators import fold as FO
from vitrine.operators import quality as Q
from vitrine.session import scratch_path
from vitrine.sources import tables as T
from vitrine.streaming import streams as ST


def test_unreadable_lines_are_quarantined(spark):
    path = scratch_path(spark, "lines")
    lines = ['{"request_id":1,"name":"A","price":1.5,"sku":"A-1","categories":["x"]}', '{"request_id":2,"name":"B"', "no json",
             '{"request_id":"many","name":"C"}', "", "  ", "[1, 2]", '{"request_id":5,"name":"ü","extra":{"a":1}}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = T.ingest_products(spark, path)
    assert {(r.request_id, r.name) for r in good.collect()} == {(1, "A"), (5, "ü")}
    assert sorted(r.line for r in bad.collect()) == sorted([lines[1], "no json", lines[3], "[1, 2]"])
    assert {(r.code, tuple(r.errors.items())) for r in bad.collect()} == {(Q.VALIDATION_ERROR, (("body", "Malformed JSON request"),))}
    assert {r.request_id for r in Q.split_valid(Q.validate_create(good))[1].collect()} == {5}


def test_document_merge_touches_the_parts_of_its_keys(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    docs = lambda rows: spark.createDataFrame(rows, "product_id long, name string, updated_at timestamp_ntz")
    ids = lambda rows: spark.createDataFrame([(x,) for x in rows], "product_id long")
    table = ST.KeyedTable(scratch_path(spark, "docs"), "product_id", 8)
    T.write_documents(docs([(i, f"n{i}", day(1)) for i in range(100)]), table)
    changes = docs([(3, "old", day(2)), (3, "new", day(3)), (200, "added", day(2)), (4, "gone", day(2))])
    T.merge_documents(spark, table, changes, ids([4, 5, 999]), 1)
    got = {r.product_id: r.name for r in table.latest(spark).collect()}
    assert got == {i: f"n{i}" for i in range(100) if i not in (3, 4, 5)} | {3: "new", 200: "added"}
    touched = set(table.touched(ids([3, 4, 5, 200, 999])))
    assert {p for p, v in table.versions(spark).items() if v[-1] == 1} == touched and len(touched) < 8
    T.merge_documents(spark, table, changes, ids([4, 5, 999]), 1)        # a re-run gives the same
    assert {r.product_id: r.name for r in table.latest(spark).collect()} == got


def test_events_stored_twice_are_there_once(spark):
    path = scratch_path(spark, "events")
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), i % 2 == 0) for i in range(10)], "id long, created_at timestamp_ntz, processed boolean")
    T.store_events(rows.where("id < 5"), path, 0)
    for _ in range(2):
        T.store_events(rows.where("id >= 5"), path, 1)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10))
    assert [r.id for r in T.scan_outbox(spark, path, 3).collect()] == [1, 3, 5]
    assert {d for d in os.listdir(path.replace("file:", "")) if d.startswith("batch=")} == {"batch=0", "batch=1"}


def test_distinct_counts_repeat_no_row(spark):
    views = spark.createDataFrame([(i % 7, 10**6 + i % 3, dt.datetime(2024, 1, 1 + i % 5)) for i in range(200)] + [(None, None, None)],
                                  "product_id long, user_id long, ts timestamp_ntz")
    stats = FO.view_stats(views)
    assert stats.first().asDict() == {"total_views": 201, "products_viewed": 7, "active_days": 5, "viewers": 3}
    empty = FO.view_stats(views.limit(0)).first()
    assert (empty.total_views, empty.products_viewed) == (0, 0)
    rows = [(i % 4, i % 10, i % 6, 1 + i % 3, 2) for i in range(120)]
    bought = spark.createDataFrame(rows, "product_id long, order_id long, user_id long, quantity int, unit_price int").withColumn(
        "unit_price", F.col("unit_price").cast("decimal(10,2)"))
    per = FO.purchase_stats(bought)
    want = {p: (sum(q for x, _, _, q, _ in rows if x == p), len({o for x, o, *_ in rows if x == p}), len({u for x, _, u, *_ in rows if x == p}))
            for p in range(4)}
    assert {r.product_id: (r.quantity, r.orders, r.buyers) for r in per.collect()} == want
    for df in (stats, per):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_purchases_are_dealt_by_their_number(spark, monkeypatch):
    """F16: the tasks of the join and of the groups grow with the line items, so the memory of one does not."""
    one = FO.purchase_stats(V.purchases(spark, SF001))
    monkeypatch.setattr(V, "TASK_ITEMS", 500)
    n = V.purchase_parts(spark, SF001)
    assert n > spark.sparkContext.defaultParallelism
    many = FO.purchase_stats(V.purchases(spark, SF001), n)
    assert many._jdf.queryExecution().optimizedPlan().toString().count(f", {n}") >= 4      # both sides of the join, groups, buyers
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
